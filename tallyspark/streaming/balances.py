"""Running balances of accounts over a stream, with what each account needs kept as state instead of the ledger read anew.

An account's state is the number of the last movement that was booked, the balance after it, and movements that came before their turn.
Movements are booked in the order of their numbers once the watermark says that no earlier one can come; a number that was booked already is
dropped, so that a repeated batch changes nothing.  So the stream may bring movements in any order and more than once, up to `late`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BOOKED = "account long, seq long, amount_kr long, balance_kr long"
LEAST = -(1 << 62)
STATE = "last long, balance_kr long, seqs array<long>, amounts array<long>, times array<long>"


def _book(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, balance, seqs, amounts, times = state.get if state.exists else (LEAST, 0, [], [], [])
    waiting = {s: (a, t) for s, a, t in zip(seqs, amounts, times)}
    for rows in batches:
        for s, a, t in zip(rows["seq"].tolist(), rows["amount_kr"].tolist(), rows["at"].tolist()):
            if s > last:
                waiting[int(s)] = (int(a), int(t))
    # What is older than the watermark can have no unseen movement before it.
    sure = state.getCurrentWatermarkMs()
    booked = []
    for s in sorted(waiting):
        if waiting[s][1] > sure:
            break
        last, balance = s, balance + waiting[s][0]
        booked.append((key[0], s, waiting.pop(s)[0], balance))
    left = sorted(waiting)
    state.update((last, balance, left, [waiting[s][0] for s in left], [waiting[s][1] for s in left]))
    if left:
        state.setTimeoutTimestamp(max(waiting[left[0]][1], sure) + 1)
    yield pd.DataFrame(booked, columns=["account", "seq", "amount_kr", "balance_kr"])


def running_balances(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """`stream` (account, seq, at: a timestamp, amount_kr signed; numbers rise with time within an account) to each movement once, with the balance after it."""
    rows = stream.withWatermark("at", late).select("account", "seq", "amount_kr", F.unix_millis("at").alias("at"), F.col("at").alias("event_time"))
    return rows.groupBy("account").applyInPandasWithState(_book, BOOKED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
