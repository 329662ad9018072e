"""Documents that events move from state to state.

An event is a map from states to states, and such maps compose: what a range of events does to a document is one map, whatever state it
begins in.  So a document with any share of all events is read in ranges: a loop over each gives its map, maps are composed from
range to range, and a second loop begins with the state that the ranges before it lead to.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.running import PART, ranged
from tallyspark.sources.scratch import written


@dataclass(frozen=True)
class Machine:
    """`moves`: event to (from, to); any other event, or the same in another state, is refused and changes nothing.  The first of `states` is where a document begins."""

    states: tuple[str, ...]
    moves: dict[str, dict[str, str]]

    def step(self, state: int, event: str | None) -> int:
        to = self.moves.get(event, {}).get(self.states[state])
        return state if to is None else self.states.index(to)


#: An invoice is drafted, sent and becomes final; a number that exists is not drafted again.
INVOICE = Machine(("YOK", "TASLAK", "GONDERILDI", "KESINLESTI"), {"olustur": {"YOK": "TASLAK"}, "gonder": {"TASLAK": "GONDERILDI"}, "kesinlesti": {"GONDERILDI": "KESINLESTI"}})


def _maps(machine: Machine):
    """Of rows (part, no, event) in order: the map of each document in each range."""

    def made(batches):
        key, now = None, []
        for batch in batches:
            done = []
            for part, no, event in zip(*[c.to_pylist() for c in batch.columns]):
                if (part, no) != key:
                    if key:
                        done.append((*key, now))
                    key, now = (part, no), list(range(len(machine.states)))
                now = [machine.step(s, event) for s in now]
            yield _rows(done)
        if key:
            yield _rows([(*key, now)])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.list_(pa.int32())])], [PART, "no", "map"])

    return made


def _walk(machine: Machine):
    """Of rows (part, no, at, id, event, start) in order: each event with the states before and after it."""

    def made(batches):
        key, state = None, 0
        for batch in batches:
            before, after = [], []
            for part, no, event, start in zip(*[batch.column(i).to_pylist() for i in (0, 1, 4, 5)]):
                if (part, no) != key:
                    key, state = (part, no), start
                before.append(machine.states[state])
                state = machine.step(state, event)
                after.append(machine.states[state])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(before, pa.string()), pa.array(after, pa.string())], ["no", "at", "id", "event", "before", "after"])

    return made


def lifecycle(events: DataFrame, machine: Machine = INVOICE) -> DataFrame:
    """`events` (no, at: a timestamp, id, event) to no, at, id, event, before, after, accepted.

    Events of a document go by time, then id.  One that the state does not allow is refused: sending what is no draft, a number drafted twice.
    """
    rows = events.select(F.col("no").cast("long").alias("no"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), "event")
    parts = ranged(rows, ["no"], ["at", "id"])
    order = [PART, "no", "at", "id"]
    # Only documents that go on from one range to another need maps: one of each range at most.
    spans = parts.groupBy("no").agg(F.min(PART).alias("a"), F.max(PART).alias("b")).where("a < b").select("no")
    spans = F.broadcast(written(spans, "spans"))
    maps = parts.join(spans, "no").select(*order, "event").repartition(PART).sortWithinPartitions(*order).select(PART, "no", "event").mapInArrow(_maps(machine), f"{PART} int, no long, map array<int>")
    none = F.array().cast(f"array<struct<{PART}:int,start:int>>")
    pair = lambda p, s: F.struct(p.alias(PART), s.alias("start"))
    walked = F.aggregate("m", F.struct(F.lit(0).alias("s"), none.alias("out")), lambda a, x: F.struct(F.get(x["map"], a["s"]).alias("s"), F.concat(a["out"], F.array(pair(x[PART], a["s"]))).alias("out")))
    starts = maps.groupBy("no").agg(F.array_sort(F.collect_list(F.struct(PART, "map"))).alias("m")).select("no", F.explode(walked["out"]).alias("x")).select("no", f"x.{PART}", "x.start")
    starts = F.broadcast(written(starts, "starts"))  # a row for each range at most
    met = parts.join(starts, [PART, "no"], "left").withColumn("start", F.coalesce("start", F.lit(0))).select(*order, "event", "start")
    out = met.repartition(PART).sortWithinPartitions(*order).mapInArrow(_walk(machine), "no long, at timestamp, id long, event string, before string, after string")
    return out.withColumn("accepted", F.col("before") != F.col("after"))


def invoices(walked: DataFrame) -> DataFrame:
    """What `lifecycle` leaves of each invoice: its state, number with the integrator (from sending), archived document and day of its voucher (from becoming final), refused events.

    Numbers that were never drafted are none.
    """
    when = lambda event: F.max(F.when(F.col("accepted") & (F.col("event") == event), F.struct("at", "id")))
    out = walked.groupBy("no").agg(F.max_by("after", F.struct("at", "id")).alias("state"), when("gonder").alias("sent"), when("kesinlesti").alias("final"), F.count_if(~F.col("accepted")).alias("refused"))
    name = F.format_string("EF-%d-%06d", "no", "sent.id")
    return out.where("state <> 'YOK'").select("no", "state", F.when(F.col("sent").isNotNull(), name).alias("uuid"), F.when(F.col("final").isNotNull(), F.concat(F.lit("arsiv/"), F.col("no").cast("string"), F.lit(".xml"))).alias("archive"), F.to_date("final.at").alias("voucher_date"), "refused")
