"""Bank statements and reconciliation."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators.running import PART, ranged, running
from tallyspark.sources.scratch import written


def signed() -> Column:
    return F.when(F.col("direction") == "GIRIS", F.col("amount_kr")).otherwise(-F.col("amount_kr"))


def day_number(date: str | Column) -> Column:
    """372-day years of 31-day months: the distance that matching uses."""
    d = F.col(date) if isinstance(date, str) else date
    return F.year(d) * 372 + F.month(d) * 31 + F.dayofmonth(d)


def balance_chain(movements: DataFrame, opening_kr: int = 0) -> DataFrame:
    """Movements whose reported balance is not the last reported one and their amount."""
    last = {"last": (F.max, F.struct("seq", "balance_kr"), -1)}
    out = running(ranged(movements, ["account"], ["seq"]), ["account"], ["seq"], last)
    return out.withColumn("expected_kr", F.coalesce("last.balance_kr", F.lit(opening_kr)) + signed()).where("expected_kr <> balance_kr").select("account", "seq", "expected_kr", "balance_kr")


def statement_carry(statements: DataFrame) -> DataFrame:
    """Statements (account, period, opening_kr, closing_kr) that do not open with the last one's closing balance."""
    before = F.lag("closing_kr").over(Window.partitionBy("account").orderBy("period"))
    return statements.withColumn("carried_kr", before).where("carried_kr <> opening_kr")


def reversal_pairs(movements: DataFrame) -> DataFrame:
    """Movements with an earlier one of the account that has the same amount and the other direction: the nearest before."""
    other = F.when(F.col("direction") == "GIRIS", "CIKIS").otherwise("GIRIS")
    keys = ["account", "amount_kr"]
    way = lambda d: F.when(F.col("direction") == d, F.col("seq"))
    out = running(ranged(movements, keys, ["seq"]), keys, ["seq"], {"_in": (F.max, way("GIRIS"), -1), "_out": (F.max, way("CIKIS"), -1)})
    return out.withColumn("reverses", F.when(other == "GIRIS", F.col("_in")).otherwise(F.col("_out"))).where("reverses is not null").select("account", "seq", "direction", "amount_kr", "reverses")


#: Words of a movement's text that hint at a reversal, folded (fixed values).
REVERSAL_HINTS = ["TERS ", "IPTAL", "IADE", "GERI DONE", "REVERSAL", "REFUND", "CHARGEBACK", "TERS:", "ISLEM IPTAL"]


def reversals(movements: DataFrame, least: float = 0.5) -> DataFrame:
    """`movements` (account, seq, direction, amount_kr, text, name) that reverse an earlier one, with the latest such as `reverses`.

    The text must hint at it, and an earlier movement of the account must have the same amount, the other direction and a name that shares words
    to `least` or more (or both have none).  Names meet once, through `name_links`; a hint then asks for each name like its own
    for the last movement before it, which is a running maximum within (account, amount, direction, name).
    """
    none = "\0"
    rows = movements.withColumn("name", F.coalesce(names.canonical("name"), F.lit(none)))
    hint = F.exists(F.array(*map(F.lit, REVERSAL_HINTS)), lambda h: F.contains(names.fold("text"), h))
    asked = rows.where(F.coalesce(hint, F.lit(False))).select("account", "amount_kr", "direction", "seq", "name")
    known = rows.select("name").distinct()
    links = name_links(known.where(F.col("name") != none), least)
    like = links.select("name", "other").unionByName(links.select(F.col("other").alias("name"), F.col("name").alias("other"))).unionByName(known.where("name <> ''").select("name", F.col("name").alias("other")))
    other = F.when(F.col("direction") == "GIRIS", "CIKIS").otherwise("GIRIS")
    keys, order = ["account", "amount_kr", "way", "other"], ["seq", "side"]
    asks = asked.join(like, "name").select("account", "amount_kr", other.alias("way"), "other", "seq", F.lit(1).alias("side"))
    gives = rows.select("account", "amount_kr", F.col("direction").alias("way"), F.col("name").alias("other"), "seq", F.lit(0).alias("side"))
    met = running(ranged(asks.unionByName(gives), keys, order), keys, order, {"last": (F.max, F.when(F.col("side") == 0, F.col("seq")), -1)})
    found = met.where("side = 1 and last is not null").groupBy("account", "seq", F.when(F.col("way") == "GIRIS", "CIKIS").otherwise("GIRIS").alias("direction"), "amount_kr")
    return found.agg(F.max("last").alias("reverses"))


def islands(ours: DataFrame, theirs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Rows of both sides (mine, id, day, keys) with `island`: neighbours in time of a key no more than `window` days apart."""
    side = lambda df, mine: df.select(*keys, day_number("date").alias("day"), F.lit(mine).alias("mine"), "id")
    order = ["day", "mine", "id"]
    both = running(ranged(side(ours, True).unionByName(side(theirs, False)), keys, order), keys, order, {"last": (F.max, F.col("day"), -1)})
    both = written(both.withColumn("apart", (F.col("day") - F.col("last") > window).cast("int")), "apart")
    return running(both, keys, order, {"island": (F.sum, F.coalesce("apart", F.lit(0)))}).drop(PART)


class _Open:
    """Counterparts of one group that are still open, by day; within a day the smallest id goes first."""

    def __init__(self):
        self.days: list[int] = []  # ascending
        self.ids: dict[int, deque] = {}

    def add(self, day: int, number: int) -> None:
        if day not in self.ids:
            self.days.append(day)
            self.ids[day] = deque()
        self.ids[day].append(number)

    def nearest(self, day: int, window: float) -> int | None:
        """The id of the nearest, taken out; those too far back for this and any later day are forgotten."""
        gone = bisect_left(self.days, day - window)
        for d in self.days[:gone]:
            del self.ids[d]
        del self.days[:gone]
        k = bisect_left(self.days, day)
        near = [(abs(d - day), self.ids[d][0], d) for d in self.days[max(k - 1, 0) : k + 1] if abs(d - day) <= window]
        if not near:
            return None
        _, number, d = min(near)
        self.ids[d].popleft()
        if not self.ids[d]:
            del self.ids[d]
            del self.days[bisect_left(self.days, d)]
        return number


def _pairs(window: int | None):
    """Of rows (name, amount_kr, island, day, mine, id) in order: pairs.  Ours wait until all counterparts within the window have come."""
    far = float("inf") if window is None else window

    def made(batches):
        key, out = None, []
        waiting, open_ = deque(), _Open()

        def settle(upto: float) -> None:
            while waiting and waiting[0][0] < upto:
                day, number = waiting.popleft()
                their = open_.nearest(day, far)
                if their is not None:
                    out.append((key[0], key[1], number, their))

        for batch in batches:
            for *group, day, mine, number in zip(*[c.to_pylist() for c in batch.columns]):
                if group != key:
                    settle(float("inf"))
                    key, open_ = group, _Open()
                settle(day - far)
                if mine:
                    waiting.append((day, number))
                else:
                    open_.add(day, number)
            yield _batch(out)
            out.clear()
        settle(float("inf"))
        yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(4)], ["name", "amount_kr", "id", "their_id"])

    return made


def reconcile(ours: DataFrame, theirs: DataFrame, window: int | None = None) -> DataFrame:
    """Pairs (id, their_id) of one name and exact amount: ours, by date and id, each take the nearest counterpart that is left; ties go to the smaller id.

    A name and an amount are a group, cut where no two dates are within the window of each other, since nothing can match across such a
    gap.  A group is read in order of time and never gathered: what a task holds are the rows within two windows of the day it is
    at, so a group may have any share of all rows.  Without a window, its counterparts all stay open and are held.  No name is a name too.
    """
    plain = lambda df: df.withColumn("name", F.coalesce("name", F.lit("")))
    keys = ["name", "amount_kr"]
    rows = islands(plain(ours), plain(theirs), keys, window if window is not None else 1 << 30).withColumn("day", F.col("day").cast("long"))
    order = [*keys, "island", "day", "id"]
    sides = rows.select(*keys, F.col("island").cast("long").alias("island"), "day", "mine", F.col("id").cast("long").alias("id"))
    return sides.repartition(*keys, "island").sortWithinPartitions(*order).mapInArrow(_pairs(window), "name string, amount_kr long, id long, their_id long")


def leftovers(ours: DataFrame, pairs: DataFrame, theirs: DataFrame) -> DataFrame:
    """Ours without a pair: GrupIciEksik if the other side knows the name, IsimYok if not."""
    plain = lambda df: df.withColumn("name", F.coalesce("name", F.lit("")))
    known = plain(theirs).select("name").distinct().withColumn("known", F.lit(True))
    rest = plain(ours).join(pairs.select("id"), "id", "left_anti").join(known, "name", "left")
    return rest.select("id", "name", "amount_kr", F.when(F.col("known"), "GrupIciEksik").otherwise("IsimYok").alias("category"))


def suggestions(items: DataFrame, vouchers: DataFrame, days: int, most: int = 10) -> DataFrame:
    """`items` (id, amount_kr, date) with up to `most` `vouchers` (voucher, amount_kr, date) of the exact amount within `days`.

    The band is cut into steps of its width: an item meets its own and the neighbouring steps only.  Of the vouchers of an
    amount and a day only the first `most` can be among those of an item, so no others enter the join, however frequent the
    amount is; Spark drops them before its shuffle.
    """
    v = vouchers.withColumn("day", day_number("date")).withColumn("step", F.floor(F.col("day") / (days + 1)))
    v = v.withColumn("k", F.row_number().over(Window.partitionBy("amount_kr", "day").orderBy("voucher"))).where(F.col("k") <= most)
    i = items.withColumn("iday", day_number("date")).select("id", "amount_kr", "iday", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("iday") / (days + 1)) + k)).alias("step"))
    met = i.join(v.select("voucher", "amount_kr", "day", "step"), ["amount_kr", "step"]).where(F.abs(F.col("iday") - F.col("day")) <= days)
    w = Window.partitionBy("id").orderBy("voucher")
    return met.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("id", "voucher", F.abs(F.col("iday") - F.col("day")).alias("days"))


def name_pairs(queries: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """`queries` (id, name) with the distinct names of `named` (name) that share words to `least` or more.

    Names find each other once, by `name_links`, however many rows have them; a query then takes those of its own name.
    """
    links = name_links(queries.select("name").unionByName(named.select("name")), least)
    both = links.unionByName(links.select(F.col("other").alias("name"), F.col("name").alias("other"), "score"))
    known = named.select(F.col("name").alias("other")).where("other <> ''").distinct()
    same = known.select(F.col("other").alias("name"), "other", F.lit(1.0).alias("score"))
    return queries.join(both.unionByName(same), "name").join(known, "other", "left_semi").select("id", "other", "score")


def name_links(named: DataFrame, least: float) -> DataFrame:
    """Pairs (name < other) of distinct names of `named` (name) that share words to `least` or more.

    A name's words are ordered, rare ones first.  Two names of that share have numbers of words that differ by it at most,
    and share a word among the first `n - ceil(least * n) + 1` of each; on those they meet, and the share is checked.
    `least` is above 0; scores are rounded to six places before the check.
    """
    low = least - 1e-6
    names_ = named.select("name").distinct().withColumn("w", F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))).where("size(w) > 0")
    each = names_.select("name", F.size("w").alias("n"), F.explode("w").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("held")), "word")
    place = F.row_number().over(Window.partitionBy("name").orderBy("held", "word"))
    first = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(low) * F.col("n")) + 1).select("name", "n", "word")
    y = first.select(F.col("name").alias("other"), F.col("n").alias("m"), "word")
    fits = (F.col("name") < F.col("other")) & (F.least("n", "m") >= F.lit(low) * F.greatest("n", "m"))
    met = first.join(y, "word").where(fits).select("name", "other").distinct()
    return met.withColumn("score", F.round(names.similarity("name", "other"), 6)).where(F.col("score") >= least)
