"""Pages as positioned words: lines, bands, columns, cells, and the values that labels point to.

`words` are doc_id, page, k (the word's place on its page as it was read), text, x0, y0, x1, y1 with y downwards, as
`documents.positioned` gives them.  Words without text or without a position are left out; a page without words has no lines.
Distances are told in heights of the words at hand, never in points.  A printed page is one task's work and streams through
it; a line is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tallyspark.functions.money import bound
from tallyspark.functions.names import simplify

#: A word is of the line whose middle is within this share of its height, or within so many points; wider gaps than `WIDE`
#: heights part columns in a line's text.
NEAR, LEAST, WIDE = 0.6, 2.0, 0.9
#: A band ends at a gap of so many median gaps between lines, a column at one of so many median heights, from four words on.
BAND, COLUMN, ENOUGH = 1.8, 1.2, 4
RIGHT, BELOW = "SAGINDA", "ALTINDA"
_PAGE = ["doc_id", "page"]


_WORD = ["x0", "m", "k", "x1", "height", "text"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of words: words come page by page from top to bottom, and a line's middle is the mean of its words so far.

    A line goes out when the next one begins; what is held is the line at hand and one batch.
    """
    total, n, line = 0.0, 0, 0
    held: list[pa.RecordBatch] = []  # of the line at hand, whose number is `line`

    def made(rows: list[pa.RecordBatch], begins: list[int], numbers: list[int]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: pa.concat_arrays(t.column(c).chunks)
        ends = np.array([*begins, t.num_rows], dtype=np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([column(c) for c in _WORD], names=_WORD))
        y = np.add.reduceat(column("middle").to_numpy(), ends[:-1]) / np.diff(ends)
        at = pa.array(ends[:-1])
        return pa.RecordBatch.from_arrays([*(column(c).take(at) for c in _PAGE), pa.array(numbers, pa.int64()), pa.array(y), words], names=[*_PAGE, "line", "y", "words"])

    for b in batches:
        begins, numbers = [], []
        current = line
        seen = zip(*(b.column(c).to_pylist() for c in ("first", "middle", "reach")), strict=True)
        for i, (first, middle, reach) in enumerate(seen):
            if first or abs(total / n - middle) > reach:
                total, n, line = middle, 1, 1 if first else line + 1
                begins.append(i)
                numbers.append(line)
            else:
                total, n = total + middle, n + 1
        if not begins:
            held.append(b)
            continue
        before = sum(h.num_rows for h in held)
        rows = [*held, b.slice(0, begins[-1])]
        starts = [*([0] if before + begins[0] else []), *(before + i for i in begins[:-1])]
        if before + begins[-1]:
            yield made(rows, starts, [*([current] if before + begins[0] else []), *numbers[:-1]])
        held = [b.slice(begins[-1])]
    if held and sum(h.num_rows for h in held):
        yield made(held, [0], [line])


def lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line (from 1), y (mean of the middles), words (from left to right: x0, x1, height, text), text.

    The mean depends on the order of words, so a page is read in order by a fold that keeps three numbers and the line at hand; the
    window before it sorts and tells where pages begin.  Words are shuffled once, and leave the fold as lines.  A line's text has three blanks for a wide gap, one for a narrow one, none for none.
    """
    c = F.col
    corners = ("x0", "y0", "x1", "y1")
    placed = words.where(F.trim("text") != "")
    for x in corners:
        placed = placed.where(c(x).isNotNull() & ~F.isnan(x))
    rows = placed.select(*_PAGE, "k", "text", "x0", "x1", ((c("y0") + c("y1")) / 2).alias("middle"), F.abs(c("y1") - c("y0")).alias("height"))
    w = Window.partitionBy(*_PAGE).orderBy(c("middle").cast("int"), c("x0").cast("int"), "k")
    rows = rows.withColumn("reach", F.greatest(NEAR * c("height"), F.lit(LEAST))).withColumn("first", F.row_number().over(w) == 1)
    rows = rows.withColumn("m", c("middle").cast("int"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    word = StructType([StructField(x, kinds[x]) for x in _WORD])
    read = rows.mapInArrow(_fold, StructType([*(StructField(x, kinds[x]) for x in _PAGE), StructField("line", LongType()), StructField("y", DoubleType()), StructField("words", ArrayType(word))]))
    out = read.withColumn("words", F.sort_array("words"))
    gap = lambda x, i: x["x0"] - F.get("words", i - 1)["x1"]
    blank = lambda x, i: F.when(i == 0, "").when(gap(x, i) > WIDE * x["height"], "   ").when(gap(x, i) > 0.5, " ").otherwise("")
    return out.withColumn("text", F.array_join(F.transform("words", lambda x, i: F.concat(blank(x, i), x["text"])), ""))


def _upper_median(value: Column, keys: list[str]) -> Column:
    """Of the values that are not null, over each key's rows: the middle one, of two the larger."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value.asc_nulls_last()))
    n = F.count(value).over(Window.partitionBy(*keys))
    return rank == F.floor(n / 2) + 1


def bands(page_lines: DataFrame) -> DataFrame:
    """`lines` with the band of each (from 0): blocks of a page that a gap of more than `BAND` median gaps parts."""
    order, page = Window.partitionBy(*_PAGE).orderBy("line"), Window.partitionBy(*_PAGE)
    out = page_lines.withColumn("gap", F.abs(F.col("y") - F.lag("y").over(order))).withColumn("apart", F.when(F.col("gap") > 0, F.col("gap")))
    out = out.withColumn("middle_one", _upper_median(F.col("apart"), _PAGE)).withColumn("usual", F.max(F.when(F.col("middle_one"), F.col("apart"))).over(page))
    cut = F.coalesce((F.col("gap") > BAND * F.col("usual")).cast("long"), F.lit(0))
    return out.withColumn("cut", cut).withColumn("band", F.sum("cut").over(order)).drop("gap", "apart", "middle_one", "usual", "cut")


def corridors(banded: DataFrame) -> DataFrame:
    """doc_id, page, band, corridors: the middles of the vertical strips that no word of the band enters.

    A band has at most its width through its height of them, so they are an array.  Bands of fewer than four words have none.
    """
    keys = [*_PAGE, "band"]
    each = banded.select(*keys, F.explode("words").alias("w")).select(*keys, "w.x0", "w.x1", "w.height")
    each = each.withColumn("middle_one", _upper_median(F.col("height"), keys)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    each = each.withColumn("usual", F.max(F.when(F.col("middle_one"), F.col("height"))).over(Window.partitionBy(*keys)))
    reached = F.max("x1").over(Window.partitionBy(*keys).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("reached", reached).where((F.col("n") >= ENOUGH) & (F.col("x0") - F.col("reached") >= COLUMN * F.greatest("usual", F.lit(1.0))))
    return each.groupBy(*keys).agg(F.collect_list((F.col("reached") + F.col("x0")) / 2).alias("corridors"))


def grid(page_lines: DataFrame) -> DataFrame:
    """Cells of each line: doc_id, page, line, band, cell (from 0), text.

    A corridor of the band parts two neighbours only if it runs between them, so that a heading over a table stays whole.
    """
    rows = bands(page_lines)
    # Corridors come back as one map for each page: rows and words lie by page already, and neither is shuffled again.
    of_page = corridors(rows).groupBy(*_PAGE).agg(F.map_from_entries(F.collect_list(F.struct("band", "corridors"))).alias("of_band"))
    met = rows.join(of_page.hint("merge"), _PAGE, "left").withColumn("corridors", F.coalesce(F.try_element_at("of_band", "band"), F.array().cast("array<double>")))
    parted = lambda x, i: (i == 0) | F.exists("corridors", lambda at: (at > F.get("words", i - 1)["x1"]) & (at < x["x0"]))
    starts = F.filter(F.transform("words", lambda x, i: F.when(parted(x, i), i + 1)), lambda i: i.isNotNull())
    met = met.withColumn("starts", starts)
    until = lambda j: F.coalesce(F.get("starts", j + 1), F.size("words") + 1)
    cell = F.transform("starts", lambda s, j: F.array_join(F.transform(F.slice("words", s, until(j) - s), lambda x: x["text"]), " "))
    return met.select(*_PAGE, "line", "band", F.posexplode(cell).alias("cell", "text"))


def label_values(page_lines: DataFrame, labels: list[str]) -> DataFrame:
    """What stands right of a label or below it: doc_id, label, place (1 is nearest), value, relation, distance.

    `labels` are a parameter, as `simplify` gives them.  A label is where a line's simplified text contains it, and ends with the
    line's last word that is a part of it (marks such as a colon are).  Right of it are the words beyond its end; below it, words
    of the next line, the next page's first one after a page's last, that overlap it from two of its heights before to twelve
    behind.  Words of more than twice its height are headings, never values.  Ties: page, line, right before below.
    """
    c = F.col
    known = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    following = F.lead(F.struct("y", "words")).over(Window.partitionBy("doc_id").orderBy("page", "line"))
    rows = page_lines.where(c("doc_id").isNotNull() & c("page").isNotNull()).select(*_PAGE, "line", "y", "words", "text", following.alias("under"))
    # Generators keep empty rows, which go after them: Spark would else filter by what they generate and compute it again for each mention.
    hits = rows.withColumn("label", F.explode_outer(bound(simplify("text"), lambda plain: F.filter(known, lambda x: F.contains(plain, x))))).where("label is not null")
    met = hits.withColumn("end", F.explode_outer(F.slice(F.filter("words", lambda x: F.contains(c("label"), simplify(x["text"]))), F.lit(-1), F.lit(1)))).where("end is not null")
    low = lambda x: x["height"] <= 2 * c("end.height")
    right = F.filter("words", lambda x: (x["x0"] > c("end.x1") + 1) & low(x))
    below = F.filter("under.words", lambda x: (x["x1"] > c("end.x0") - 2 * c("end.height")) & (x["x0"] < c("end.x1") + 12 * c("end.height")) & low(x))
    said = lambda ws: F.array_join(F.transform(ws, lambda x: x["text"]), " ")
    found = F.array(
        F.when(F.size(right) > 0, F.struct(said(right).alias("value"), F.lit(RIGHT).alias("relation"), (F.get(right, 0)["x0"] - c("end.x1")).alias("distance"))),
        F.when(F.size(below) > 0, F.struct(said(below).alias("value"), F.lit(BELOW).alias("relation"), F.abs(c("under.y") - c("y")).alias("distance"))),
    )
    out = met.select("doc_id", "page", "line", "label", F.explode_outer(F.array_compact(found)).alias("v")).where("v is not null").select("*", "v.*")
    order = Window.partitionBy("doc_id", "label").orderBy("distance", "page", "line", F.desc("relation"))
    return out.select("doc_id", "label", F.row_number().over(order).alias("place"), "value", "relation", "distance")
