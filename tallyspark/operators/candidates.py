"""Reading fields off a document's lines: candidates, the combination that the document's own arithmetic proves, what may be filled in.

A line's cells are parted by three blanks.  Each cell that holds a label of a field gives candidates: what follows in the
cell, the next cell, the cell below.  None is dropped early: `chosen` takes the first combination that satisfies an equation.
It has six candidates a field at most, and does not try their product: the sums of each half of an equation's fields meet in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import bound
from tallyspark.functions.names import simplify

#: Candidates of a field that an equation tries.
TRIED = 6
AMOUNT, DATE, TAX_ID, TEXT = "TUTAR", "TARIH", "VKN", "METIN"
#: Points of a candidate by where it stands; its label's length is added, five are taken for each token before it (ten for a line more below).
SAME, RIGHT, BELOW = 100, 95, 85


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    labels: tuple[str, ...]  # as `simplify` gives them


@dataclass(frozen=True)
class Equation:
    """The signed sum of `terms` is `target`; with `absolute`, up to its sign."""

    name: str
    terms: tuple[tuple[str, int], ...]
    target: str
    absolute: bool = False


def read_amount(x: str | Column, decimal: str) -> Column:
    """An amount in kurus, whatever else stands around its digits; null without any.

    Groups of thousands have three digits.  So a last group of one or two, after groups of three, is the fraction, whichever mark stands
    before it.  Otherwise `decimal` parts the fraction if it stands there once and digits follow; more than two are cut.
    """
    x = F.col(x) if isinstance(x, str) else x
    fraction = rf"^(?:\d{{1,3}}(?:[.,]\d{{3}})*[.,](?=\d{{1,2}}$)|[^{decimal}]*[{decimal}])(\d+)$"
    digits = lambda y: F.translate(y, ".,-", "")
    value = lambda t, part: digits(F.substring(t, F.lit(1), F.length(t) - F.when(part == "", 0).otherwise(F.length(part) + 1))).try_cast("decimal(18,0)") * 100 + F.rpad(F.substring(part, 1, 2), 2, "0").cast("int")
    number = lambda t: F.when(digits(t) != "", bound(F.regexp_extract(t, fraction, 1), lambda part: value(t, part)))
    signed = lambda marks, v: F.when(marks.startswith("-"), -v).otherwise(v).try_cast("bigint")
    return bound(F.regexp_replace(x, r"[^0-9.,\-]", ""), lambda marks: bound(bound(F.btrim(marks, F.lit("-")), number), lambda v: signed(marks, v)))


def read_date(x: str | Column) -> Column:
    """Eight digits, day first, to yyyymmdd; null unless the calendar has that day between 1900 and 2200."""
    iso = lambda d: F.concat(F.substring(d, 5, 4), F.lit("-"), F.substring(d, 3, 2), F.lit("-"), F.substring(d, 1, 2))
    known = bound(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\D", ""), lambda d: F.when(F.length(d) == 8, iso(d).try_cast("date")))
    return bound(known, lambda day: F.when(F.year(day).between(1900, 2200), F.date_format(day, "yyyyMMdd").cast("bigint")))


def typed(kind: Column, x: Column, decimal: str) -> Column:
    """What `x` says as a number of its kind; null for text and for what cannot be read."""
    digits = F.regexp_replace(x, r"\D", "")
    return F.when(kind == AMOUNT, read_amount(x, decimal)).when(kind == DATE, read_date(x)).when((kind == TAX_ID) & F.length(digits).isin(10, 11), digits.try_cast("bigint"))


def tokens(kind: Column, text: Column) -> Column:
    """Parts of `text` that have the form of `kind`, from left to right; numbers that a percent sign stands before or right behind are rates, not amounts."""
    return bound(text, lambda x: _tokens(kind, x))


def _tokens(kind: Column, text: Column) -> Column:
    plain = F.when(F.contains(text, F.lit("%")), F.regexp_replace(F.regexp_replace(text, "% +", "%"), r"[0-9](?:[0-9.,]*[0-9])?(?=%)", "")).otherwise(text)
    amounts = F.filter(F.regexp_extract_all(plain, F.lit(r"(%?[0-9](?:[0-9.,]*[0-9])?)"), 1), lambda t: ~t.startswith("%"))
    dates = F.filter(F.regexp_extract_all(text, F.lit(r"([0-9][0-9./\-]*)"), 1), lambda t: F.length(F.regexp_replace(t, r"\D", "")) == 8)
    ids = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{10,11})(?![0-9])"), 1)
    whole = F.filter(F.array(F.trim(text)), lambda t: t != "")
    found = F.when(kind == AMOUNT, amounts).when(kind == DATE, dates).when(kind == TAX_ID, ids).otherwise(whole)
    return F.coalesce(found, F.array().cast("array<string>"))


def _behind(cell: Column, label: Column) -> Column:
    """What follows the label's last word in the cell as it was written; null if nothing does."""
    last = F.substring_index(label, " ", -1)
    place = lambda words: F.array_position(F.transform(words, lambda w: F.endswith(simplify(w), last)), True)
    rest = lambda words, at: F.trim(F.regexp_replace(F.array_join(F.slice(words, at.cast("int") + 1, F.size(words)), ""), r"^[: .\-]+", ""))
    after = lambda words: bound(place(words), lambda at: F.when(at > 0, bound(rest(words, at), lambda r: F.when(r != "", r))))
    return bound(F.regexp_extract_all(cell, F.lit("([^ :]*[ :]|[^ :]+)"), 1), after)


def lines_of(texts: DataFrame) -> DataFrame:
    """`texts` (doc_id, text) to doc_id, line (from 0), text."""
    return texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line", "text"))


def candidates(lines: DataFrame, fields: list[Field]) -> DataFrame:
    """`lines` (doc_id, line, text) to the candidates of each field: doc_id, field, kind, place (1 is the best), value, strategy, line, score.

    A line meets the two below it in one shuffle by document and line.  Of a cell's labels the longest counts.  Equal values of a line that
    follow each other are one.
    """
    blank = r"^\s+|\s+$"
    cells = F.filter(F.transform(F.split("text", "   "), lambda c: F.regexp_replace(c, blank, "")), lambda c: c != "")
    near = lines.select("doc_id", "line", cells.alias("cells")).select("doc_id", "cells", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"), "line").withColumn("line", F.col("line") - F.col("k"))
    rows = near.groupBy("doc_id", "line").agg(*[F.max(F.when(F.col("k") == k, F.col("cells"))).alias(f"c{k}") for k in range(3)]).where("c0 is not null")
    step = F.when(F.size("c1") > 0, 1).when(F.col("c1").isNotNull() & (F.size("c2") > 0), 2)
    rows = rows.withColumn("step", step).withColumn("under", F.when(F.col("step") == 1, F.col("c1")).when(F.col("step") == 2, F.col("c2")))
    each = rows.select("doc_id", "line", "c0", "step", "under", F.posexplode("c0").alias("j", "cell")).withColumn("plain", simplify("cell"))
    met = []
    for f in fields:
        ranked = sorted(enumerate(f.labels), key=lambda x: (-len(x[1]), -x[0]))
        label = F.coalesce(*[F.when(F.contains("plain", F.lit(x)), F.lit(x)) for _, x in ranked])
        met.append(F.when(label.isNotNull(), F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), label.alias("label"))))
    # Generators keep empty rows, which go after them: Spark would else filter by the size of what it generates, and compute it once more for each mention.
    each = each.withColumn("m", F.explode_outer(F.array_compact(F.array(*met)))).where("m is not null").select("*", "m.*")
    own, right = _behind(F.col("cell"), F.col("label")), F.get("c0", F.col("j") + 1)
    below = F.coalesce(F.get("under", F.col("j")), F.get("under", F.lit(0)))
    long = F.length("label")
    made = lambda text, name, score: F.transform(tokens(F.col("kind"), text), lambda t, n: F.struct(t.alias("value"), F.lit(name).alias("strategy"), score(n).cast("int").alias("score")))
    found = F.concat(made(own, "same cell", lambda n: SAME + long - 5 * n), made(right, "next cell", lambda n: RIGHT + long - 5 * n), made(below, "below", lambda n: BELOW + long - 10 * (F.col("step") - 1)))
    out = each.select("doc_id", "field", "kind", "line", "j", F.posexplode_outer(found).alias("g", "c")).where("g is not null").select("doc_id", "field", "kind", "line", "j", "g", "c.*")
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), "line", "j", "g")
    again = F.lag(F.struct("value", "line")).over(order) == F.struct("value", "line")
    out = out.withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    return out.select("doc_id", "field", "kind", F.row_number().over(order).alias("place"), "value", "strategy", "line", "score")


def _sums(options: Column, base: Column) -> Column:
    """All sums of one value from each of `options` (pos, sign, numbers), with the rank of the choice: the first field varies fastest."""
    start = F.array(F.struct(base.alias("sum"), F.lit(0).cast("bigint").alias("rank")))
    add = lambda acc, o: F.flatten(F.transform(acc, lambda c: F.transform(o["numbers"], lambda v, i: F.struct((c["sum"] + o["sign"] * v).alias("sum"), (c["rank"] + i * F.pow(F.lit(TRIED), o["pos"]).cast("bigint")).alias("rank")))))
    return F.aggregate(options, start, add)


def chosen(found: DataFrame, equations: list[Equation], decimal: str) -> DataFrame:
    """`found` (of `candidates`) to doc_id, field, value: for each equation the first combination of candidates that satisfies it, its target not 0.

    The first candidate of the first field goes first, then the second one of it, and so on (the last field varies slowest).  Of two equations with a field, the later one
    decides.  An equation that no combination satisfies says nothing.
    """
    spark = found.sparkSession
    parts = [(e, pos, name, sign, pos == len(q.terms), q.absolute, len(q.terms) + 1) for e, q in enumerate(equations) for pos, (name, sign) in enumerate([*q.terms, (q.target, -1)])]
    rules = F.broadcast(spark.createDataFrame(parts, "equation int, pos int, field string, sign int, is_target boolean, absolute boolean, fields int"))  # a row for each field of a rule
    tried = found.where((F.col("place") <= TRIED) & F.col("field").isin(sorted({name for _, _, name, *_ in parts}))).select("doc_id", "field", "place", "value", read_amount("value", decimal).alias("number"))
    lists = tried.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("place", "number", "value")))).alias("all")).where(F.size("all") > 0)
    met = lists.join(rules, "field").groupBy("doc_id", "equation", "absolute", "fields").agg(F.array_sort(F.collect_list(F.struct("pos", "sign", F.col("all.number").alias("numbers"), "is_target"))).alias("o"))
    met = met.where(F.size("o") == F.col("fields")).withColumn("half", F.call_function("div", F.col("fields"), F.lit(2)).cast("int"))
    terms, target = F.filter("o", lambda o: ~o["is_target"]), F.element_at("o", -1)
    zero = F.lit(0).cast("bigint")
    first = met.select("doc_id", "equation", F.explode(_sums(F.filter(terms, lambda o: o["pos"] < F.col("half")), zero)).alias("c"))
    rest = met.select("doc_id", "equation", "absolute", target.alias("t"), F.explode(_sums(F.filter(terms, lambda o: o["pos"] >= F.col("half")), zero)).alias("c"))
    rest = rest.select("doc_id", "equation", "absolute", "c", "t.pos", F.posexplode("t.numbers").alias("i", "goal")).where("goal <> 0")
    ways = F.when(F.col("absolute"), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(-1)))
    rest = rest.select("doc_id", "equation", "c", F.col("i") * F.pow(F.lit(TRIED), "pos").cast("bigint") + F.col("c.rank"), "goal", F.explode(ways).alias("way")).toDF("doc_id", "equation", "c", "rank", "goal", "way")
    side = lambda df, total, rank: df.groupBy("doc_id", "equation", total.alias("sum")).agg(F.min(rank).alias("rank"))
    a, b = side(first, F.col("c.sum"), F.col("c.rank")), side(rest, -(F.col("c.sum") + F.col("way") * F.col("goal")), F.col("rank"))
    best = a.join(b, ["doc_id", "equation", "sum"]).groupBy("doc_id", "equation").agg(F.min(a["rank"] + b["rank"]).alias("rank"))
    pick = best.join(rules.select("equation", "pos", "field"), "equation").join(lists, ["doc_id", "field"])
    number = F.get("all", F.call_function("div", F.col("rank"), F.pow(F.lit(TRIED), "pos").cast("bigint")).cast("int") % TRIED)["number"]
    raw = F.get(F.filter("all", lambda x: x["number"] == number), F.lit(0))["value"]
    return pick.groupBy("doc_id", "field").agg(F.max_by(raw, "equation").alias("value"))


def findings(values: DataFrame, equations: list[Equation]) -> DataFrame:
    """`values` (doc_id, field, number) of all documents to doc_id, equation, code, difference_kr: A00 holds, A21 does not, A20 cannot be told, as a field is missing.

    Each term and the target may be off by a kurus, two at least.
    """
    spark = values.sparkSession
    parts = [(e, q.name, name, sign, q.absolute, len(q.terms) + 1) for e, q in enumerate(equations) for name, sign in [*q.terms, (q.target, 0)]]
    rules = F.broadcast(spark.createDataFrame(parts, "e int, equation string, field string, sign int, absolute boolean, fields int"))
    names = F.broadcast(rules.select("e", "equation", "absolute", "fields").distinct())
    sums = values.where("number is not null").join(rules, "field").groupBy("doc_id", "e").agg(F.count("*").alias("got"), F.sum(F.col("sign") * F.col("number")).alias("left"), F.max(F.when(F.col("sign") == 0, F.col("number"))).alias("goal"))
    every = values.select("doc_id").distinct().withColumn("e", F.explode(F.array(*[F.lit(e) for e in range(len(equations))])))
    out = every.join(sums, ["doc_id", "e"], "left").join(names, "e")
    off = F.when(F.col("absolute"), F.abs("left") - F.abs("goal")).otherwise(F.col("left") - F.col("goal"))
    code = F.when(F.coalesce("got", F.lit(0)) < F.col("fields"), "A20").when(F.abs(off) > F.greatest(F.col("fields"), F.lit(2)), "A21").otherwise("A00")
    return out.select("doc_id", "equation", code.alias("code"), F.when(code != "A20", off).alias("difference_kr"))


def filled(found: DataFrame, equations: list[Equation], decimal: str) -> DataFrame:
    """What is filled in without a question: doc_id, field, value, number, candidates, filled, approved.

    A field has the value that an equation chose, or its best candidate.  All is filled in if the document has equations
    and all of them hold; else nothing is (`value` and `number` are null then).  A filled field is approved if it is part of an equation or all its candidates say the same.
    """
    said = F.coalesce(typed(F.col("kind"), F.col("value"), decimal).cast("string"), simplify("value"))
    best = found.groupBy("doc_id", "field", "kind").agg(F.min_by("value", "place").alias("first"), F.count_distinct(bound(said, lambda x: F.when(x != "", x))).alias("candidates"))
    picked = chosen(found, equations, decimal)
    at = best.join(picked.withColumnRenamed("value", "proved"), ["doc_id", "field"], "left").withColumn("value", F.coalesce("proved", "first"))
    at = at.withColumn("number", typed(F.col("kind"), F.col("value"), decimal))
    holds = findings(at, equations).groupBy("doc_id").agg((F.count_if(F.col("code") != "A00") == 0).alias("holds")) if equations else at.select("doc_id").distinct().withColumn("holds", F.lit(False))
    part = F.col("field").isin([x for q in equations for x in [*(t for t, _ in q.terms), q.target]])
    able = F.col("number").isNotNull() | (F.col("kind") == TEXT)
    out = at.join(holds, "doc_id").withColumn("filled", F.col("holds") & able)
    return out.select("doc_id", "field", F.when(F.col("filled"), F.col("value")).alias("value"), F.when(F.col("filled"), F.col("number")).alias("number"), F.greatest("candidates", F.lit(1)).cast("long").alias("candidates"), "filled", (F.col("filled") & (part | (F.col("candidates") <= 1))).alias("approved"))
