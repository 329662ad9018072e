"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule decides.

Two variable-order Markov models over a fixed alphabet of `SYMBOLS` are estimated from the URLs that the rules allow and
block: counts of all strings of one to `ORDER` symbols, interpolated from the longest context down (Witten-Bell), so a
context counts as far as it has been seen.  A URL's score is its mean log-likelihood difference per symbol.  The cut is
calibrated on the fifth of the ruled URLs that the models have not seen, where the two error rates are least together.

Counts are Spark aggregations over all URLs.  Their result has at most SYMBOLS ** ORDER rows whatever the input, as has
the table of ratios that every task gets (4 bytes each, 11 MB), which is why it may be broadcast.

Cases.  A null URL, or one without `://`, has an empty host and path, matches no rule and scores 0; it is judged by the
cut like any other.  A path that is empty starts with no rule's path.  Without URLs that a rule allows, or without any
that a rule blocks, there is no ratio: every score and the cut are 0 and undecided URLs are allowed.  Repeated rows are
counted and judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyspark.llm.work import table, with_column

#: Symbol 0 stands before the URL, 1 for any character that is not listed; letters are folded.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
SYMBOLS = len(ALPHABET) + 2
ORDER = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits `host` and `path`, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


_CODES = np.ones(128, np.uint8)  # 1 for all that is not listed
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i + 2


def symbols(url: str | None) -> np.ndarray:
    """Symbols of what follows `://`, behind ORDER - 1 marks of the beginning."""
    rest = (url or "").partition("://")[2]
    points = np.frombuffer(rest.encode("utf-32-le", "replace"), "<u4")
    return np.concatenate([np.zeros(ORDER - 1, np.int64), _CODES[np.minimum(points, 127)]])


def grams(url: str | None) -> np.ndarray:
    """The number of each string of ORDER symbols that ends at a character."""
    s = symbols(url)
    n = len(s) - ORDER + 1
    return sum(s[k : k + n] * SYMBOLS ** (ORDER - 1 - k) for k in range(ORDER)).astype(np.int64) if n > 0 else np.zeros(0, np.int64)


def _count(batches):
    for batch in batches:
        all_grams = [grams(u.as_py()) for u in batch.column(0)]
        allowed = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), [len(g) for g in all_grams])
        g, n = np.unique(np.concatenate([np.zeros(0, np.int64), *all_grams]) * 2 + allowed, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g // 2), pa.array(g % 2 == 1), pa.array(n)], ["gram", "allowed", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(last symbol | those before it), from counts of strings of ORDER symbols, as an array of that shape."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(1, ORDER + 1):  # strings of k symbols: context of k - 1
        c = counts.reshape(-1, SYMBOLS**k).sum(axis=0).reshape(-1, SYMBOLS).astype(float)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.broadcast_to(p, (SYMBOLS, *p.shape)).reshape(c.shape) if k > 1 else p[None, :]
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower).reshape([SYMBOLS] * k)
    return np.log(p).ravel()


def scores(urls, ratios: np.ndarray | None) -> np.ndarray:
    if ratios is None:
        return np.zeros(len(urls))
    found = [grams(u.as_py()) for u in urls]
    return np.array([ratios[g].mean(dtype=float) if len(g) else 0.0 for g in found])


def with_ratio(df: DataFrame, cells: int = 400) -> tuple[DataFrame, float]:
    """`df` (url, verdict or null) with `score` (which replaces one of that name), and the calibrated cut."""
    spark, df = df.sparkSession, df.drop("score")
    known = df.where("verdict is not null").select("url", (F.col("verdict") == "allow").alias("allowed"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("aside"))
    counted = known.where("not aside").select("url", "allowed").mapInArrow(_count, "gram long, allowed boolean, n long").groupBy("gram", "allowed").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # 2 * SYMBOLS ** ORDER rows at most
    ratios = None
    if found["allowed"].nunique() == 2:
        both = []
        for allowed in (True, False):
            part, counts = found[found["allowed"] == allowed], np.zeros(SYMBOLS**ORDER, np.int64)
            counts[part["gram"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
            both.append(log_probabilities(counts))
        ratios = (both[0] - both[1]).astype(np.float32)
    shared = spark.sparkContext.broadcast(ratios)

    def scored(d: DataFrame) -> DataFrame:
        at = d.columns.index("url")
        return with_column(d, lambda batches: ((b, pa.array(scores(b.column(at), shared.value))) for b in batches), "score", DoubleType())

    cut = 0.0
    if ratios is not None:
        calibration = known.where("aside")
        cell = F.least(F.greatest(F.floor(F.col("score") * cells / 8), F.lit(-cells)), F.lit(cells))  # scores from -8 to 8
        histogram = scored(calibration).groupBy(cell.alias("cell"), "allowed").count().toPandas()
        if histogram["allowed"].nunique() == 2:
            h = histogram.pivot_table("count", "cell", "allowed", "sum", 0).sort_index()
            edges = np.append(h.index.to_numpy(float), h.index.max() + 1) * 8 / cells
            wrong = np.append(0, h[True].cumsum()) / h[True].sum() + 1 - np.append(0, h[False].cumsum()) / h[False].sum()
            best = edges[np.flatnonzero(wrong <= wrong.min() + 1e-12)]
            cut = float((best.min() + best.max()) / 2)
    return scored(df), cut


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; the language models' verdict where no rule fits, with its score and cut."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("fit", ruled())
    scored, cut = with_ratio(pages.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict")))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score"), F.lit(cut).alias("cut"))
