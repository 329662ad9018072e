"""Document statistics and robust multivariate outliers.

`statistics` counts words, symbols, repeated lines and repeated five-word windows of every whole text.  `outliers` takes
a vector of four transformed statistics (logarithm of word length, logarithm of symbol share, roots of the shares of
repeated lines and words) and estimates, for every language and source, the centre and scatter of the `share` of the rows
whose scatter has the least determinant.  Several deterministic starts (medians and quartiles; mean and covariance; the
covariance of bounded scores) are followed by concentration steps, which refit to the rows nearest to the last fit,
each until its determinant stops falling; the start that ends with the least determinant wins.  A row is an outlier if
its Mahalanobis distance is beyond the quantile `level` of its chi-squared distribution.  Rows never gather: a step is
two aggregations with partial sums over one staged table of numbers, and the fits (some rows a group) are joined back.

The scatter is regularised alike at every size: it counts `PRIOR` rows of the scatter `FLOORS` besides its own, so that a
group of few rows has an estimate near to these values and a large one its own.  `FLOORS` are the least standard
deviations too: a statistic that is constant in most rows would make every other value an outlier.

Cases.  A null or empty text has no words and fails the base rule; null languages and sources are groups of their own; a
group of one row keeps it; repeated rows are judged alike; an empty table gives no rows.  Of `statistics` only the four
named columns are read; `outliers` returns the columns that it gets, whatever their names, and `outlier`,
which replaces one of that name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.work import dropped, quoted, small, staged, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 5
DIMENSIONS = 4
FLOORS = (0.06, 0.4, 0.2, 0.15)
PRIOR = 20
#: A fall of the determinant's logarithm that is worth another step.
FALL = 1e-3


def counted(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # of the words counted so far
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines)


def statistics(df: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS for every row of `df`."""

    def count(batches):
        for batch in batches:
            rows = [counted(t.as_py() or "") for t in batch.column(3)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *COUNTS])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list:
    """The transformed statistics; the constants pull short texts towards the middle."""
    n = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 250) / (n + 50)),
        F.log1p(100 * F.col("n_symbols") / (n + 20)),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    a, b = 0.0, 1000.0
    for _ in range(100):
        a, b = ((a + b) / 2, b) if chi2_cdf((a + b) / 2, k) < p else (a, (a + b) / 2)
    return a


def distance(x: str = "x"):
    """Squared Mahalanobis distance of `x` to centre under the inverse scatter, as one expression."""
    d = [F.col(x)[i] - F.col("centre")[i] for i in range(DIMENSIONS)]
    return sum((F.col("inverse")[i * DIMENSIONS + j] * d[i] * d[j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)), F.lit(0.0))


FIT = "grp string, start int, centre array<double>, inverse array<double>, logdet double"


def scatter(products, mean, rows: float, factor: float) -> np.ndarray:
    """The regularised scatter of `rows` rows from their mean products."""
    cov = (np.array(products, float).reshape(DIMENSIONS, DIMENSIONS) - np.outer(mean, mean)) * factor
    cov = (rows * cov + PRIOR * np.diag(np.square(FLOORS))) / (rows + PRIOR)
    return cov + np.diag(np.maximum(0, np.square(FLOORS) - np.diag(cov)))


def fits_of(moments: DataFrame, factor: float) -> DataFrame:
    """Fits from a number of rows, their mean deviations from `centre`, and mean products of these, in units of `unit`."""

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                mean, unit = np.array(r.means, float), np.array(r.unit, float)
                products = np.array(r.products, float).reshape(DIMENSIONS, DIMENSIONS) * np.outer(unit, unit)
                cov = scatter(products, mean * unit, r.n, factor)
                rows.append((r.grp, r.start, (np.array(r.centre, float) + mean * unit * r.moved).tolist(), np.linalg.inv(cov).ravel().tolist(), np.linalg.slogdet(cov)[1]))
            yield type(pdf)(rows, columns=["grp", "start", "centre", "inverse", "logdet"])

    return moments.mapInPandas(solve, FIT)


def moments(rows: DataFrame, values: list, centre, unit, start, moved: int, *keys: str) -> DataFrame:
    """Means and mean products of `values` by `keys`; a fit's centre moves by the means if `moved`."""
    return rows.groupBy(*keys).agg(
        start.alias("start") if start is not None else F.lit(0).alias("_"),
        F.count("*").alias("n"), centre.alias("centre"), unit.alias("unit"), F.lit(moved).alias("moved"), F.array(*[F.avg(a) for a in values]).alias("means"), F.array(*[F.avg(a * b) for a in values for b in values]).alias("products"),
    )


def estimates(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """grp, centre, inverse and logdet for every group of `rows` (grp, x; staged): the least determinant that the starts reach."""
    units = F.array(*[F.lit(1.0)] * DIMENSIONS)
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMENSIONS)])
    scale = F.array(*[F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(DIMENSIONS)])
    middle = staged(middle.select("grp", F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)]).alias("middle"), scale.alias("scale")), "middle")
    inverse = F.array(*[1 / (F.col("scale")[i] * F.col("scale")[i]) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)])
    quartiles = middle.select("grp", F.lit(0).alias("start"), F.col("middle").alias("centre"), inverse.alias("inverse"), F.lit(float("inf")).alias("logdet"))
    about = rows.join(small(middle), "grp")
    away = [F.col("x")[i] - F.col("middle")[i] for i in range(DIMENSIONS)]
    whole = moments(about, away, F.first("middle"), units, F.lit(1), 1, "grp")
    bounded = moments(about, [F.tanh(d / F.col("scale")[i]) for i, d in enumerate(away)], F.first("middle"), F.first("scale"), F.lit(2), 0, "grp")
    active = staged(quartiles.unionByName(fits_of(whole.unionByName(bounded), 1.0).withColumn("logdet", F.lit(float("inf")))), "fit")
    near = chi2_quantile(share, DIMENSIONS)
    factor = share / chi2_cdf(near, DIMENSIONS + 2)  # makes the trimmed covariance consistent for normal rows
    ended = [active.select("grp", "start", "centre", "inverse", "logdet").limit(0)]
    while active.limit(1).count():
        far = rows.join(small(active), "grp").select("grp", "start", "x", "centre", distance().alias("d2"))
        cut = staged(far.groupBy("grp", "start").agg(F.percentile_approx("d2", share, 1000).alias("cut")), "cut")
        near = far.join(small(cut), ["grp", "start"]).where("d2 <= cut")
        sums = moments(near, [F.col("x")[i] - F.col("centre")[i] for i in range(DIMENSIONS)], F.first("centre"), units, None, 1, "grp", "start").drop("_")
        old = active.select("grp", "start", F.struct("centre", "inverse", "logdet").alias("old"))
        stepped = staged(fits_of(sums, factor).join(old, ["grp", "start"]).withColumn("falls", F.col("logdet") < F.col("old.logdet") - FALL), "step")
        ended.append(stepped.where("not falls").select("grp", "start", "old.*"))
        dropped(active, cut)
        active = stepped.where("falls").select("grp", "start", "centre", "inverse", "logdet")
    every = ended[1] if len(ended) > 1 else ended[0]
    for x in ended[2:]:
        every = every.unionByName(x)
    best = every.groupBy("grp").agg(F.min(F.struct("logdet", "start", "centre", "inverse")).alias("fit"))
    return staged(best.select("grp", "fit.centre", "fit.inverse", "fit.logdet"), "fits")


def group_of(lang, source):
    """A name for each language and source; nulls have names of their own."""
    part = lambda p: F.coalesce(F.concat(F.length(p).cast("string"), F.lit("="), p), F.lit("-"))
    return F.concat(part(lang), part(source))


def outliers(stats: DataFrame, share: float = 0.75, level: float = 0.9999) -> DataFrame:
    """`stats` (staged, with lang, source, COUNTS and `base_failed`) with `outlier`, false where `base_failed`."""
    grp = group_of(F.col("lang"), F.col("source"))
    rows = staged(stats.where(~F.col("base_failed")).select(grp.alias("grp"), F.array(*vector()).alias("x")), "vectors")
    fits = estimates(rows, share)
    dropped(rows)
    packed = stats.select(F.struct(*[quoted(c) for c in stats.columns if c.lower() != "outlier"]).alias("row"), grp.alias("grp"), F.array(*vector()).alias("x"), "base_failed")
    beyond = distance() > chi2_quantile(level, DIMENSIONS)
    judged = packed.join(small(fits), "grp", "left").select("row", F.coalesce(~F.col("base_failed") & beyond, F.lit(False)).alias("outlier"))
    return judged.select("row.*", "outlier")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text of `documents`, the base rule, and the verdict of rule and outlier test together."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = staged(statistics(table(spark, sf_dir, "documents")).withColumn("base_failed", failed), "statistics")
    return outliers(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept")
    )
