"""What the columns of a printed table mean, parties by the names on a document, and rules that feedback retires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.grammar import english_stems, phrase_stems
from tallyspark.functions.names import simplify
from tallyspark.operators import terms
from tallyspark.operators.documents import CONFUSED, wilson
from tallyspark.operators.running import ranged, running
from tallyspark.sources.scratch import written

#: Meanings of columns and the words for them, each in its natural spelling.
MEANINGS = {
    "BIRIM": ["birim", "ölçü", "unit"], "BIRIM_FIYAT": ["birim fiyat", "fiyat", "unit price", "price"], "ISKONTO": ["iskonto", "indirim", "discount"], "KDV_ORANI": ["kdv", "kdv oranı", "vat rate"], "KDV_TUTARI": ["kdv tutarı", "vat amount"],
    "MAL_ADI": ["cins", "mal hizmet", "açıklama", "description", "item"], "MIKTAR": ["miktar", "adet", "quantity", "qty"], "SIRA": ["sıra", "sıra no", "no"], "TUTAR": ["tutar", "toplam", "amount", "total"],
}


def spellings(heading: str | Column) -> Column:
    """A heading as it is and with the stems of its last word, simplified, between blanks.

    Stems are found in the spelling as it is, since vowels without their marks are out of harmony.
    """
    x = F.col(heading) if isinstance(heading, str) else heading
    plain = lambda xs: F.transform(xs, lambda s: F.concat(F.lit(" "), simplify(s), F.lit(" ")))
    return F.array_distinct(F.concat(plain(F.array(x)), plain(phrase_stems(x)), plain(phrase_stems(x, english_stems))))


def meaning(found: Column, meanings: dict[str, list[str]] = MEANINGS) -> Column:
    """What `found` (of `spellings`) means: by the longest word or phrase of `meanings` that one of them holds as whole words; empty if none."""
    known = sorted([(m, t) for m, ts in sorted(meanings.items()) for t in ts], key=lambda k: -len(k[1]))
    return F.coalesce(*[F.when(F.exists(found, lambda s: F.contains(s, F.concat(F.lit(" "), simplify(F.lit(t)), F.lit(" ")))), F.lit(m)) for m, t in known], F.lit(""))


def column_names(cells: DataFrame, meanings: dict[str, list[str]] = MEANINGS) -> DataFrame:
    """`cells` (doc_id, line, j, text) to the columns of each document's heading: doc_id, line, j, raw, meaning.

    A heading has three cells or more, none a number, two or more with a meaning and no meaning twice; the one with most meanings wins, of equals the upper one.
    Only texts of lines that may be headings are looked up, each different one once.  Lines are never sent to all tasks: Spark takes cells made by `explode`
    for as many bytes as the rows they came from, and would broadcast them.
    """
    digits, letters = F.regexp_replace("text", "[^0-9]", ""), F.regexp_replace("text", r"[^\p{L}]", "")
    line = Window.partitionBy("doc_id", "line")
    shaped = cells.where("doc_id is not null and line is not null").withColumn("cells", F.count("*").over(line)).withColumn("number", F.bool_or((digits != "") & (F.length(letters) <= 2)).over(line))
    able = written(shaped.where("cells >= 3 and not number").select("doc_id", "line", "j", "text"), "cells")
    texts = written(able.select("text").distinct().withColumn("found", spellings("text")), "spellings")
    rows = able.join(texts.select("text", meaning(F.col("found"), meanings).alias("meaning")), "text")
    told = F.when(F.col("meaning") != "", F.col("meaning"))
    lines = rows.groupBy("doc_id", "line").agg(F.count(told).alias("told"), F.count_distinct(told).alias("different"))
    best = lines.where("told >= 2 and told = different").groupBy("doc_id").agg(F.max_by("line", F.struct("told", -F.col("line"))).alias("line"))
    return rows.join(best.hint("merge"), ["doc_id", "line"]).select("doc_id", "line", "j", F.trim("text").alias("raw"), "meaning")


#: A distance counts as near up to the first share of the name's length; the best must be better than the next by the second.
NEAR, APART = 0.25, 0.15
_CLASSES = "".join(min(s) for s in CONFUSED for _ in sorted(s)), "".join(x for s in CONFUSED for x in sorted(s))


def _look(x: Column) -> Column:
    """`x` with confusable letters as one."""
    return F.translate(x, _CLASSES[1], _CLASSES[0])


def party_match(read: DataFrame, parties: DataFrame) -> DataFrame:
    """`read` (id, text) against the closed set of `parties` (name): id, decision (TEK, BELIRSIZ, YOK), tier, party, candidates.

    Tiers, each only for what the ones before it did not find: SADE the same but for accents and marks; MASKE each letter of the same class of
    confusable ones; ONEK one begins the other at the end of a word, with five letters and half of its length at least; UZAKLIK near by weighted
    distance.  Several parties on the tier that finds one are never chosen from.
    """
    seen = written(read.select("id", simplify("text").alias("o")), "read")
    able = seen.where(F.length(F.regexp_replace("o", " ", "")) >= 2)
    names_ = written(parties.select("name").distinct().withColumn("p", simplify("name")).where("p <> ''"), "parties")
    asked = written(able.select("o").distinct(), "asked")
    starts = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda n: F.array_join(F.slice(F.split(c, " "), F.lit(1), n), " ")), lambda x: (F.length(x) >= 5) & (x != F.col(c)) & (2 * F.length(x) >= F.length(c)))

    def same(left):
        return left.join(names_, left["o"] == names_["p"]).select("o", "name")

    def mask(left):
        x, y = left.withColumn("k", _look(F.col("o"))), names_.withColumn("k", _look(F.col("p")))
        return x.join(y, "k").select("o", "name")

    def prefix(left):
        longer = left.join(names_.select("name", F.explode(starts("p")).alias("o")), "o").select("o", "name")
        shorter = left.select("o", F.explode(starts("o")).alias("p")).join(names_, "p").select("o", "name")
        return longer.unionByName(shorter).distinct()

    def near(left):
        reach = F.length("o")
        met = terms.near_words(left.select(F.col("o").alias("form"), ((NEAR + APART) * reach).alias("limit")), names_.select(F.col("p").alias("word")).distinct())
        met = met.join(names_, met["word"] == names_["p"]).select(F.col("form").alias("o"), "name", F.round("distance", 6).alias("distance"))
        best = met.groupBy("o").agg(F.min("distance").alias("best")).where(F.col("best") <= NEAR * F.length("o") + 1e-9)
        return met.join(best, "o").where((F.col("distance") == F.col("best")) | (F.col("distance") - F.col("best") < APART * F.length("o") - 1e-9)).select("o", "name")

    left, found = asked, None
    for name, tier in (("SADE", same), ("MASKE", mask), ("ONEK", prefix), ("UZAKLIK", near)):
        one = written(tier(left).groupBy("o").agg(F.array_sort(F.collect_set("name")).alias("c")).withColumn("tier", F.lit(name)), "tier")
        found = one if found is None else found.unionByName(one)
        left = written(left.join(one, "o", "left_anti"), "left")
    out = seen.join(found, "o", "left")
    single = F.size("c") == 1
    return out.select("id", F.when(F.col("c").isNull(), "YOK").when(single, "TEK").otherwise("BELIRSIZ").alias("decision"), "tier", F.when(single, F.col("c")[0]).alias("party"), F.when(F.size("c") > 1, F.col("c")).alias("candidates"))


#: A rule under this bound, with three trials or more, is retired when it is wrong.
RETIRED_UNDER, LEAST_TRIALS = 0.20, 3


def rule_states(events: DataFrame) -> DataFrame:
    """`events` (rule, seq, right, made) of learnt rules, right ones and wrong ones with what the rule made, to each rule's state: rule, hits, trials, confidence, state (AKTIF, EMEKLI), retired_at, counterexample.

    Confidence is the lower Wilson bound.  The first wrong event at which it is under `RETIRED_UNDER` with `LEAST_TRIALS` trials retires a rule for good: it is kept, so that
    the same error is not learnt again, and what comes after does not count.  So the running counts up to the first such event are all that matters, and a rule with any
    share of all events is counted in ranges.
    """
    counts = {"hits": (F.sum, F.col("right").cast("bigint")), "trials": (F.sum, F.lit(1).cast("bigint"))}
    rows = written(running(ranged(events, ["rule"], ["seq"]), ["rule"], ["seq"], counts).withColumn("bound", wilson("hits", "trials")), "counts")
    fallen = ~F.col("right") & (F.col("trials") >= LEAST_TRIALS) & (F.col("bound") < RETIRED_UNDER)
    first = rows.where(fallen).groupBy("rule").agg(F.min("seq").alias("retired_at"))
    upto = rows.join(first, "rule", "left").where("retired_at is null or seq <= retired_at")
    last = upto.groupBy("rule").agg(F.max(F.struct("seq", "hits", "trials", "bound", "retired_at")).alias("x"), F.max(F.when(~F.col("right"), F.struct("seq", F.substring("made", 1, 120).alias("made")))).alias("wrong"))
    return last.select("rule", "x.hits", "x.trials", F.round("x.bound", 6).alias("confidence"), F.when(F.col("x.retired_at").isNotNull(), "EMEKLI").otherwise("AKTIF").alias("state"), "x.retired_at", F.col("wrong.made").alias("counterexample"))


def dirty_rules(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Where rules decay: of `states` and `rules` (rule, strategy, field), for each strategy and field: retired, active, share of retired in percent, mean confidence."""
    met = states.join(rules, "rule")
    gone = F.count_if(F.col("state") == "EMEKLI")
    return met.groupBy("strategy", "field").agg(gone.alias("retired"), F.count_if(F.col("state") != "EMEKLI").alias("active"), F.round(100.0 * gone / F.count("*"), 1).alias("decay"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
