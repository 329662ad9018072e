"""Stems, headings, parties and rules: literal cases and loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import grammar
from tallyspark.functions.names import simplify
from tallyspark.operators import documents, headings
from tallyspark.plans import reading

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "word, has, lacks",
    [
        ("tutarları", {"tutarlar", "tutar"}, set()), ("MİKTARLARI", {"miktar"}, set()), ("CİNSİ", {"cins"}, set()), ("fiyatı", {"fiyat"}, set()), ("kitabı", {"kitab", "kitap"}, set()), ("tutari", {"tutari"}, {"tutar"}), ("masası", {"masa"}, set()),
        ("evden", {"evden"}, {"ev"}), ("bankadan", {"banka"}, set()), ("hesabın", {"hesab", "hesap"}, set()), ("Tarih", {"tarih"}, set()), ("kasa", {"kasa"}, {"kas"}), ("", {""}, set()), ("ürünler", {"ürün"}, set()), ("ürünlar", {"ürünlar"}, {"ürün"}),
    ],
)
def test_turkish_stems(spark, word, has, lacks):
    got = set(spark.range(1).select(grammar.turkish_stems(F.lit(word)).alias("s")).first()[0])
    assert has <= got and not lacks & got


def test_english_stems(spark):
    get = lambda w: set(spark.range(1).select(grammar.english_stems(F.lit(w)).alias("s")).first()[0])
    assert "price" in get("Prices") and "quantity" in get("Quantities") and "supplier" in get("supplier's") and get("gross") == {"gross"} and "tax" in get("taxes")
    assert spark.range(1).select(grammar.phrase_stems(F.lit(" BİRİM  FİYATI ")).alias("s")).first()[0][-1] == "BİRİM fiyat"


def test_meanings(spark):
    rows = [("MİKTARLARI", "MIKTAR"), ("BİRİM FİYATI", "BIRIM_FIYAT"), ("Birimi", "BIRIM"), ("KDV Oranı", "KDV_ORANI"), ("KDV Tutarı", "KDV_TUTARI"), ("SAYIN", ""), ("Unit Prices", "BIRIM_FIYAT"), ("", ""), ("Toplam Tutar", "TUTAR"), ("Nosu", "")]
    df = spark.createDataFrame(rows, "x string, want string").withColumn("found", headings.spellings("x")).withColumn("got", headings.meaning(F.col("found")))
    assert [(r.x, r.got) for r in df.collect()] == rows
    assert spark.range(1).select(simplify(F.lit("ÖRNEK TİCARET A.Ş."))).first()[0] == "ornek ticaret a s"


def test_heading_of_a_table(spark):
    page = [["SAYIN", "x", "y"], ["TUTAR", "TUTARI", "MİKTAR"], ["SIRA", "MİKTAR"], ["2026", "MİKTAR", "TUTAR"], ["SIRA", "CİNSİ", "Notlar"], ["No", "Description", "Qty"], ["Miktar", "Tutar", "Birim"]]
    cells = [(1, i, j, t) for i, line in enumerate(page) for j, t in enumerate(line)] + [(2, 0, j, t) for j, t in enumerate(["a", "b", "c"])]
    df = spark.createDataFrame(cells, "doc_id long, line int, j int, text string")
    got = headings.column_names(df).orderBy("j").collect()
    assert [(r.doc_id, r.line, r.raw, r.meaning) for r in got] == [(1, 5, "No", "SIRA"), (1, 5, "Description", "MAL_ADI"), (1, 5, "Qty", "MIKTAR")]
    assert headings.column_names(df.limit(0)).count() == 0


def searched(text, names, plain):
    """Tier by tier over the whole set."""
    o = plain[text]
    if len(o.replace(" ", "")) < 2:
        return "YOK", None, set()
    alike = lambda a, b: a == b or any(a in s and b in s for s in documents.CONFUSED)
    begins = lambda a, b: len(a) < len(b) and b.startswith(a + " ") and len(a) >= 5 and 2 * len(a) >= len(b)
    for tier, test in (("SADE", lambda p: p == o), ("MASKE", lambda p: len(p) == len(o) and all(map(alike, p, o))), ("ONEK", lambda p: begins(o, p) or begins(p, o))):
        hit = {n for n in names if test(plain[n])}
        if hit:
            return "TEK" if len(hit) == 1 else "BELIRSIZ", tier, hit
    scored = sorted((documents.distance(o, plain[n]), n) for n in names)
    if not scored or scored[0][0] > 0.25 * len(o) + 1e-9:
        return "YOK", None, set()
    hit = {n for d, n in scored if d == scored[0][0] or d - scored[0][0] < 0.15 * len(o) - 1e-9}
    return "TEK" if len(hit) == 1 else "BELIRSIZ", "UZAKLIK", hit


def matches(spark, read, parties):
    names = sorted({r.name for r in parties.select("name").distinct().collect()})
    texts = [r.text for r in read.select("text").distinct().collect()]
    plain = {r.x: r.p for r in spark.createDataFrame([(x,) for x in {*names, *texts}], "x string").select("x", simplify("x").alias("p")).collect()}
    names = [n for n in names if plain[n]]
    want = {t: searched(t, names, plain) for t in texts}
    seen = set()
    for r in headings.party_match(read, parties).collect():
        decision, tier, hit = want[r.text_] if hasattr(r, "text_") else want[dict(read.collect())[r.id]]
        assert (r.decision, r.tier) == (decision, tier), (r, want)
        assert {r.party} == hit if decision == "TEK" else (set(r.candidates or []) == hit and r.party is None)
        seen.add((r.decision, r.tier))
    return seen


def test_parties_of_a_closed_set(spark):
    parties = ["ŞELALE GİYİM", "ATLAS TİCARET A.Ş.", "ÖRNEK TEKSTİL", "EGE TEKSTİL", "EGE TEKSTIL", "B0RA", "BORA", "ATLAS TİCARET LTD", "KARTAL NAKLİYAT", "", "YILDIZ GIDA SANAYİ"]
    read = ["SELALE GiYiM", "ATLAS TİCARET", "0RNEK TEKSTlL", "ege tekstil", "8ORA", "KARTAL NAKLYAT", "KARTAL NAKLİYAT VE LOJİSTİK", "bambaşka bir ad", "x", "", "YILDIZ GIDA", "EGE", "KRTAL NAKLIYTA"]
    df = lambda xs, s: spark.createDataFrame(xs, s)
    seen = matches(spark, df(list(enumerate(read)), "id long, text string"), df([(p,) for p in parties], "name string"))
    assert {("TEK", "SADE"), ("BELIRSIZ", "SADE"), ("TEK", "MASKE"), ("BELIRSIZ", "MASKE"), ("TEK", "ONEK"), ("BELIRSIZ", "ONEK"), ("TEK", "UZAKLIK"), ("YOK", None)} <= seen
    assert headings.party_match(df([], "id long, text string"), df([("a b",)], "name string")).count() == 0


def test_party_query_equals_a_loop(spark):
    assert len(matches(spark, reading._names_read(spark, SF), reading._parties(spark, SF))) >= 5


def test_rules_retire_for_good(spark):
    rnd = random.Random(3)
    low = lambda h, n: max(0.0, (h / n + 1.9208 / n - 1.96 * (h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) ** 0.5) / (1 + 3.8416 / n))
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 30), i, None, f"made {i}") for i in range(900)]
    rows = [(r, i, rnd.random() < r % 10 / 9, m) for r, i, _, m in rows]
    state = {}
    for rule, i, right, made in rows:
        s = state.setdefault(rule, [0, 0, "AKTIF", None, None])
        if s[2] == "EMEKLI":
            continue
        s[0], s[1] = s[0] + right, s[1] + 1
        if not right:
            s[4] = made
            if s[1] >= 3 and low(s[0], s[1]) < 0.2:
                s[2], s[3] = "EMEKLI", i
    got = headings.rule_states(spark.createDataFrame(rows, "rule long, seq long, right boolean, made string").repartition(3)).collect()
    assert {r.rule: (r.hits, r.trials, r.state, r.retired_at, r.counterexample) for r in got} == {k: tuple(v) for k, v in state.items()}
    assert {r.state for r in got} == {"AKTIF", "EMEKLI"} and all(abs(r.confidence - low(r.hits, r.trials)) < 1e-5 for r in got)


def test_headings_stay_small_and_unsent(spark):
    """Stems name each part once, and lines made by `explode` are not broadcast: they look as small as the rows that they come from."""
    nodes = lambda c: spark.range(1).select(c.alias("s"))._jdf.queryExecution().analyzed().expressions().apply(0).treeString().count("\n")
    assert nodes(grammar.phrase_stems(F.lit("Birim Fiyatı"))) < 3000
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.posexplode(F.array(F.lit("SIRA   MİKTAR   TUTAR"), F.lit("1   2,00   3"))).alias("line", "text"))
    out = headings.column_names(docs.select("doc_id", "line", F.posexplode(F.split("text", "   ")).alias("j", "text")))
    assert out.count() == 150
    assert "SortMergeJoin [doc_id" in out._jdf.queryExecution().executedPlan().toString()
