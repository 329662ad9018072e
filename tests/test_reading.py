"""Candidates, the combination that is proved, and the gate, by literal pages and by trying all combinations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import candidates
from tallyspark.operators.candidates import AMOUNT, DATE, TAX_ID, TEXT, Equation, Field

PAGE = """ABC TİCARET VE SANAYİ A.Ş.                              e-FATURA
Atatürk Bulvarı No:12 Çankaya/ANKARA
Vergi Dairesi: Çankaya          VKN: 1234567890

SAYIN
EGE TEKSTİL SANAYİ A.Ş.
Vergi Dairesi: Konak            VKN: 9876543210

Fatura No                                        ABC2026000000777
Fatura Tarihi                                    12.04.2026

 1     Pamuk iplik          100     80,00           8.000,00
                                    Mal Hizmet Toplam Tutarı      8.000,00
                                    Hesaplanan KDV %20            1.600,00
                                    Vergiler Dahil Toplam Tutar   9.600,00"""


def values(spark, text, *fields):
    got = candidates.candidates(candidates.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")), list(fields)).orderBy("field", "place").collect()
    return {f.name: [r.value for r in got if r.field == f.name] for f in fields}


def test_traps_of_a_page(spark):
    got = values(spark, PAGE, Field("unvan", TEXT, ("sayin",)), Field("tarih", DATE, ("fatura tarihi",)), Field("kdv", AMOUNT, ("hesaplanan kdv",)), Field("vkn", TAX_ID, ("vkn",)))
    assert got["unvan"] == ["EGE TEKSTİL SANAYİ A.Ş."] and got["tarih"] == ["12.04.2026"] and got["vkn"] == ["1234567890", "9876543210"]
    assert got["kdv"][0] == "1.600,00" and "20" not in got["kdv"]


def test_scanned_totals(spark):
    page = "TOPLAM   3.200,00\nisK %\nNET TUTAR   3.200,00\nKDV % 8   256,00\nYalniz: Ucbindortyuzellialti.liradir.   GENEL TOPLAM   3.456,00"
    got = values(spark, page, Field("toplam", AMOUNT, ("genel toplam", "toplam")), Field("matrah", AMOUNT, ("net tutar", "matrah")), Field("kdv", AMOUNT, ("kdv", "kdv tutari")))
    assert got == {"toplam": ["3.456,00", "3.200,00"], "matrah": ["3.200,00", "256,00"][: len(got["matrah"])], "kdv": got["kdv"]} and got["kdv"][0] == "256,00"
    assert values(spark, "SAYIN: Ayşe YILMAZ   irsaliye Tarihi : 10.02.2006\nÖrnek Caddesi Nu: 125", Field("unvan", TEXT, ("sayin",)))["unvan"][0] == "Ayşe YILMAZ"


@pytest.mark.parametrize(
    "raw, mark, kurus",
    [
        ("8.000,00", ",", 800000), ("8.000.00", ",", 800000), ("8,000.00", ",", 800000), ("1.234", ",", 123400), ("1.234", ".", 123), ("102 177,36", ",", 10217736), ("102.177,36", ",", 10217736), ("-12,5", ",", -1250), ("TL 12", ",", 1200),
        ("1,2,3", ",", 12300), ("", ",", None), ("yok", ",", None), ("1.600,", ",", 160000), ("12.50", ",", 1250), ("0,05", ",", 5), ("9" * 30, ",", None),
    ],
)
def test_amounts(spark, raw, mark, kurus):
    assert spark.createDataFrame([(raw,)], "x string").select(candidates.read_amount("x", mark)).first()[0] == kurus


def test_typed_values(spark):
    rows = [(DATE, "12.04.2026", 20260412), (DATE, "31.02.2026", None), (DATE, "1234.5678", None), (DATE, "29/02/2024", 20240229), (DATE, "01.01.1899", None), (DATE, "12.04.26", None), (TAX_ID, "12345 67890", 1234567890), (TAX_ID, "123456789", None), (TEXT, "12", None), (AMOUNT, "1,5", 150)]
    df = spark.createDataFrame(rows, "kind string, x string, want long")
    assert all(r.got == r.want for r in df.withColumn("got", candidates.typed(F.col("kind"), F.col("x"), ",")).collect())
    shown = [("KDV % 8   1,00 %20 5", ["1,00", "5"]), ("5%8", []), ("1.600, 2", ["1.600", "2"]), (None, [])]
    got = spark.createDataFrame(shown, "x string, want array<string>").withColumn("got", candidates.tokens(F.lit(AMOUNT), F.col("x"))).collect()
    assert all(r.got == r.want for r in got)


def tried(options: dict, equations):
    """All combinations in order, the first field fastest."""
    out = {}
    for q in equations:
        names = [*(t for t, _ in q.terms), q.target]
        lists = [[(v, n) for v, n in options.get(f, [])[:6]] for f in names]
        for combo in itertools.product(*reversed(lists)):
            combo = combo[::-1]
            total, goal = sum(s * n for (_, s), (_, n) in zip(q.terms, combo)), combo[-1][1]
            if goal and (abs(total) == abs(goal) if q.absolute else total == goal):
                out |= {f: next(v for v, n in options[f][:6] if n == c[1]) for f, c in zip(names, combo)}
                break
    return out


def test_first_combination(spark):
    rnd = random.Random(5)
    equations = [Equation("sum", (("a", 1), ("b", 1)), "t"), Equation("net", (("a", 1), ("c", -1)), "n", absolute=True), Equation("long", (("a", 1), ("b", 1), ("c", -1), ("d", 1), ("n", -1)), "t")]
    rows, want = [], []
    for doc in range(120):
        options = {f: [(f"{rnd.randrange(0, 7)},00", 0) for _ in range(rnd.choice([0, 1, 3, 8, 8]))] for f in "abcdnt"}
        options = {f: [(v, int(v[:-3]) * 100) for v, _ in xs] for f, xs in options.items()}
        rows += [(doc, f, AMOUNT, i + 1, v) for f, xs in options.items() for i, (v, _) in enumerate(xs)]
        want += [(doc, f, v) for f, v in tried(options, equations).items()]
    df = spark.createDataFrame(rows, "doc_id long, field string, kind string, place int, value string").repartition(3)
    assert sorted(tuple(r) for r in candidates.chosen(df, equations, ",").collect()) == sorted(want) and len(want) > 200


def test_gate(spark):
    rule = [Equation("sum", (("a", 1), ("b", 1)), "t"), Equation("net", (("a", 1), ("b", -1)), "n", absolute=True)]
    rows = []
    page = lambda doc, **kw: rows.extend((doc, f, TAX_ID if f == "vkn" else AMOUNT, i + 1, v) for f, xs in kw.items() for i, v in enumerate(xs))
    page(1, a=["8,00", "5,00"], b=["7,00"], t=["12,00"], n=["2,00"], vkn=["1234567890", "9876543210"])
    page(2, a=["5,00"], b=["7,00"], t=["12,04"], n=["2,00"], vkn=["1234567890"])  # off by more than a kurus a term and one
    page(3, a=["5,00"], b=["7,00"], t=["12,03"], n=["-2,00"], vkn=["1234567890", "12345 67890"])  # within it
    page(4, a=["5,00"], b=["7,00"], t=["12,00"])  # one equation cannot be told
    df = spark.createDataFrame(rows, "doc_id long, field string, kind string, place int, value string")
    got = {(r.doc_id, r.field): r for r in candidates.filled(df, rule, ",").collect()}
    assert [got[d, "a"].filled for d in (1, 2, 3, 4)] == [True, False, True, False] and got[2, "a"].value is None
    assert got[1, "a"].number == 500 and got[1, "a"].approved and not got[1, "vkn"].approved and got[3, "vkn"].approved and got[1, "vkn"].candidates == 2
    known = candidates.findings(candidates.filled(df.where("doc_id in (1, 3)"), rule, ","), rule).collect()
    assert {(r.doc_id, r.equation): r.code for r in known} == {(1, "sum"): "A00", (1, "net"): "A00", (3, "sum"): "A00", (3, "net"): "A00"}
    assert candidates.filled(df, [], ",").where("filled").count() == 0 and candidates.filled(df.limit(0), rule, ",").count() == 0


def test_amounts_are_written_out_once(spark):
    """Each step of reading is named once; an expression written out at each use ran its patterns a dozen times for a number."""
    import re

    from tallyspark.operators import candidates

    plan = lambda c: spark.range(1).select(c.alias("s"))._jdf.queryExecution().analyzed().expressions().apply(0).treeString()
    assert len(re.findall(r"^[\s:+\-]*regexp", plan(candidates.read_amount(F.lit("1.234,56"), ",")), re.M)) <= 2
    lines = spark.createDataFrame([(1, 0, "Genel Toplam   1.180,00"), (1, 1, "")], "doc_id long, line int, text string")
    found = candidates.candidates(lines, [candidates.Field("toplam", candidates.AMOUNT, ("toplam",))])
    assert [(r.value, r.strategy) for r in found.collect()] == [("1.180,00", "next cell")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Filter (size(filter(array(") == 0


def test_language_folds_a_text_once(spark):
    """Words were folded once for each language and mention of the best."""
    from tallyspark.operators import documents

    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "qq"), (3, None)], "doc_id int, text string")
    out = documents.guess_language(df)
    assert [r.language for r in out.orderBy("doc_id").collect()] == ["en", "", ""]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
