"""Hand-computed cases of the books, statements and calculators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import allocation, credit, documents, ledger, posting, reconcile, statements, tax


@pytest.fixture(scope="module")
def two_vouchers(spark):
    rows = [(1, 1, "153", 1_000_000, 0), (1, 2, "191", 200_000, 0), (1, 3, "100", 0, 1_200_000), (2, 1, "100", 1_800_000, 0), (2, 2, "600", 0, 1_500_000), (2, 3, "391", 0, 300_000)]
    df = spark.createDataFrame(rows, "voucher long, line_no int, account string, debit_kr long, credit_kr long")
    return df.withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("voucher").cast("int"))).withColumn("kind", F.lit("x")).withColumn("doc_no", F.col("voucher"))


def test_trial_balance(two_vouchers):
    rows = {r.account: r for r in ledger.trial_balance(two_vouchers).collect()}
    assert (rows["100"].debit_kr, rows["100"].credit_kr, rows["100"].debit_balance_kr) == (1_800_000, 1_200_000, 600_000)
    assert ledger.balanced(two_vouchers).first().balanced


def test_running_balance_and_contra(two_vouchers):
    rows = ledger.general_ledger(two_vouchers).join(ledger.contras(two_vouchers), ["voucher", "side"]).where("account = '100'").orderBy("date").collect()
    assert [(r.balance_kr, r.contra) for r in rows] == [(-1_200_000, "153, 191"), (600_000, "600, 391")]


def test_vat_offset(two_vouchers, spark):
    assert {(r.account, r.debit_kr, r.credit_kr) for r in tax.vat_offset(two_vouchers).collect()} == {("391", 300_000, 0), ("191", 0, 200_000), ("360", 0, 100_000)}
    more = spark.createDataFrame([("191", 200_000, 0), ("391", 0, 120_000)], "account string, debit_kr long, credit_kr long")
    assert ("190", 80_000, 0) in {(r.account, r.debit_kr, r.credit_kr) for r in tax.vat_offset(more).collect()}


def test_closing(spark):
    j = spark.createDataFrame([("600", 0, 1_500_000), ("621", 1_000_000, 0)], "account string, debit_kr long, credit_kr long")
    assert statements.period_result(j).first().result_kr == 500_000
    rows = statements.closing(j, F.lit(125_000)).collect()
    assert {r.step for r in rows} == {1, 2, 3, 4} and [r.credit_kr for r in rows if r.account == "590"] == [375_000]
    assert sum(r.debit_kr - r.credit_kr for r in rows) == 0
    loss = spark.createDataFrame([("600", 0, 500_000), ("621", 800_000, 0)], "account string, debit_kr long, credit_kr long")
    assert [r.debit_kr for r in statements.closing(loss).collect() if r.account == "591"] == [300_000]


def test_names_and_amounts(spark):
    r = spark.sql("SELECT 'SAYIN Ali VELİ - FAST Anlık Ödeme' AS n, '1.234' AS a, '1 234,56' AS b, 'okunamadı' AS c")
    got = r.select(names.canonical("n"), names.parse_amount("a", ","), names.parse_amount("a", "."), names.parse_amount("b", ","), names.parse_amount("c", ",")).first()
    assert got[0] == "ALI VELI" and got[1] == 123_400 and got[2] is None and got[3] == 123_456 and got[4] is None


@pytest.mark.parametrize(
    "language, text, number",
    [
        ("tr", "yüz iki bin yüz yetmiş yedi", 102_177), ("tr", "YALNIZ ON BEŞ BİN TÜRK LİRASI", 15_000), ("tr", "bin", 1_000), ("tr", "dokuz yüz doksan dokuz", 999), ("tr", "x", None), ("tr", "", None), ("tr", "bir milyon iki yüz elli bin", 1_250_000),
        ("en", "one hundred two thousand one hundred seventy-seven", 102_177), ("en", "Say: Fifteen Thousand Dollars Only", 15_000), ("en", "nineteen", 19), ("en", "two million three hundred forty-five thousand", 2_345_000),
        ("de", "einhundertsiebenundsiebzig", 177), ("de", "zwölftausenddreihundertfünf", 12_305), ("de", "eine Million Euro", 1_000_000), ("fr", "quatre-vingt-dix-sept", 97), ("fr", "deux mille trois cents", 2_300), ("fr", "soixante et onze", 71),
        ("fr", "quatre-vingts", 80), ("ru", "двести тысяч триста сорок один рубль", 200_341), ("ru", "одна тысяча", 1_000), ("ru", "пятьсот", 500),
    ],
)
def test_number_words(spark, language, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(documents.words_to_number("t", language)).first()[0] == number


def test_loan(spark):
    df = spark.sql("SELECT 1L AS id, 10000000L AS principal_kr, 4800L AS rate_bp, 12L AS term, DATE'2026-01-31' AS start, 'Annuite' AS method, 500 AS bsmv_bp, cast(array() AS array<struct<months:int,annual_bp:bigint>>) AS tranches")
    rows = credit.schedule(df).orderBy("no").collect()
    assert rows[0].interest_kr == 400_000 and sum(r.principal_kr for r in rows) == 10_000_000 and rows[-1].left_kr == 0
    assert rows[0].date == date(2026, 2, 28)


def test_nearest_counterpart(spark):
    s = "id long, name string, amount_kr long, date string"
    ours = spark.createDataFrame([(1, "A", 10_000, "2026-04-05"), (2, "B", 10_000, "2026-04-05")], s).withColumn("date", F.col("date").cast("date"))
    theirs = spark.createDataFrame([(11, "A", 10_000, "2026-04-20"), (12, "A", 10_000, "2026-04-06"), (13, "B", 10_001, "2026-04-05")], s).withColumn("date", F.col("date").cast("date"))
    pairs = reconcile.reconcile(ours, theirs)
    assert [(r.id, r.their_id) for r in pairs.collect()] == [(1, 12)]
    assert [(r.id, r.category) for r in reconcile.leftovers(ours, pairs, theirs).collect()] == [(2, "GrupIciEksik")]


def loop(invoices, receipts):
    left, out = {i[2]: i[4] for i in invoices}, {}
    for _, p, rid, rdate, amount in sorted(receipts, key=lambda r: (r[3], r[2])):
        for _, ip, no, idate, _ in sorted(invoices, key=lambda i: (i[3], i[2])):
            take = min(amount, left[no]) if ip == p and idate <= rdate else 0
            if take > 0:
                out[rid, no] = take
                amount, left[no] = amount - take, left[no] - take
    return out


def test_fifo_against_a_loop(spark):
    import random

    rnd = random.Random(4)
    day = lambda: date(2026, 1, rnd.randint(1, 9))
    inv = [("SATIS", rnd.randint(1, 12), n, day(), rnd.randint(0, 9) * 100) for n in range(300)]
    rec = [("SATIS", rnd.choice([None, *range(1, 13)]), n, day(), rnd.randint(1, 12) * 100) for n in range(250)]
    s = "direction string, party long, {} long, date date, open_kr long"
    got = {(r.id, r.no): r.amount_kr for r in allocation.fifo(spark.createDataFrame(inv, s.format("no")), spark.createDataFrame(rec, s.format("id"))).collect()}
    assert got == loop(inv, rec)


def test_numbers_have_no_gaps(spark):
    df = spark.range(500).select(F.col("id").alias("voucher"), (F.col("id") % 3).cast("string").alias("series"), (F.col("id") * 37 % 500).alias("at"))
    rows = posting.numbered(df, "at", "voucher").orderBy("at").collect()
    assert [r.journal_no for r in rows] == list(range(1, 501))
    for k in "012":
        assert [r.serial for r in rows if r.series == k] == list(range(1, 1 + sum(r.series == k for r in rows)))


def test_empty_tables(spark):
    j = spark.createDataFrame([], "voucher long, kind string, line_no int, date date, account string, debit_kr long, credit_kr long, doc_no long")
    assert ledger.trial_balance(j).count() == 0 and statements.statement(j).first().net_profit == 0 and tax.vat_return(j).count() == 0


def test_terms_and_loan_entries(spark):
    rows = documents.corrected(spark.createDataFrame([(1, "there"), (2, "tbere"), (3, "zzzz"), (4, None)], "id long, term string"), ["there", "nicht"]).orderBy("id").collect()
    assert [(r.match, r.status) for r in rows] == [("there", "TAM"), ("there", "ONERI"), (None, "BILINMIYOR"), (None, "BILINMIYOR")]
    assert documents.distance("ab", "ba") == 1 and documents.distance("l0", "1o") == pytest.approx(0.8)
    df = spark.sql("SELECT 1L AS id, 1000000L AS principal_kr, 2400L AS rate_bp, 14L AS term, DATE'2026-01-31' AS start, 'EsitAnapara' AS method, 500 AS bsmv_bp, cast(array() AS array<struct<months:int,annual_bp:bigint>>) AS tranches")
    legs = credit.entries(df).collect()
    assert sum(r.debit_kr - r.credit_kr for r in legs) == 0 and sum(r.debit_kr for r in legs if r.account == "400") == 1_000_000
