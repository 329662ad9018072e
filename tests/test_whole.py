"""Queries over whole tables, where a query beside them reads a part."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ledger, reconcile
from tallyspark.plans import registry, valuation
from test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def equal(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) and plain(got) == plain(db.sql(registry.ORACLES[name]).df())


def test_names_link_over_all_customers(spark, db):
    equal(spark, db, "name_links")
    words = [f"{a} {b} STI {c}".strip() for a in "PQR" for b in ("X", "Y", "") for c in ("U V", "U", "")] + ["", "ALONE"]
    named = spark.createDataFrame([(" ".join(w.split()),) for w in words], "name string")
    distinct = sorted({" ".join(w.split()) for w in words} - {""})
    share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    brute = {(a, b) for a in distinct for b in distinct if a < b and share(a, b) >= 0.75}
    assert {(r.name, r.other) for r in reconcile.name_links(named, 0.75).collect()} == brute and brute


@pytest.mark.parametrize("name", ["bank_suggestions", "document_suggestions"])
def test_every_item_gets_suggestions(spark, db, name):
    equal(spark, db, name)
    assert registry.QUERIES[name](spark, SF).where("id % 10 <> 0").limit(1).count()


def test_first_vouchers_of_a_frequent_amount(spark):
    from datetime import date, timedelta

    day = lambda k: date(2026, 1, 1) + timedelta(k)
    vouchers = [(v * 7919 % 3001, 500, day(v % 12)) for v in range(3001)]
    items = [(i, 500, day(i % 15)) for i in range(60)]
    s = "{} long, amount_kr long, date date"
    rows = reconcile.suggestions(spark.createDataFrame(items, s.format("id")), spark.createDataFrame(vouchers, s.format("voucher")), 3).collect()
    want = {(i, v) for i, _, d in items for v in sorted(v for v, _, e in vouchers if abs((d - e).days) <= 3)[:10]}
    assert {(r.id, r.voucher) for r in rows} == want and len(rows) == len(want)


def test_terms_loans_and_numbers_of_whole_tables(spark, db, tmp_path):
    equal(spark, db, "words_to_number")
    keys = [0, 1, 10, 100, 101, 999, 1000, 1001, 9999, 10_000, 21_034, 100_000, 999_999, 1_000_000, 6_000_001, 1_000_000_000, 345_678_901_234]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.QUERIES["words_to_number"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.number) for r in got) == [(k, k) for k in keys]
    spark.createDataFrame([(1, "one two three tbere"), (2, "avec"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.term: r.match for r in registry.QUERIES["term_distance"](spark, str(tmp_path)).collect()}["tbere"] == "there"
    spark.createDataFrame([(399,), (400,), (15_000,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    assert {r.id for r in registry.QUERIES["loan_entries"](spark, str(tmp_path)).select("id").collect()} == {399, 400, 15_000}
    rows = registry.QUERIES["loan_schedule"](spark, str(tmp_path)).collect()
    principal = {r.id: r.principal_kr for r in valuation._loans(spark, str(tmp_path)).collect()}
    assert {i: sum(r.principal_kr for r in rows if r.id == i) for i in principal} == principal and len(principal) == 3


def test_contra_accounts_of_long_vouchers(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    rows = [(v, n, f"{rnd.randint(1, 4)}", a, 100 - a) for v in (7, 8) for n in range(1, 31) for a in (rnd.choice((0, 100)),)]
    rows = [(v, n, x, d, c) for v, n, x, d, c in rows if v == 7 or n <= 5] + [(9, 1, f"120.{k}", 100, 0) for k in range(40)]
    monkeypatch.setattr(ledger, "CONTRA_LINES", 10)
    j = spark.createDataFrame(rows, "voucher long, line_no int, account string, debit_kr long, credit_kr long").repartition(5)
    got = {}
    for r in ledger.long_contras(j, 3).orderBy("voucher", "side", "chunk").collect():
        assert r.chunk == len(got.setdefault((r.voucher, r.side), [])) and len(r.contra.split(", ")) <= 3
        got[r.voucher, r.side].append(r.contra)
    want = {}
    for v, side in ((7, "debit"), (7, "credit"), (9, "credit")):
        accounts = [x for _, x in sorted((n, x) for w, n, x, d, _ in rows if w == v and (d > 0) == (side == "credit"))]
        want[v, side] = ", ".join(x for i, x in enumerate(accounts) if not i or x != accounts[i - 1])
    assert {k: ", ".join(x) for k, x in got.items()} == want
