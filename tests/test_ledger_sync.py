"""The ledger of allocations: repeats change nothing, undone decisions reverse their own vouchers, versions switch as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import allocation, allocation_ledger
from tallyspark.operators.allocation_ledger import AllocationLedger

S = "direction string, party long, {} long, date date, open_kr long"


@pytest.fixture
def books(spark):
    day = lambda n: f"2026-01-{n:02}"
    invoices = [("SATIS", 1, 1, day(1), 100), ("SATIS", 1, 2, day(2), 50), ("SATIS", 2, 3, day(1), 70), ("SATIS", 1, 4, day(3), 30)]
    money = [("SATIS", 1, 11, day(5), 120), ("SATIS", 1, 12, day(6), 40), ("SATIS", 2, 13, day(7), 70)]
    make = lambda rows, k: spark.createDataFrame([(a, b, c, None, e) for a, b, c, _, e in rows], S.format(k)).drop("date").join(spark.createDataFrame([(r[2], r[3]) for r in rows], f"{k} long, d string"), k).withColumn("date", F.col("d").cast("date")).drop("d")
    return make(invoices, "no"), make(money, "id").withColumn("instrument", F.when(F.col("id") == 12, "CEK").otherwise("BANKA"))


def allocated(spark, books, ledger, decisions, free=()):
    free_ids = spark.createDataFrame([(i,) for i in free], "id long")
    return allocation.allocate(*books, allocation_ledger.frozen(ledger.read(), free_ids), spark.createDataFrame(decisions, "id long, no long"))


def active(ledger):
    return sorted((r.id, r.no, r.amount_kr, r.source) for r in ledger.read().where(allocation_ledger.ACTIVE).collect())


def test_sync_decide_and_undo(spark, books, tmp_path):
    ledger = AllocationLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.sync(allocated(spark, books, ledger, [])) == {"new": 5, "reversed": 0, "version": 1}
    assert [(a, b, c) for a, b, c, _ in active(ledger)] == [(11, 1, 100), (11, 2, 20), (12, 2, 30), (12, 4, 10), (13, 3, 70)]
    assert ledger.sync(allocated(spark, books, ledger, [])) == {"new": 0, "reversed": 0, "version": 1}  # once more changes nothing


def test_undone_decision_reverses_its_vouchers(spark, books, tmp_path):
    ledger = AllocationLedger(spark, f"file://{tmp_path}/ledger")
    ledger.sync(allocated(spark, books, ledger, []))
    start = active(ledger)
    done = ledger.sync(allocated(spark, books, ledger, [(12, 4)], free=[12]))
    assert done["new"] >= 1 and done["reversed"] >= 1 and done["version"] == 2
    assert (12, 4, 30, "MANUEL") in active(ledger) and [a for a in active(ledger) if a[0] != 12] == [a for a in start if a[0] != 12]
    undone = ledger.sync(allocated(spark, books, ledger, [], free=[12]))
    assert undone["reversed"] == 1 and active(ledger) == start
    rows = {r.serial: r for r in ledger.read().collect()}
    assert sorted(rows) == list(range(1, len(rows) + 1))  # numbers without gaps
    for r in rows.values():
        assert r.voucher_no == (f"STR-{r.serial:06}" if r.reversal else f"THS-F{r.serial:06}")
        if r.state == "IPTAL":
            by = rows[int(r.counter[4:])]
            assert by.reversal and by.counter == r.voucher_no and by.key == f"STORNO|{r.key}" and by.amount_kr == r.amount_kr
    money = books[1]
    legs = allocation_ledger.lines(ledger.read(), money).collect()
    assert sum(x.debit_kr for x in legs) == sum(x.credit_kr for x in legs) == sum(r.amount_kr for r in rows.values()) and len(legs) == 2 * len(rows)
    net = lambda own: sum(x.debit_kr - x.credit_kr for x in legs if rows[x.serial].state == "IPTAL" and x.account == own or rows[x.serial].reversal and x.account == own)
    assert net("120") == net("102") == net("101") == 0


def test_unfinished_versions_are_not_read(spark, books, tmp_path):
    ledger = AllocationLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.read().count() == 0 and ledger.versions() == []
    ledger.sync(allocated(spark, books, ledger, []))
    kept = active(ledger)
    (tmp_path / "ledger" / "version=2").mkdir()
    (tmp_path / "ledger" / "version=2" / "part-0.parquet").write_bytes(b"half")
    assert ledger.versions() == [1] and active(ledger) == kept
    assert ledger.sync(allocated(spark, books, ledger, [(12, 4)], free=[12]))["version"] == 2
    assert sorted((r.id, r.no, r.amount_kr, r.source) for r in ledger.read(1).where(allocation_ledger.ACTIVE).collect()) == kept


def test_sync_against_a_loop(spark):
    """Any two states in a row: serials, reversals and keys by a loop over dictionaries."""
    rnd = random.Random(6)
    ledger = spark.createDataFrame([], allocation_ledger.SCHEMA)
    active_, serial, rows = {}, 0, {}
    for _ in range(3):
        now = {(rnd.randrange(9), rnd.randrange(9), rnd.choice([5, 6])) for _ in range(25)}
        keys = {f"{a}|{b}|{c}": (a, b, c) for a, b, c in now}
        for k in sorted((k for k in active_ if k not in keys), key=active_.get):
            serial += 1
            old = active_.pop(k)
            rows[old] = (*rows[old][:-2], "IPTAL", f"STR-{serial:06}")
            rows[serial] = (f"STORNO|{k}", f"STR-{serial:06}", "AKTIF", rows[old][1])
        for k in sorted(set(keys) - set(active_)):
            serial += 1
            active_[k] = serial
            rows[serial] = (k, f"THS-F{serial:06}", "AKTIF", None)
        ledger = allocation_ledger.synced(ledger, spark.createDataFrame([(*x, "FIFO") for x in sorted(now)], "id long, no long, amount_kr long, source string").repartition(3))
        assert {r.serial: (r.key, r.voucher_no, r.state, r.counter) for r in ledger.collect()} == rows
    assert any(r[2] == "IPTAL" for r in rows.values())
