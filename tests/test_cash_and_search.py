"""Cash book, invoice search and outcomes of decisions on rows written by hand."""

from datetime import date

from tallyspark.operators import allocation, audit


def test_cash_book(spark):
    rows = [
        (1, "SATIS", date(2026, 1, 9), 1_000, "NAKIT"), (2, "ALIS", date(2026, 1, 9), 900_000, "NAKIT"), (3, "SATIS", date(2026, 1, 3), 5, "BANKA"), (4, "SATIS", date(2026, 2, 2), 700_000, "NAKIT"),
        (5, "ALIS", date(2026, 3, 1), 40, "NAKIT"), (5, "SATIS", date(2026, 3, 1), 700_001, "NAKIT"),
    ]
    money = spark.createDataFrame(rows, "id long, direction string, date date, amount_kr long, instrument string")
    book = audit.cash_book(money, opening_kr=-2_000)
    got = [tuple(r)[:5] + (r.over_limit, r.negative) for r in book.orderBy("date", "source", "id").collect()]
    assert sorted(got, key=lambda r: (r[2], r[1] != "VIRMAN", r[0] or 0, r[1])) == [
        (None, "VIRMAN", date(2026, 1, 1), 900_000, 898_000, False, False), (1, "SATIS", date(2026, 1, 9), 1_000, 899_000, False, False), (2, "ALIS", date(2026, 1, 9), 900_000, -1_000, True, True),
        (4, "SATIS", date(2026, 2, 2), 700_000, 699_000, False, False), (None, "VIRMAN", date(2026, 3, 1), 40, 699_040, False, False), (5, "ALIS", date(2026, 3, 1), 40, 699_000, False, False),
        (5, "SATIS", date(2026, 3, 1), 700_001, 1_399_001, True, False),
    ]
    assert tuple(audit.cash_findings(book, opening_kr=-2_000).first()) == (7, 2, 1_600_001, 1, 900_040, 1_399_001)
    none = audit.cash_book(money.where("id > 9"))
    assert none.count() == 0 and tuple(audit.cash_findings(none).first()) == (0, 0, 0, 0, 0, 25_000_000)


def test_invoice_search(spark):
    rows = [
        ("SATIS", 1, 7, "Alfa", date(2026, 1, 1), "KABUL", True, 100, 100, "BANKA", "E_FATURA"), ("SATIS", 2, 8, "Beta", date(2026, 1, 2), "KABUL", True, 200, 200, "CEK", "E_ARSIV"),
        ("SATIS", 3, 7, "Alfa", date(2026, 1, 3), "TASLAK", False, 300, 0, "CEK", "E_FATURA"), ("ALIS", 1, 9, "Gama", date(2026, 1, 4), "KABUL", True, 100, 100, "ACIK", "E_FATURA"),
        ("SATIS", 4, 8, None, date(2026, 1, 5), "KABUL", True, 50, 0, None, "E_FATURA"),
    ]
    invoices = spark.createDataFrame(rows, "direction string, no long, party long, name string, date date, state string, valid boolean, gross_kr long, net_debt_kr long, instrument string, document string")
    allocated = spark.createDataFrame([("SATIS", 2, 60, "BANKA"), ("SATIS", 2, 40, "NAKIT"), ("ALIS", 1, 100, "BANKA")], "direction string, no long, amount_kr long, instrument string")
    s = audit.settled(invoices, allocated)
    find = lambda **k: sorted((r.direction[0], r.no) for r in audit.found_invoices(s, allocated, **k).collect())
    assert find(instrument="BANKA") == [("A", 1), ("S", 1), ("S", 2)] and find(instrument="CEK") == [("S", 2), ("S", 3)]
    assert find(paid="kismi") == [("S", 2)] and find(paid="odendi") == [("A", 1), ("S", 3), ("S", 4)] and find(paid="acik") == [("S", 1), ("S", 3), ("S", 4)]
    assert find(allocatable=True) == [("S", 1), ("S", 2)] and find(text="ALF") == [("S", 1), ("S", 3)] and find(text="4") == [("S", 4)]
    assert [find(tab=t) for t in ("giden", "gelen", "earsiv", "taslak")] == [[("S", 1), ("S", 4)], [("A", 1)], [("S", 2)], [("S", 3)]]
    assert find(direction="SATIS", low_kr=100, high_kr=200, since="2026-01-02", party=8) == [("S", 2)]
    order = lambda sort, **k: [(r.direction[0], r.no) for r in audit.invoice_page(s, sort, **k).collect()]
    assert order("tutar_desc", limit=4) == [("S", 3), ("S", 2), ("A", 1), ("S", 1)] and order("tarih_asc", offset=4) == [("S", 4)] and order("tarih_desc", limit=1) == [("S", 4)]
    assert tuple(audit.invoice_totals(s).first()) == (5, 200) and tuple(audit.invoice_totals(s.where("no > 99")).first()) == (0, 0)


def test_outcomes(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    invoices = frame([(1, 100), (2, 50), (3, 80), (4, 10), (5, 0)], "no net_debt_kr")
    receipts = frame([(10, 100), (11, 70), (12, 30), (13, 40), (14, 9)], "id amount_kr")
    decisions = frame([(10, 1), (11, 2), (12, 3), (13, 5), (99, 1), (14, 77)], "id no")
    before = frame([(10, 2, 50), (11, 1, 70), (13, 3, 40)], "id no amount_kr")
    after = frame([(10, 1, 60), (10, 1, 40), (11, 2, 50), (11, 4, 5), (12, 3, 30), (13, 3, 40)], "id no amount_kr")
    got = {r.id: tuple(r)[2:] for r in allocation.outcomes(decisions, invoices, receipts, before, after).collect()}
    assert got == {
        10: (100, 100, 0, 0, 50, 70, "TAM_YAZILDI_FATURA_KAPANDI"), 11: (70, 50, 5, 15, 70, 50, "KISMEN_YAZILDI"), 12: (30, 30, 0, 0, 0, 0, "TAM_YAZILDI_FATURA_ACIK"), 13: (40, 0, 40, 0, 0, 0, "YAZILAMADI"),
    }
    assert allocation.outcomes(decisions.where("false"), invoices, receipts, before, after).count() == 0
