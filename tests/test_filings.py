"""Returns as they are filed and draft vouchers, on literal cases."""

import datetime as dt

from tallyspark.operators import drafts, returns

JOURNAL = "voucher long, kind string, line_no int, date date, account string, debit_kr long, credit_kr long, doc_no long"
MANUAL = "month date, direction string, name string, base_kr long, vat_kr long"
SALES = "no long, valid boolean, direction string, date date, net_kr long, vat_kr long, withheld_kr long, return_net_kr long, discount_net_kr long"


def day(m, d=15, y=2026):
    return dt.date(y, m, d)


def journal(spark, rows):
    """rows: (month, account, debit, credit)"""
    return spark.createDataFrame([(i, "x", 1, day(m), a, d, c, i) for i, (m, a, d, c) in enumerate(rows)], JOURNAL)


def legs(spark, rows):
    return [(r.month.month, r.line_no, r.account, r.debit_kr, r.credit_kr) for r in returns.monthly_offsets(journal(spark, rows)).orderBy("month", "line_no").collect()]


def test_offsets_carry_and_pay(spark):
    rows = [(1, "391.06", 0, 100), (1, "191.06", 160, 0), (2, "391.06", 0, 100), (2, "191.06", 30, 0), (3, "391.06", 0, 5)]
    assert legs(spark, rows) == [(1, 1, "391.06", 100, 0), (1, 2, "191.06", 0, 160), (1, 3, "190", 60, 0), (2, 1, "391.06", 100, 0), (2, 2, "191.06", 0, 30), (2, 3, "190", 0, 60), (2, 4, "360", 0, 10), (3, 1, "391.06", 5, 0), (3, 2, "360", 0, 5)]


def test_a_leaf_of_the_wrong_sign_stays_open(spark):
    rows = [(1, "391.04", 40, 0), (1, "391.06", 0, 100), (2, "391.04", 0, 90), (3, "191.01", 0, 7), (3, "391.06", 0, 1)]
    assert legs(spark, rows) == [(1, 1, "391.06", 100, 0), (1, 2, "360", 0, 100), (2, 1, "391.04", 50, 0), (2, 2, "360", 0, 50), (3, 1, "391.06", 1, 0), (3, 2, "360", 0, 1)]
    assert legs(spark, [(1, "190", 50, 0), (1, "391.06", 0, 20)]) == [(1, 1, "391.06", 20, 0), (1, 2, "190", 0, 50), (1, 3, "190", 30, 0)]
    assert legs(spark, [(1, "600", 0, 50), (1, "3910", 0, 9)]) == legs(spark, [(1, "600", 0, 1)]) == []


def test_return_leaves_out_offsets_and_adds_manual_lines(spark):
    j = journal(spark, [(1, "391.06", 0, 200), (1, "391.04", 30, 0), (1, "191.06", 260, 0), (2, "391.06", 0, 40)])
    j = j.unionByName(returns.offset_lines(returns.monthly_offsets(j)).select(j.columns))
    manual = spark.createDataFrame([(day(2, 1), "hesaplanan", "correction", 100, 20), (day(2, 1), "indirim", "late invoice", 50, 10), (day(4, 1), "indirim", "alone", 5, 1)], MANUAL)
    got = [tuple(r) for r in returns.vat_filed(j, manual).orderBy("month").collect()]
    assert got == [(day(1, 1), 200, 0, 260, 260, 0, 60), (day(2, 1), 60, 60, 0, 70, 0, 10), (day(4, 1), 0, 20, 0, 21, 0, 21)]
    sold = [(1, True, "SATIS", day(1), 1000, 0, 0, 100, 50), (2, True, "SATIS", day(1), 500, 100, 50, 0, 0), (3, False, "SATIS", day(1), 9, 0, 0, 0, 0), (4, True, "ALIS", day(1), 9, 0, 0, 0, 0)]
    parts = returns.vat_sections(j, spark.createDataFrame(sold, SALES), manual, {"391.06": 20, "191.06": 10})
    assert {tuple(r) for r in parts.where("month = '2026-01-01'").collect()} == {
        (day(1, 1), "hesaplanan", "391.06", 20, 1000, 200, 0, None), (day(1, 1), "indirim", "191.06", 10, 2600, 260, 0, None), (day(1, 1), "istisna", None, None, 850, 0, 0, 1), (day(1, 1), "tevkifat", None, None, 500, 100, 50, 1),
    }
    assert {(r.section, r.code, r.vat_kr) for r in parts.where("section like 'manuel%'").collect()} == {("manuel hesaplanan", "correction", 20), ("manuel indirim", "late invoice", 10), ("manuel indirim", "alone", 1)}


def test_advance_tax_adds_and_exempts(spark):
    j = journal(spark, [(1, "600", 0, 1000), (2, "689", 200, 0), (5, "632", 900, 0), (8, "600", 0, 2000), (12, "690", 5, 0)])
    manual = spark.createDataFrame([(2026, 1, "kkeg", 100), (2026, 3, "istisna", 500), (2026, 4, "istisna", 99_999)], "year int, quarter int, kind string, amount_kr long")
    got = [tuple(r)[1:] for r in returns.advance_tax_filed(j, manual).orderBy("quarter").collect()]
    # profit, 689, added, exempt, base, tax, before, payable
    assert got == [(1, 800, 200, 100, 0, 1100, 275, 0, 275), (2, -100, 200, 0, 0, 100, 25, 275, 0), (3, 1900, 200, 0, 500, 1600, 400, 25, 375), (4, 1900, 200, 0, 99_999, 0, 0, 400, 0)]


DOCS = "doc_id long, kind string, direction string, complete boolean, base_kr long, vat_kr long, total_kr long, withheld_kr long"


def test_drafts(spark):
    rows = [
        (1, "FATURA", "SATIŞ", True, 1000, 200, 1200, None), (2, "FATURA", "alış", True, 1000, 200, 1200, 100), (3, "FATURA", "SATIS", True, 1000, 130, 1130, 0), (4, "FATURA", "SATIS", True, 1000, 200, 1200, 201),
        (5, "FATURA", "SATIS", True, 1000, 200, 1201, 0), (6, "MAKBUZ", "SATIS", True, 1, 0, 1, 0), (7, None, None, None, None, None, None, None), (8, "FATURA", "SATIS", None, 1000, 200, 1200, 0), (9, "FATURA", None, True, 500, 0, 500, -5),
    ]
    made = drafts.drafts(spark.createDataFrame(rows, DOCS), {20: "06", 0: "01"})
    assert {r.doc_id: (r.status, r.rate, r.findings) for r in made.collect()} == {
        1: ("TASLAK", 20, ""), 2: ("TASLAK", 20, ""), 3: ("TASLAK", 13, "A30"), 4: ("ENGEL", 20, "A32,A31"), 5: ("ENGEL", 20, "A31"), 6: ("TUR", None, ""), 7: ("TUR", None, ""), 8: ("EKSIK", None, ""), 9: ("TASLAK", 0, ""),
    }
    lines = {}
    for r in drafts.draft_lines(made).orderBy("doc_id", "line_no").collect():
        lines.setdefault(r.doc_id, []).append((r.account, r.debit_kr, r.credit_kr))
    assert lines == {
        1: [("120", 1200, 0), ("600", 0, 1000), ("391.06", 0, 200)], 2: [("153", 1000, 0), ("191.06", 100, 0), ("191.06", 100, 0), ("360", 0, 100), ("320", 0, 1100)], 3: [("120", 1130, 0), ("600", 0, 1000), ("391", 0, 130)],
        9: [("153", 500, 0), ("320", 0, 500)],
    }
    assert drafts.drafts(spark.createDataFrame([], DOCS), {}).count() == 0


def test_drafts_from_fields(spark):
    rows = [(1, "matrah", "10,00", 1000, True), (1, "kdv", "2,00", 200, True), (1, "toplam", "12,00", 1200, True), (1, "yon", "SATIS", None, True), (2, "matrah", "10,00", 1000, True), (2, "kdv", "2,00", 200, False), (2, "toplam", " ", None, True)]
    values = spark.createDataFrame(rows, "doc_id long, field string, value string, number long, approved boolean")
    got = drafts.from_fields(values, ["matrah", "kdv", "toplam"], {"base_kr": "matrah", "vat_kr": "kdv", "total_kr": "toplam"}, {"direction": "yon"})
    assert {r.doc_id: (r.base_kr, r.vat_kr, r.total_kr, r.direction, r.complete) for r in got.collect()} == {1: (1000, 200, 1200, "SATIS", True), 2: (1000, 200, None, None, False)}
