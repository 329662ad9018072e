"""Queries over returns as they are filed and over draft vouchers of read invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import div, kurus
from tallyspark.operators import drafts, returns
from tallyspark.sources.model import over, table, view

#: Rates of the model's sub-accounts; returned goods (191.01) have mixed rates and no entry.
RATES = {f"391.0{r}": r for r in range(1, 9)} | {"191.02": 10}
#: VAT rates and the sub-accounts they are booked on, fixed values.
CODES = {0: "01", 1: "02", 8: "03", 10: "04", 18: "05", 20: "06"}

_j = lambda s, d: view(s, d, "journal")


def _invoices(s, d):
    """Of every thirteenth sale the buyer withholds half of the tax."""
    return view(s, d, "sales").withColumn("withheld_kr", F.when(F.col("no") % 13 == 0, div(F.col("vat_kr"), 2)).otherwise(0))


def _manual(s, d):
    """Lines that a person added, one for each fiftieth order."""
    o = table(s, d, "orders").where("o_orderkey % 50 = 0")
    return o.select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.when(F.col("o_orderkey") % 100 == 0, returns.DEDUCTED).otherwise(returns.COMPUTED).alias("direction"), F.col("o_orderkey").cast("string").alias("name"), kurus("o_totalprice").alias("base_kr"), div(kurus("o_totalprice"), 10).alias("vat_kr"))


def _closed(s, d):
    """The journal with the offset voucher of each month."""
    j = _j(s, d)
    return j.unionByName(returns.offset_lines(returns.monthly_offsets(j)).select(j.columns))


def _refused(s, d):
    """The journal with an expense that is not deductible, of a thousandth of each fifth order."""
    o = table(s, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("no"), F.col("o_orderdate").cast("date").alias("date"), div(kurus("o_totalprice"), 1000).alias("kr"))
    zero = F.lit(0).cast("bigint")
    leg = lambda i, account, debit, credit: F.struct(F.lit(i).alias("line_no"), F.lit(account).alias("account"), debit.alias("debit_kr"), credit.alias("credit_kr"))
    lines = o.select((F.lit(7_000_000_000_000) + F.col("no")).alias("voucher"), F.lit("expense").alias("kind"), "date", F.col("no").alias("doc_no"), F.inline(F.array(leg(1, "689", F.col("kr"), zero), leg(2, "100", zero, F.col("kr")))))
    return _j(s, d).unionByName(lines.select(_j(s, d).columns))


def _adjusted(s, d):
    """What is added to and exempt from a quarter's profit, by hand."""
    o = table(s, d, "orders").where("o_orderkey % 50 = 0")
    return o.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.when(F.col("o_orderkey") % 100 == 0, "kkeg").otherwise("istisna").alias("kind"), div(kurus("o_totalprice"), 4).alias("amount_kr"))


def _read(s, d):
    """Sales and purchases as read invoices, with receipts, missing fields, too much withheld and wrong totals among them."""
    no = F.col("no")
    cols = ["no", "net_kr", "vat_kr", "gross_kr"]
    both = view(s, d, "sales").select(*cols, F.lit("Satış faturası").alias("direction"), F.lit("S").alias("p")).unionByName(view(s, d, "purchases").select(*cols, F.lit("alis").alias("direction"), F.lit("A").alias("p")))
    held = F.when(no % 23 == 0, F.col("vat_kr") + 1).when(no % 5 == 0, div(F.col("vat_kr"), 2))
    return both.select(
        F.concat("p", no.cast("string")).alias("doc_id"), F.when(no % 17 == 0, "MAKBUZ").otherwise("FATURA").alias("kind"), "direction", (no % 19 != 0).alias("complete"), F.col("net_kr").alias("base_kr"), "vat_kr",
        (F.col("gross_kr") + F.when(no % 29 == 0, 7).otherwise(0)).alias("total_kr"), held.cast("bigint").alias("withheld_kr"),
    )


def _drafts(s, d):
    return view(s, d, "drafts", lambda s, d: drafts.drafts(_read(s, d), CODES))


#: Offset vouchers by recursion: what a leaf leaves open, then what is carried.
_OFFSETS_SQL = """WITH leaf AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, account, CAST(sum(CASE WHEN account LIKE '391%' THEN credit_kr - debit_kr ELSE debit_kr - credit_kr END) AS BIGINT) AS net FROM journal WHERE account LIKE '391.%' OR account LIKE '191.%' GROUP BY ALL),
lk AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month) AS i FROM leaf),
cl(account, i, month, closed, rest) AS (SELECT account, i, month, greatest(net, 0)::BIGINT, least(net, 0)::BIGINT FROM lk WHERE i = 1 UNION ALL SELECT lk.account, lk.i, lk.month, greatest(rest + net, 0)::BIGINT, least(rest + net, 0)::BIGINT FROM cl JOIN lk ON lk.account = cl.account AND lk.i = cl.i + 1),
mo AS (SELECT month, CAST(coalesce(sum(closed) FILTER (account LIKE '391%'), 0) AS BIGINT) AS hes, CAST(coalesce(sum(closed) FILTER (account LIKE '191%'), 0) AS BIGINT) AS ind, row_number() OVER (ORDER BY month) AS i FROM cl GROUP BY month),
ca(i, month, hes, ind, cin, cout) AS (SELECT i, month, hes, ind, 0::BIGINT, greatest(ind - hes, 0)::BIGINT FROM mo WHERE i = 1 UNION ALL SELECT mo.i, mo.month, mo.hes, mo.ind, cout, greatest(mo.ind + cout - mo.hes, 0)::BIGINT FROM ca JOIN mo ON mo.i = ca.i + 1),
ol AS (SELECT month, CASE WHEN account LIKE '391%' THEN 1 ELSE 2 END AS part, account, CASE WHEN account LIKE '391%' THEN closed ELSE 0 END AS debit_kr, CASE WHEN account LIKE '391%' THEN 0 ELSE closed END AS credit_kr FROM cl WHERE closed > 0
  UNION ALL SELECT month, 3, '190', 0, cin FROM ca WHERE cin > 0 UNION ALL SELECT month, 4, '360', 0, hes - ind - cin FROM ca WHERE hes > ind + cin UNION ALL SELECT month, 4, '190', cout, 0 FROM ca WHERE cout > 0),
offs AS (SELECT month, CAST(row_number() OVER (PARTITION BY month ORDER BY part, account) AS INTEGER) AS line_no, account, CAST(debit_kr AS BIGINT) AS debit_kr, CAST(credit_kr AS BIGINT) AS credit_kr FROM ol)"""
_MANUAL_SQL = "man AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN o_orderkey % 100 = 0 THEN 'indirim' ELSE 'hesaplanan' END AS direction, CAST(o_orderkey AS VARCHAR) AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS base_kr, CAST(round(o_totalprice * 100) AS BIGINT) // 10 AS vat_kr FROM orders WHERE o_orderkey % 50 = 0)"
_LEAVES_SQL = "lv AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, account, CAST(sum(CASE WHEN account LIKE '391%' THEN credit_kr - debit_kr ELSE debit_kr - credit_kr END) AS BIGINT) AS vat_kr FROM journal WHERE account LIKE '391.%' OR account LIKE '191.%' GROUP BY ALL)"
_SECTIONS_SQL = f"""WITH {_MANUAL_SQL}, {_LEAVES_SQL}, rt AS (SELECT *, CASE WHEN account = '191.02' THEN 10 WHEN account LIKE '391.0%' THEN CAST(right(account, 1) AS INTEGER) ELSE 20 END AS rate FROM lv WHERE vat_kr > 0),
inv AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN no % 13 = 0 THEN vat_kr // 2 ELSE 0 END AS held FROM sale WHERE valid)
SELECT month, CASE WHEN account LIKE '391%' THEN 'hesaplanan' ELSE 'indirim' END AS section, account AS code, rate, vat_kr * 100 // rate AS base_kr, vat_kr, CAST(0 AS BIGINT) AS withheld_kr, CAST(NULL AS BIGINT) AS documents FROM rt
UNION ALL SELECT month, 'istisna', NULL, NULL, CAST(sum(net_kr - return_net_kr - discount_net_kr) AS BIGINT), 0, 0, count(*) FROM inv WHERE vat_kr = 0 GROUP BY month
UNION ALL SELECT month, 'tevkifat', NULL, NULL, CAST(sum(net_kr) AS BIGINT), CAST(sum(vat_kr) AS BIGINT), CAST(sum(held) AS BIGINT), count(*) FROM inv WHERE held > 0 GROUP BY month
UNION ALL SELECT month, 'manuel ' || direction, name, NULL, base_kr, vat_kr, 0, NULL FROM man"""
_FILED_SQL = f"""{_OFFSETS_SQL}, {_MANUAL_SQL}, {_LEAVES_SQL}, ms AS (SELECT DISTINCT month FROM lv UNION SELECT DISTINCT month FROM man),
sums AS (SELECT month, coalesce((SELECT sum(greatest(vat_kr, 0)) FROM lv WHERE lv.month = ms.month AND account LIKE '391%'), 0) + coalesce((SELECT sum(vat_kr) FROM man WHERE man.month = ms.month AND direction = 'hesaplanan'), 0) AS c, coalesce((SELECT sum(vat_kr) FROM lv WHERE lv.month = ms.month AND account LIKE '191%'), 0) AS d,
  coalesce((SELECT sum(vat_kr) FROM man WHERE man.month = ms.month AND direction = 'indirim'), 0) AS x, greatest(coalesce((SELECT sum(debit_kr - credit_kr) FROM offs WHERE account = '190' AND offs.month < ms.month), 0), 0) AS cin FROM ms)
SELECT month, CAST(c AS BIGINT) AS computed_kr, CAST(cin AS BIGINT) AS carried_in_kr, CAST(d AS BIGINT) AS deductible_kr, CAST(d + cin + x AS BIGINT) AS deductions_kr, CAST(greatest(c - d - cin - x, 0) AS BIGINT) AS payable_kr, CAST(greatest(d + cin + x - c, 0) AS BIGINT) AS carried_out_kr FROM sums"""
_ADVANCE_SQL = """WITH jj AS (SELECT date, account, debit_kr, credit_kr FROM journal UNION ALL SELECT CAST(o_orderdate AS DATE), '689', CAST(round(o_totalprice * 100) AS BIGINT) // 1000, 0 FROM orders WHERE o_orderkey % 5 = 0),
pl AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, account, debit_kr, credit_kr FROM jj WHERE account LIKE '6%' AND account NOT LIKE '69%'), yq AS (SELECT year, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS quarter FROM (SELECT DISTINCT year FROM pl)),
ad AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, o_orderkey % 100 = 0 AS added, CAST(round(o_totalprice * 100) AS BIGINT) // 4 AS kr FROM orders WHERE o_orderkey % 50 = 0),
s AS (SELECT yq.year, yq.quarter, coalesce((SELECT sum(credit_kr - debit_kr) FROM pl WHERE pl.year = yq.year AND pl.quarter <= yq.quarter), 0) AS p, greatest(coalesce((SELECT sum(debit_kr - credit_kr) FROM pl WHERE pl.year = yq.year AND pl.quarter <= yq.quarter AND account = '689'), 0), 0) AS r,
  coalesce((SELECT sum(kr) FROM ad WHERE ad.year = yq.year AND ad.quarter = yq.quarter AND added), 0) AS a, coalesce((SELECT sum(kr) FROM ad WHERE ad.year = yq.year AND ad.quarter = yq.quarter AND NOT added), 0) AS e FROM yq),
t AS (SELECT *, CAST(greatest(p + r + a - e, 0) AS BIGINT) AS base FROM s), u AS (SELECT *, base * 25 // 100 AS tax, coalesce(lag(base * 25 // 100) OVER (PARTITION BY year ORDER BY quarter), 0) AS before FROM t)
SELECT year, quarter, CAST(p AS BIGINT) AS profit_kr, CAST(r AS BIGINT) AS refused_kr, CAST(a AS BIGINT) AS added_kr, CAST(e AS BIGINT) AS exempt_kr, base AS base_kr, tax AS computed_kr, before AS before_kr, greatest(tax - before, 0) AS payable_kr FROM u"""
_CODES_SQL = ", ".join(f"({r}, '{c}')" for r, c in CODES.items())
_DRAFTS_SQL = f"""WITH cat(r, code) AS (VALUES {_CODES_SQL}), both_ AS (SELECT no, net_kr AS base, vat_kr AS vat, gross_kr AS gross, true AS out, 'S' || CAST(no AS VARCHAR) AS doc_id FROM sale UNION ALL SELECT no, net_kr, vat_kr, gross_kr, false, 'A' || CAST(no AS VARCHAR) FROM purchase),
x AS (SELECT doc_id, out, base, vat, gross + CASE WHEN no % 29 = 0 THEN 7 ELSE 0 END AS whole, CASE WHEN no % 23 = 0 THEN vat + 1 WHEN no % 5 = 0 THEN vat // 2 ELSE 0 END AS held, CASE WHEN base > 0 THEN CAST(round(vat * 100.0::DOUBLE / base) AS BIGINT) ELSE 0 END AS rate, no % 17 = 0 AS other, no % 19 = 0 AS lacks FROM both_),
y AS (SELECT x.*, code, greatest(vat - held, 0) AS own, greatest(whole - held, 0) AS due FROM x LEFT JOIN cat ON r = rate),
z AS (SELECT *, CASE WHEN out THEN due <> base + own ELSE base + own + held <> held + due END AS uneven, held > vat AS excess FROM y),
st AS (SELECT *, CASE WHEN other THEN 'TUR' WHEN lacks THEN 'EKSIK' WHEN excess OR uneven THEN 'ENGEL' ELSE 'TASLAK' END AS status FROM z)"""
_DRAFT_LINES_SQL = """, legs AS (SELECT doc_id, n, account, d, c FROM (SELECT doc_id, unnest(CASE WHEN out THEN [{'n': 1, 'account': '120', 'd': due, 'c': 0, 'w': true}, {'n': 2, 'account': '600', 'd': 0, 'c': base, 'w': true}, {'n': 3, 'account': '391' || coalesce('.' || code, ''), 'd': 0, 'c': own, 'w': own > 0}]
  ELSE [{'n': 1, 'account': '153', 'd': base, 'c': 0, 'w': true}, {'n': 2, 'account': '191' || coalesce('.' || code, ''), 'd': own, 'c': 0, 'w': own > 0}, {'n': 3, 'account': '191' || coalesce('.' || code, ''), 'd': held, 'c': 0, 'w': held > 0}, {'n': 4, 'account': '360', 'd': 0, 'c': held, 'w': held > 0}, {'n': 5, 'account': '320', 'd': 0, 'c': due, 'w': true}] END, recursive := true) FROM st WHERE status = 'TASLAK') WHERE w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS line_no, account, CAST(d AS BIGINT) AS debit_kr, CAST(c AS BIGINT) AS credit_kr FROM legs"""
_DRAFT_STATUS_SQL = " SELECT doc_id, status, CASE WHEN status IN ('TASLAK', 'ENGEL') THEN rate END AS rate, CASE WHEN status IN ('TASLAK', 'ENGEL') THEN array_to_string(list_filter([CASE WHEN vat > 0 AND code IS NULL THEN 'A30' END, CASE WHEN excess THEN 'A32' END, CASE WHEN uneven THEN 'A31' END], lambda v: v IS NOT NULL), ',') ELSE '' END AS findings FROM st"

QUERIES = {
    "vat_offset_postings": (lambda s, d: returns.monthly_offsets(_j(s, d)), over("journal", _OFFSETS_SQL + " SELECT * FROM offs")),
    "vat_return_sections": (lambda s, d: returns.vat_sections(_closed(s, d), _invoices(s, d), _manual(s, d), RATES), over("journal", _SECTIONS_SQL)),
    "vat_return_filed": (lambda s, d: returns.vat_filed(_closed(s, d), _manual(s, d)), over("journal", _FILED_SQL)),
    "advance_tax_filed": (lambda s, d: returns.advance_tax_filed(_refused(s, d), _adjusted(s, d)), over("journal", _ADVANCE_SQL)),
    "draft_vouchers": (lambda s, d: drafts.draft_lines(_drafts(s, d)), over("sale purchase", _DRAFTS_SQL + _DRAFT_LINES_SQL)),
    "draft_findings": (lambda s, d: _drafts(s, d).drop("lines"), over("sale purchase", _DRAFTS_SQL + _DRAFT_STATUS_SQL)),
}
DATES = dict.fromkeys(("vat_offset_postings", "vat_return_sections", "vat_return_filed"), ["month"])
