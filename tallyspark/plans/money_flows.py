"""Queries over tax and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import kurus
from tallyspark.operators import allocation, allocation_ledger, tax
from tallyspark.sources.model import order_lines, over, table, view

_j = lambda s, d: view(s, d, "journal")
_s = lambda s, d: view(s, d, "sales")


def _open(s, d):
    return _s(s, d).withColumn("open_kr", F.col("net_debt_kr"))


def _money(s, d):
    return view(s, d, "receipts").withColumn("open_kr", F.col("amount_kr"))


def _decisions(s, d):
    """Every seventh receipt is meant for an invoice of its own number, or of another party's."""
    return view(s, d, "receipts").where("id % 7 = 0").select("id", F.when(F.col("id") % 21 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("no"))


def _frozen(s, d):
    return view(s, d, "frozen", _old)


def _old(s, d):
    """Receipts of the first two years keep what they had when only those years were known."""
    old = lambda df: df.where("date < '1997-01-01'")
    return allocation.fifo(old(_open(s, d)), old(_money(s, d)))


def _all(s, d):
    return view(s, d, "allocation", _allocated)


def _allocated(s, d):
    return allocation.allocate(_open(s, d), _money(s, d), _frozen(s, d), _decisions(s, d))


def _paid(s, d):
    """What was paid to suppliers, to their invoices."""
    return view(s, d, "paid", lambda s, d: allocation.fifo(view(s, d, "purchases").withColumn("open_kr", F.col("gross_kr")), view(s, d, "payments").withColumn("open_kr", F.col("amount_kr"))))


def _synced(s, d):
    """The ledger after the first two years, brought to what is allocated now."""
    first = allocation_ledger.synced(s.createDataFrame([], allocation_ledger.SCHEMA), _frozen(s, d).withColumn("source", F.lit("FIFO")))
    return allocation_ledger.synced(view(s, d, "ledger1", lambda s, d: first), _all(s, d))


def _status(s, d):
    return allocation.receipt_status(_money(s, d), _all(s, d), _decisions(s, d))


def _fifo_sql(inv: str, rec: str) -> str:
    """(id, no, amount_kr) from invoices (party, no, date, open_kr) and receipts (party, id, date, open_kr)."""
    return f"""SELECT id, no, CAST(least(a.u, b.u) - greatest(a.s, b.s) AS BIGINT) AS amount_kr FROM
 (SELECT party, id, u, coalesce(lag(u) OVER (PARTITION BY party ORDER BY date, id), 0) AS s FROM (SELECT party, id, date, p + least(0, min(c - p) OVER (PARTITION BY party ORDER BY date, id)) AS u FROM (
   SELECT r.party, r.id, r.date, sum(r.open_kr) OVER (PARTITION BY r.party ORDER BY r.date, r.id) AS p, coalesce((SELECT sum(open_kr) FROM {inv} i WHERE i.party = r.party AND i.date <= r.date AND i.open_kr > 0), 0) AS c FROM {rec} r WHERE r.party IS NOT NULL AND r.open_kr > 0))) a
 JOIN (SELECT party, no, sum(open_kr) OVER (PARTITION BY party ORDER BY date, no) AS u, sum(open_kr) OVER (PARTITION BY party ORDER BY date, no) - open_kr AS s FROM {inv} WHERE open_kr > 0) b
 ON a.party = b.party AND least(a.u, b.u) > greatest(a.s, b.s)"""


_BASE = "WITH inv AS (SELECT no, party, date, net_debt_kr AS open_kr FROM sale), rec AS (SELECT id, party, date, amount_kr AS open_kr, instrument, bank FROM receipt), dec AS (SELECT id, CASE WHEN id % 21 = 0 THEN id + 1 ELSE id END AS no FROM receipt WHERE id % 7 = 0)"
_MANUAL = "SELECT id, no, CAST(u - s AS BIGINT) AS amount_kr FROM (SELECT *, coalesce(lag(u) OVER (PARTITION BY no ORDER BY date, id), 0) AS s FROM (SELECT d.id, d.no, r.date, least(i.open_kr, sum(r.open_kr) OVER (PARTITION BY d.no ORDER BY r.date, d.id)) AS u FROM dec d JOIN {1} r ON r.id = d.id JOIN {0} i ON i.no = d.no WHERE (r.party IS NULL OR r.party = i.party) AND i.open_kr > 0 AND r.open_kr > 0)) WHERE u > s"
_ALL = (
    _BASE + ", inv0 AS (SELECT * FROM inv WHERE date < DATE '1997-01-01'), rec0 AS (SELECT * FROM rec WHERE date < DATE '1997-01-01'), frozen AS (" + _fifo_sql("inv0", "rec0") + "), kept AS (SELECT * FROM frozen WHERE no NOT IN (SELECT no FROM dec) AND id NOT IN (SELECT id FROM dec)),"
    " inv1 AS (SELECT no, party, date, open_kr - coalesce((SELECT sum(amount_kr) FROM kept k WHERE k.no = inv.no), 0) AS open_kr FROM inv), rec1 AS (SELECT id, party, date, open_kr - coalesce((SELECT sum(amount_kr) FROM kept k WHERE k.id = rec.id), 0) AS open_kr FROM rec),"
    " hand AS (" + _MANUAL.format("inv1", "rec1") + "), inv2 AS (SELECT no, party, date, open_kr - coalesce((SELECT sum(amount_kr) FROM hand h WHERE h.no = inv1.no), 0) AS open_kr FROM inv1), rec2 AS (SELECT * FROM rec1 WHERE id NOT IN (SELECT id FROM dec)),"
    " alloc AS (SELECT *, 'DONMUS' AS source FROM kept UNION ALL SELECT *, 'MANUEL' FROM hand UNION ALL SELECT *, 'FIFO' FROM (" + _fifo_sql("inv2", "rec2") + "))"
)
_SYNC_SQL = """, w1 AS (SELECT DISTINCT id, no, amount_kr, CAST(id AS VARCHAR) || '|' || CAST(no AS VARCHAR) || '|' || CAST(amount_kr AS VARCHAR) AS key FROM frozen), l1 AS (SELECT *, row_number() OVER (ORDER BY key) AS serial FROM w1),
w2 AS (SELECT id, no, amount_kr, min(CASE WHEN source = 'MANUEL' THEN 'MANUEL' ELSE 'OTOMATIK' END) AS source, CAST(id AS VARCHAR) || '|' || CAST(no AS VARCHAR) || '|' || CAST(amount_kr AS VARCHAR) AS key FROM alloc GROUP BY id, no, amount_kr),
gone AS (SELECT *, (SELECT max(serial) FROM l1) + row_number() OVER (ORDER BY serial) AS stn FROM l1 WHERE key NOT IN (SELECT key FROM w2)), new AS (SELECT *, (SELECT max(serial) FROM l1) + (SELECT count(*) FROM gone) + row_number() OVER (ORDER BY key) AS serial FROM w2 WHERE key NOT IN (SELECT key FROM l1))
SELECT l1.serial, l1.key, format('THS-F{:06d}', l1.serial) AS voucher_no, l1.id, l1.no, l1.amount_kr, 'OTOMATIK' AS source, CASE WHEN stn IS NULL THEN 'AKTIF' ELSE 'IPTAL' END AS state, CASE WHEN stn IS NOT NULL THEN format('STR-{:06d}', stn) END AS counter, false AS reversal FROM l1 LEFT JOIN gone ON gone.serial = l1.serial
UNION ALL SELECT stn, 'STORNO|' || key, format('STR-{:06d}', stn), id, no, amount_kr, 'OTOMATIK', 'AKTIF', format('THS-F{:06d}', serial), true FROM gone UNION ALL SELECT serial, key, format('THS-F{:06d}', serial), id, no, amount_kr, source, 'AKTIF', NULL, false FROM new"""
_OUTCOMES_SQL = """, diff AS (SELECT id, no, CAST(sum(a) AS BIGINT) AS now_kr, CAST(greatest(sum(b) - sum(a), 0) AS BIGINT) AS lost FROM (SELECT id, no, amount_kr AS a, 0 AS b FROM alloc UNION ALL SELECT id, no, 0, amount_kr FROM f) GROUP BY id, no),
o AS (SELECT d.id, d.no, r.amount_kr, i.net_debt_kr, coalesce((SELECT sum(now_kr) FROM diff x WHERE x.id = d.id AND x.no = d.no), 0) AS w, coalesce((SELECT sum(now_kr) FROM diff x WHERE x.id = d.id), 0) AS g, coalesce((SELECT sum(lost) FROM diff x WHERE x.id = d.id), 0) AS m,
 coalesce((SELECT sum(lost) FROM diff x WHERE x.no = d.no AND x.id <> d.id), 0) AS dr, coalesce((SELECT sum(now_kr) FROM diff x WHERE x.no = d.no), 0) AS p FROM dec d JOIN receipt r ON r.id = d.id JOIN sale i ON i.no = d.no)
SELECT id, no, amount_kr, CAST(w AS BIGINT) AS written_kr, CAST(g - w AS BIGINT) AS elsewhere_kr, CAST(greatest(amount_kr - g, 0) AS BIGINT) AS advance_kr, CAST(m AS BIGINT) AS moved_kr, CAST(dr AS BIGINT) AS dropped_kr,
 CASE WHEN w = 0 THEN 'YAZILAMADI' WHEN w < amount_kr THEN 'KISMEN_YAZILDI' WHEN net_debt_kr > p THEN 'TAM_YAZILDI_FATURA_ACIK' ELSE 'TAM_YAZILDI_FATURA_KAPANDI' END AS outcome FROM o"""
_PAID = "pinv AS (SELECT no, party, date, gross_kr AS open_kr FROM purchase), pay AS (SELECT id, party, date, amount_kr AS open_kr, instrument, bank FROM payment), palloc AS (" + _fifo_sql("pinv", "pay") + ")"
_ACCOUNT = "CASE instrument WHEN 'NAKIT' THEN '100' WHEN 'CEK' THEN CASE WHEN direction = 'SATIS' THEN '101' ELSE '103' END WHEN 'SENET' THEN CASE WHEN direction = 'SATIS' THEN '121' ELSE '321' END ELSE '102' END"
_MONEY_SQL = f", m AS (SELECT *, {_ACCOUNT} AS account FROM (SELECT 'SATIS' AS direction, a.id, a.no, instrument, amount_kr FROM alloc a JOIN rec ON rec.id = a.id UNION ALL SELECT 'ALIS', a.id, a.no, instrument, amount_kr FROM palloc a JOIN pay ON pay.id = a.id))"
_LEGS = (
    _MONEY_SQL + ", k AS (SELECT direction, no, CASE WHEN count(DISTINCT instrument) > 1 THEN 'KARMA' ELSE min(instrument) END AS instrument, CAST(sum(amount_kr) AS BIGINT) AS amount_kr FROM m GROUP BY direction, no), l AS (SELECT direction, no, account, CAST(sum(amount_kr) AS BIGINT) AS amount_kr FROM m GROUP BY ALL),"
    " x AS (SELECT l.direction, l.no, instrument, account, l.amount_kr, l.direction = 'SATIS' AS debit FROM l JOIN k ON k.no = l.no AND k.direction = l.direction UNION ALL SELECT direction, no, instrument, CASE WHEN direction = 'SATIS' THEN '120' ELSE '320' END, amount_kr, direction <> 'SATIS' FROM k)"
    " SELECT direction, no, instrument, account, CASE WHEN debit THEN amount_kr ELSE 0 END AS debit_kr, CASE WHEN debit THEN 0 ELSE amount_kr END AS credit_kr FROM x"
)
_STATUS = ", status AS (SELECT r.id, r.party, r.open_kr AS amount_kr, CAST(coalesce(g, 0) AS BIGINT) AS allocated_kr, CAST(r.open_kr - coalesce(g, 0) AS BIGINT) AS remaining_kr, CASE WHEN d.id IS NOT NULL AND coalesce(g, 0) > 0 THEN 'MANUEL' WHEN r.party IS NULL OR coalesce(g, 0) = 0 THEN 'BEKLIYOR' ELSE 'OTOMATIK' END AS status FROM rec r LEFT JOIN (SELECT id AS k, sum(amount_kr) AS g FROM alloc GROUP BY id) ON k = r.id LEFT JOIN (SELECT DISTINCT id FROM dec) d ON d.id = r.id)"


def _corrupt(s, d):
    """Allocations with planted faults, for checks that must find them."""
    k = F.col("id") % 101
    void = _s(s, d).where("not valid").agg(F.min("no")).first()[0]
    a = _all(s, d).select("id", "no", "amount_kr")
    return a.withColumn("amount_kr", F.when(k == 1, F.col("amount_kr") * 10).when(k == 2, -F.col("amount_kr")).otherwise(F.col("amount_kr"))).withColumn("no", F.when(k == 3, F.lit(void)).otherwise(F.col("no")))


def _corrupted(s, d):
    return view(s, d, "corrupted", _corrupt)


def _checked(s, d):
    """Findings over the planted faults; what invoices and receipts record is what the faultless allocation gave them."""
    bad = _corrupted(s, d)
    owed = _s(s, d).join(bad.groupBy("no").agg(F.sum("amount_kr").alias("paid")), "no", "left").withColumn("remaining_kr", F.col("net_debt_kr") - F.coalesce("paid", F.lit(0)))
    money = _money(s, d).join(_status(s, d).select("id", "allocated_kr"), "id")
    return allocation.invariants(owed, money, bad, _j(s, d))


_CORRUPT_SQL = ", bad AS (SELECT id, CASE WHEN id % 101 = 3 THEN (SELECT min(no) FROM sale WHERE NOT valid) ELSE no END AS no, CASE WHEN id % 101 = 1 THEN amount_kr * 10 WHEN id % 101 = 2 THEN -amount_kr ELSE amount_kr END AS amount_kr FROM alloc)"


def _requests(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 5).when(F.col("o_orderkey") % 35 == 0, F.lit(-1)).otherwise(F.col("o_orderkey")).alias("no"))


def _rates(spark):
    rows = [(r, f"391.0{r}", "1990-01-01", "1996-12-31") for r in range(0, 9)] + [(r, f"391.1{r}", "1997-01-01", None) for r in range(1, 9)]
    return spark.createDataFrame(rows, "rate long, code string, a string, b string").select("rate", "code", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))


_RATES_SQL = "rates AS (SELECT r AS rate, '391.0' || CAST(r AS VARCHAR) AS code, DATE '1990-01-01' AS valid_from, DATE '1996-12-31' AS valid_to FROM range(0, 9) t(r) UNION ALL SELECT r, '391.1' || CAST(r AS VARCHAR), DATE '1997-01-01', NULL FROM range(1, 9) t(r))"


def _priced(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("no"), kurus("o_totalprice").alias("amount"), (F.col("o_orderkey") % 20 + 1).alias("rate"))


def _calc(s, d):
    p = _priced(s, d)
    out = p.select("no", tax.vat_calculation(False, F.col("amount"), F.col("rate"), 2, 10).alias("a"), tax.vat_calculation(True, F.col("amount"), F.col("rate"), 9, 10).alias("b"))
    return out.select("no", *[F.col(f"{k}.{c}").alias(f"{c}_{n}") for k, n in (("a", "from_net"), ("b", "from_gross")) for c in ("net_kr", "vat_kr", "withheld_kr", "gross_kr")])


def _held(s, d):
    out = _priced(s, d).select("no", tax.withholding(True, F.col("amount"), 20).alias("a"), tax.withholding(False, F.col("amount"), 17).alias("b"))
    return out.select("no", *[F.col(f"{k}.{c}").alias(f"{c}_{n}") for k, n in (("a", "from_gross"), ("b", "from_net")) for c in ("gross_kr", "tax_kr", "net_kr")])


def _duties(s, d):
    fixed = F.when(F.col("rate") == 7, F.lit(12_345))
    out = _priced(s, d).select("no", tax.stamp_duty(F.col("amount"), 9.48).alias("stamp_kr"), tax.excise(F.col("amount"), 25, fixed, 20).alias("e"))
    return out.select("no", "stamp_kr", F.col("e.excise_kr").alias("excise_kr"), F.col("e.vat_kr").alias("vat_kr"))


def _expenses(s, d):
    rule = F.element_at(F.array(*map(F.lit, ("TAMAMI", "ORANSAL", "HADDI_ASAN", "KISMEN", "YOK"))), (F.col("no") % 5 + 1).cast("int"))
    return _priced(s, d).select(F.col("no").alias("id"), "amount", rule.alias("rule"), (F.col("rate") * 5).alias("share"), F.when(F.col("no") % 11 != 0, F.lit(10_000_000)).cast("bigint").alias("limit_kr")).withColumnRenamed("amount", "amount_kr")


_PRICED = "priced AS (SELECT o_orderkey AS no, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderkey % 20 + 1 AS rate FROM orders)"

QUERIES = {
    "vat_offset": (lambda s, d: tax.vat_offset(_j(s, d)), over("journal", "WITH n AS (SELECT account, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS n FROM journal WHERE account LIKE '391%' OR account LIKE '191%' OR account LIKE '190%' GROUP BY account), l AS (SELECT account, greatest(-n, 0) AS debit_kr, greatest(n, 0) AS credit_kr FROM n WHERE (account LIKE '391%' AND n < 0) OR (account NOT LIKE '391%' AND n > 0)), o AS (SELECT CAST(sum(debit_kr - credit_kr) AS BIGINT) AS o FROM l) SELECT * FROM l UNION ALL SELECT CASE WHEN o > 0 THEN '360' ELSE '190' END, greatest(-o, 0), greatest(o, 0) FROM o WHERE o <> 0")),
    "vat_status": (lambda s, d: tax.vat_status(_j(s, d)), over("journal", "SELECT CAST(greatest(coalesce(sum(CASE WHEN account LIKE '391%' THEN credit_kr - debit_kr END), 0), 0) AS BIGINT) AS computed_kr, CAST(greatest(coalesce(sum(CASE WHEN account LIKE '191%' THEN debit_kr - credit_kr END), 0), 0) AS BIGINT) AS deductible_kr, CAST(0 AS BIGINT) AS carried_kr FROM journal")),
    "vat_return": (
        lambda s, d: tax.vat_return(_j(s, d)),
        over("journal", "WITH o AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(CASE WHEN account LIKE '391%' THEN credit_kr - debit_kr ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN account LIKE '191%' THEN debit_kr - credit_kr ELSE 0 END) AS BIGINT) AS d FROM journal WHERE account LIKE '391%' OR account LIKE '191%' GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY month) AS i FROM o), r(i, month, c, d, cin, cout) AS (SELECT i, month, c, d, 0::BIGINT, greatest(d - c, 0)::BIGINT FROM k WHERE i = 1 UNION ALL SELECT k.i, k.month, k.c, k.d, r.cout, greatest(r.cout + k.d - k.c, 0)::BIGINT FROM r JOIN k ON k.i = r.i + 1) SELECT month, c AS computed_kr, d AS deductible_kr, cin AS carry_in_kr, greatest(c - d - cin, 0) AS payable_kr, cout AS carry_out_kr FROM r"),
    ),
    "vat_by_rate": (lambda s, d: tax.vat_by_rate(_j(s, d)), over("journal", "SELECT *, vat_kr * 100 // rate AS base_kr FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(split_part(account, '.', 2) AS INTEGER) AS rate, CAST(sum(credit_kr - debit_kr) AS BIGINT) AS vat_kr FROM journal WHERE account LIKE '391.%' GROUP BY 1, 2) WHERE vat_kr > 0 AND rate > 0")),
    "advance_tax": (lambda s, d: tax.advance_tax(_j(s, d)), over("journal", "WITH q AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(sum(credit_kr - debit_kr) AS BIGINT) AS o FROM journal WHERE account LIKE '6%' AND account NOT LIKE '69%' GROUP BY 1, 2), c AS (SELECT year, quarter, CAST(sum(o) OVER (PARTITION BY year ORDER BY quarter) AS BIGINT) AS profit_kr FROM q), t AS (SELECT *, greatest(profit_kr, 0) * 25 // 100 AS computed_kr FROM c) SELECT *, greatest(computed_kr - coalesce(lag(computed_kr) OVER (PARTITION BY year ORDER BY quarter), 0), 0) AS payable_kr FROM t")),
    "rate_as_of": (lambda s, d: tax.rates_as_of(order_lines(s, d).select("no", "rate", F.col("ship_date").alias("date")).distinct(), _rates(s)).groupBy("code").count(), over("line", f"WITH {_RATES_SQL} SELECT code, count(*) AS count FROM (SELECT DISTINCT no, rate, ship_date FROM line) l LEFT JOIN rates r ON r.rate = l.rate AND ship_date >= valid_from AND (valid_to IS NULL OR ship_date <= valid_to) GROUP BY code")),
    "vat_calc": (_calc, f"WITH {_PRICED} SELECT no, amount AS net_kr_from_net, amount * rate // 100 AS vat_kr_from_net, (amount * rate // 100) * 2 // 10 AS withheld_kr_from_net, amount + amount * rate // 100 AS gross_kr_from_net, amount * 100 // (100 + rate) AS net_kr_from_gross, amount - amount * 100 // (100 + rate) AS vat_kr_from_gross, (amount - amount * 100 // (100 + rate)) * 9 // 10 AS withheld_kr_from_gross, amount AS gross_kr_from_gross FROM priced"),
    "withholding_calc": (_held, f"WITH {_PRICED} SELECT no, amount AS gross_kr_from_gross, amount * 20 // 100 AS tax_kr_from_gross, amount - amount * 20 // 100 AS net_kr_from_gross, amount * 100 // 83 AS gross_kr_from_net, amount * 100 // 83 - amount AS tax_kr_from_net, amount AS net_kr_from_net FROM priced"),
    "stamp_and_excise": (_duties, f"WITH {_PRICED}, e AS (SELECT *, CASE WHEN rate = 7 THEN 12345 ELSE amount * 25 // 100 END AS x FROM priced) SELECT no, CAST(round(CAST(amount AS DOUBLE) * 9.48 / 1000) AS BIGINT) AS stamp_kr, x AS excise_kr, (amount + x) * 20 // 100 AS vat_kr FROM e"),
    "expense_split": (lambda s, d: tax.expense_split(_expenses(s, d)), f"WITH {_PRICED}, e AS (SELECT no AS id, amount AS amount_kr, list_extract(['TAMAMI', 'ORANSAL', 'HADDI_ASAN', 'KISMEN', 'YOK'], CAST(no % 5 + 1 AS INTEGER)) AS rule, rate * 5 AS share, CASE WHEN no % 11 <> 0 THEN 10000000 END AS l FROM priced), n AS (SELECT *, CAST(CASE WHEN rule = 'TAMAMI' THEN amount_kr WHEN rule = 'ORANSAL' THEN amount_kr * share // 100 WHEN l IS NULL THEN 0 WHEN rule = 'HADDI_ASAN' THEN greatest(amount_kr - l, 0) WHEN rule = 'KISMEN' THEN greatest(amount_kr - l, 0) * share // 100 ELSE 0 END AS BIGINT) AS non FROM e) SELECT id, rule, amount_kr, amount_kr - non AS deductible_kr, non AS non_deductible_kr, rule IN ('HADDI_ASAN', 'KISMEN') AND l IS NULL AS warning FROM n"),
    "party_declaration": (lambda s, d: tax.party_declaration(_s(s, d), 20_000_000), over("sale", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, 'SATIS' AS direction, party, count(*) AS n, CAST(sum(net_kr - return_net_kr - discount_net_kr) AS BIGINT) AS net_kr, sum(net_kr - return_net_kr - discount_net_kr) >= 20000000 AS declared FROM sale WHERE valid AND net_kr - return_net_kr - discount_net_kr > 0 GROUP BY 1, 3")),
    "fifo_allocation": (lambda s, d: allocation.fifo(_open(s, d), _money(s, d)), over("receipt", _BASE + " " + _fifo_sql("inv", "rec"))),
    "manual_allocation": (lambda s, d: allocation.manual(_decisions(s, d), _open(s, d), _money(s, d)), over("receipt", _BASE + " " + _MANUAL.format("inv", "rec"))),
    "full_allocation": (_all, over("receipt", _ALL + " SELECT * FROM alloc")),
    "receipt_status": (_status, over("receipt", _ALL + _STATUS + " SELECT * FROM status")),
    "purchase_allocation": (_paid, over("payment", f"WITH {_PAID} SELECT * FROM palloc")),
    "payment_vouchers": (lambda s, d: allocation.payment_legs(_all(s, d), _money(s, d)).unionByName(allocation.payment_legs(_paid(s, d), view(s, d, "payments"), "ALIS")), over("receipt payment", _ALL + f", {_PAID}" + _LEGS)),
    "allocation_sync_diff": (lambda s, d: allocation.sync(_frozen(s, d), _all(s, d)), over("receipt", _ALL + ", a AS (SELECT id, no, amount_kr, CAST(id AS VARCHAR) || '|' || CAST(no AS VARCHAR) || '|' || CAST(amount_kr AS VARCHAR) AS key FROM frozen), b AS (SELECT id, no, amount_kr, CAST(id AS VARCHAR) || '|' || CAST(no AS VARCHAR) || '|' || CAST(amount_kr AS VARCHAR) AS key FROM alloc) SELECT *, 'YENI' AS action FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT *, 'IPTAL' FROM a WHERE key NOT IN (SELECT key FROM b)")),
    "ledger_sync": (_synced, over("receipt", _ALL + _SYNC_SQL)),
    "decision_effect": (lambda s, d: allocation.effect(allocation.fifo(_open(s, d), _money(s, d)), _all(s, d)), over("receipt", _ALL + ", f AS (" + _fifo_sql("inv", "rec") + ") SELECT *, CASE WHEN before_kr = 0 THEN 'written' WHEN after_kr = 0 THEN 'dropped' ELSE 'changed' END AS outcome FROM (SELECT coalesce(f.id, a.id) AS id, coalesce(f.no, a.no) AS no, coalesce(f.amount_kr, 0) AS before_kr, coalesce(a.amount_kr, 0) AS after_kr FROM f FULL JOIN alloc a ON a.id = f.id AND a.no = f.no) WHERE before_kr <> after_kr")),
    "decision_outcomes": (lambda s, d: allocation.outcomes(_decisions(s, d), _s(s, d), view(s, d, "receipts"), allocation.fifo(_open(s, d), _money(s, d)), _all(s, d)), over("receipt", _ALL + ", f AS (" + _fifo_sql("inv", "rec") + ")" + _OUTCOMES_SQL)),
    "unallocated": (lambda s, d: allocation.unallocated(_status(s, d), _money(s, d), "2001-12-31"), over("receipt", _ALL + _STATUS + " SELECT s.id, s.party, bank, remaining_kr, status, CAST((2001 - year(date)) * 360 + (12 - month(date)) * 30 + 31 - day(date) AS INTEGER) AS age_days FROM status s JOIN rec ON rec.id = s.id WHERE remaining_kr > 0")),
    "invariants": (_checked, over("journal", _ALL + _CORRUPT_SQL + ", g AS (SELECT id, sum(amount_kr) AS g FROM alloc GROUP BY id), br AS (SELECT rec.id, open_kr, coalesce(s, 0) AS s, coalesce(g, 0) AS g FROM rec LEFT JOIN (SELECT id, sum(amount_kr) AS s FROM bad GROUP BY id) b ON b.id = rec.id LEFT JOIN g ON g.id = rec.id), bi AS (SELECT sale.no, valid, net_debt_kr, coalesce(s, 0) AS s FROM sale LEFT JOIN (SELECT no, sum(amount_kr) AS s FROM bad GROUP BY no) b ON b.no = sale.no) SELECT 'D01' AS code, id AS key, CAST(s - open_kr AS BIGINT) AS amount_kr FROM br WHERE s > open_kr UNION ALL SELECT 'D02', id, CAST(s - g AS BIGINT) FROM br WHERE s <> g UNION ALL SELECT 'D03', no, CAST(s - net_debt_kr AS BIGINT) FROM bi WHERE s > net_debt_kr UNION ALL SELECT 'D04', no, CAST(net_debt_kr - s AS BIGINT) FROM bi WHERE net_debt_kr - s < 0 UNION ALL SELECT 'D05', no, CAST(s AS BIGINT) FROM bi WHERE NOT valid AND s <> 0 UNION ALL SELECT 'D06', 0, CAST(o AS BIGINT) FROM (SELECT sum(debit_kr - credit_kr) AS o FROM journal) WHERE o <> 0")),
    "prechecks": (lambda s, d: allocation.prechecks(_requests(s, d), _s(s, d), _money(s, d), _decisions(s, d)), over("receipt", _BASE + ", q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5 WHEN o_orderkey % 35 = 0 THEN -1 ELSE o_orderkey END AS no FROM orders), m AS (SELECT q.id, q.no, r.id IS NULL AS k1, s.no IS NULL AS k2, valid, r.party AS rp, s.party AS ip, net_debt_kr, r.open_kr AS amount, s.date > r.date AS late, (SELECT min(d.id) FROM dec d WHERE d.no = q.no) AS holder, EXISTS (SELECT 1 FROM dec d WHERE d.no = q.no AND d.id = q.id) AS own FROM q LEFT JOIN rec r ON r.id = q.id LEFT JOIN sale s ON s.no = q.no) SELECT id, no, unnest(CASE WHEN k1 THEN ['K01'] WHEN k2 THEN ['K02'] ELSE list_filter([CASE WHEN NOT valid THEN 'K03' END, CASE WHEN rp <> ip THEN 'K04' END, CASE WHEN net_debt_kr <= 0 THEN 'K06' END, CASE WHEN holder <> id THEN 'K07' END, CASE WHEN own THEN 'K08' END, CASE WHEN late THEN 'K09' END, CASE WHEN net_debt_kr > 0 AND amount > net_debt_kr THEN 'K10' END], lambda x: x IS NOT NULL) END) AS code FROM m")),
}
DATES = dict.fromkeys(("vat_return", "vat_by_rate", "party_declaration"), ["month"])
