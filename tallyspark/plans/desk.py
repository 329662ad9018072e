"""Queries over day-to-day work on the books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import kurus
from tallyspark.operators import allocation, audit, desk, ledger, lifecycle, posting
from tallyspark.plans.books import _DRAFT_SQL, CHART_SQL, NATURE, _draft
from tallyspark.plans.money_flows import _ALL, _MONEY_SQL, _PAID, _STATUS, _all, _checked, _CORRUPT_SQL, _money, _paid, _status
from tallyspark.sources.model import chart, over, table, view

_j = lambda s, d: view(s, d, "journal")
_s = lambda s, d: view(s, d, "sales")
_r = lambda s, d: view(s, d, "receipts")
_p = lambda s, d: view(s, d, "payments")


def _final(s, d):
    heads = _draft(s, d).groupBy("voucher").agg(F.min("date").alias("date"), F.min("kind").alias("kind"), F.min("evidence").alias("evidence")).withColumn("series", F.when(F.col("kind") == "TAHSIL", "TAH").otherwise("MAH"))
    return desk.finalized(heads, posting.validate(_draft(s, d), ledger.chart_levels(chart(s)).where("postable"), "1994-01-01", "2002-12-31"))


_FINAL_SQL = f"""WITH {CHART_SQL}, {_DRAFT_SQL}, l AS (SELECT d.*, CASE WHEN (debit_kr > 0) = (credit_kr > 0) OR debit_kr < 0 OR credit_kr < 0 THEN 3 WHEN c.code IS NULL THEN 4 END AS bad FROM draft d LEFT JOIN (SELECT code FROM chart WHERE length(code) = 3) c ON c.code = d.account),
v AS (SELECT voucher, min(date) AS date, min(kind) AS kind, min(evidence) AS evidence FROM l GROUP BY voucher HAVING NOT bool_or(status = 'Kesin') AND count(*) >= 2 AND count(bad) = 0 AND min(date) BETWEEN DATE '1994-01-01' AND DATE '2002-12-31' AND sum(debit_kr) = sum(credit_kr) AND NOT bool_or(kind IN ('TAHSIL', 'TEDIYE') AND evidence IS NULL)),
n AS (SELECT voucher, date, series, row_number() OVER (PARTITION BY series ORDER BY date, voucher) AS serial, row_number() OVER (ORDER BY date, voucher) AS journal_no, evidence IS NULL AS bare FROM (SELECT *, CASE WHEN kind = 'TAHSIL' THEN 'TAH' ELSE 'MAH' END AS series FROM v))
SELECT voucher, date, series, serial, journal_no, series || '-' || CAST(serial AS VARCHAR) AS voucher_no, bare FROM n"""


def _vouchers(s, d):
    j = _j(s, d).where("kind <> 'opening'").groupBy("voucher").agg(F.min("date").alias("date"), F.min("kind").alias("kind"), F.min("doc_no").alias("doc_no"))
    return j.select("voucher", "date", (F.col("doc_no") % 31 != 0).alias("final"), F.when(F.col("kind") == "void", F.col("voucher") - posting.BASE).alias("reverses"), "doc_no")


def _requests(s, d):
    v = _vouchers(s, d).where("doc_no % 5 = 0 or reverses is not null")
    return v.select(F.when(F.col("doc_no") % 35 == 0, -F.col("voucher")).otherwise(F.col("voucher")).alias("voucher"), F.date_add("date", (F.col("doc_no") % 4 - 1).cast("int")).alias("date"))


_GUARD_SQL = """WITH v AS (SELECT voucher, min(date) AS date, min(doc_no) AS doc_no, min(doc_no) % 31 <> 0 AS final, CASE WHEN min(kind) = 'void' THEN voucher - 1000000000000 END AS reverses FROM journal WHERE kind <> 'opening' GROUP BY voucher),
q AS (SELECT CASE WHEN doc_no % 35 = 0 THEN -voucher ELSE voucher END AS voucher, date + CAST(doc_no % 4 - 1 AS INTEGER) AS date FROM v WHERE doc_no % 5 = 0 OR reverses IS NOT NULL)
SELECT q.voucher, unnest(CASE WHEN v.voucher IS NULL THEN ['R01'] ELSE list_filter([CASE WHEN NOT final THEN 'R02' END, CASE WHEN v.reverses IS NOT NULL THEN 'R03' END, CASE WHEN EXISTS (SELECT 1 FROM v g WHERE g.reverses = q.voucher) THEN 'R04' END, CASE WHEN q.date < v.date THEN 'R05' END], lambda x: x IS NOT NULL) END) AS code FROM q LEFT JOIN v ON v.voucher = q.voucher"""

_PROGRAMMES = [("sales", "60"), ("sales", "391"), ("stock", "153"), ("stock", "62"), ("parties", "12")]
_PROGRAMMES_SQL = "p(programme, prefix) AS (SELECT * FROM (VALUES ('sales', '60'), ('sales', '391'), ('stock', '153'), ('stock', '62'), ('parties', '12')) AS t(a, b))"
_MONTHS_SQL = ", ".join(f"CAST(sum(CASE WHEN month(date) = {m} THEN debit_kr - credit_kr ELSE 0 END) AS BIGINT) AS m{m:02}" for m in range(1, 13))


def _health(s, d):
    j = _j(s, d)
    return desk.health(invariants=_checked(s, d), contrary=audit.contrary_nature(j, chart(s)), unbalanced=ledger.balanced(j).where("not balanced"))


def _open(s, d):
    return allocation.unallocated(_status(s, d), _money(s, d), "2001-12-31")


def _assets(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, "252").when(F.col("p_partkey") % 10 == 1, "158").otherwise("153").alias("code"), kurus("p_retailprice").alias("value_kr"))


def _codes(s, d):
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 3 == 0, "AB").when(k % 3 == 1, "lo").otherwise("Xl"), F.lpad(k.cast("string"), 5, "0"), F.when(k % 7 == 0, " ").when(k % 5 == 0, "o").otherwise("K"))
    return table(s, d, "part").select("p_partkey", raw.alias("raw"), desk.normal_code(raw).alias("code"))


_CODES_SQL = """WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'lo' ELSE 'Xl' END || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN 'o' ELSE 'K' END AS raw FROM part)
SELECT p_partkey, raw, CASE WHEN length(trim(raw)) >= 5 AND regexp_full_match(trim(raw), '[A-Za-z0-9-]+') AND regexp_matches(raw, '[A-Za-z]') AND regexp_matches(raw, '[0-9]') AND 2 * length(regexp_replace(raw, '[^A-Z]', '', 'g')) >= length(regexp_replace(raw, '[^A-Za-z]', '', 'g')) THEN upper(translate(trim(raw), 'lo', 'IO')) ELSE trim(raw) END AS code FROM r"""


def _states(s, d):
    state = F.when(F.col("event_type") == "purchase", "KESIN").when(F.col("event_id") % 3 == 0, "VAZGECILDI").otherwise("TASLAK")
    return table(s, d, "events").select(F.call_function("div", F.col("event_id"), F.lit(4)).alias("no"), F.col("event_id").alias("at"), state.alias("state"))


def _numbers(s, d):
    return table(s, d, "events").select((F.col("event_id") % 3).alias("series"), F.col("event_id").alias("number"), F.date_add(F.col("ts").cast("date"), -F.when(F.col("event_id") % 50 == 0, 9).otherwise(0)).alias("date"))


def _lifecycle(s, d):
    """Events as what happened to invoices; a third of them to the invoice 0."""
    k = F.col("event_id") % 7
    event = F.when(k.isin(0, 4), "olustur").when(k.isin(1, 3, 5), "gonder").when(k == 2, "kesinlesti").otherwise("sil")
    rows = table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") * 7 + F.col("event_id") % 5).alias("no"), F.col("ts").alias("at"), F.col("event_id").alias("id"), event.alias("event"))
    return view(s, d, "lifecycle", lambda s, d: lifecycle.lifecycle(rows))


_LIFE_SQL = """WITH RECURSIVE e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id * 7 + event_id % 5 END AS no, ts AS tm, event_id AS id, CASE WHEN event_id % 7 IN (0, 4) THEN 'olustur' WHEN event_id % 7 IN (1, 3, 5) THEN 'gonder' WHEN event_id % 7 = 2 THEN 'kesinlesti' ELSE 'sil' END AS event FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY tm, id) AS i FROM e),
r AS (SELECT no, tm, id, event, i, 'YOK' AS before, CASE WHEN event = 'olustur' THEN 'TASLAK' ELSE 'YOK' END AS after FROM k WHERE i = 1
  UNION ALL SELECT k.no, k.tm, k.id, k.event, k.i, r.after, CASE WHEN r.after = 'YOK' AND k.event = 'olustur' THEN 'TASLAK' WHEN r.after = 'TASLAK' AND k.event = 'gonder' THEN 'GONDERILDI' WHEN r.after = 'GONDERILDI' AND k.event = 'kesinlesti' THEN 'KESINLESTI' ELSE r.after END FROM r JOIN k ON k.no = r.no AND k.i = r.i + 1)"""

QUERIES = {
    "invoice_lifecycle": (lambda s, d: _lifecycle(s, d).drop("at"), _LIFE_SQL + " SELECT no, id, event, before, after, before <> after AS accepted FROM r"),
    "invoice_states": (lambda s, d: lifecycle.invoices(_lifecycle(s, d)), _LIFE_SQL + ", s AS (SELECT no, arg_max(after, i) AS state, max(CASE WHEN event = 'gonder' AND before <> after THEN id END) AS sent, max(CASE WHEN event = 'kesinlesti' AND before <> after THEN tm END) AS final, count(*) FILTER (before = after) AS refused FROM r GROUP BY no) SELECT no, state, CASE WHEN sent IS NOT NULL THEN 'EF-' || CAST(no AS VARCHAR) || '-' || lpad(CAST(sent AS VARCHAR), CAST(greatest(6, length(CAST(sent AS VARCHAR))) AS INTEGER), '0') END AS uuid, CASE WHEN final IS NOT NULL THEN 'arsiv/' || CAST(no AS VARCHAR) || '.xml' END AS archive, CAST(final AS DATE) AS voucher_date, refused FROM s WHERE state <> 'YOK'"),
    "voucher_finalize": (_final, over("journal", _FINAL_SQL)),
    "voucher_chronology": (lambda s, d: desk.chronology(_numbers(s, d)), "WITH n AS (SELECT event_id % 3 AS series, event_id AS number, CAST(ts AS DATE) - CASE WHEN event_id % 50 = 0 THEN 9 ELSE 0 END AS date FROM events) SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY series ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM n) WHERE date < latest"),
    "reversal_guards": (lambda s, d: desk.reversal_findings(_requests(s, d), _vouchers(s, d)), over("journal", _GUARD_SQL)),
    "period_ledger": (lambda s, d: desk.period_ledger(_j(s, d), "1996-01-01", "1996-12-31"), over("journal", "WITH o AS (SELECT account, sum(debit_kr - credit_kr) AS o FROM journal WHERE date < DATE '1996-01-01' GROUP BY account) SELECT j.account, date, voucher, line_no, debit_kr, credit_kr, CAST(coalesce(o, 0) AS BIGINT) AS opening_kr, CAST(coalesce(o, 0) + sum(debit_kr - credit_kr) OVER (PARTITION BY j.account ORDER BY date, voucher, line_no) AS BIGINT) AS balance_kr FROM journal j LEFT JOIN o ON o.account = j.account WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")),
    "voucher_detail": (lambda s, d: desk.voucher_detail(_j(s, d), chart(s)), over("journal", f"WITH {CHART_SQL} SELECT voucher, line_no, date, kind, account, coalesce(name, '') AS name, debit_kr, credit_kr FROM journal LEFT JOIN chart ON code = split_part(account, '.', 1)")),
    "working_paper": (lambda s, d: desk.working_paper(_j(s, d), s.createDataFrame(_PROGRAMMES, "programme string, prefix string")), over("journal", f"WITH {_PROGRAMMES_SQL}, a AS (SELECT account, count(*) AS movements, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS net_kr, {_MONTHS_SQL} FROM journal GROUP BY account) SELECT DISTINCT programme, a.* FROM a JOIN p ON starts_with(split_part(account, '.', 1), prefix)")),
    "system_health": (_health, over("journal", _ALL + _CORRUPT_SQL + f""", {CHART_SQL}, g AS (SELECT id, sum(amount_kr) AS g FROM alloc GROUP BY id), br AS (SELECT rec.id, open_kr, coalesce(s, 0) AS s, coalesce(g, 0) AS g FROM rec LEFT JOIN (SELECT id, sum(amount_kr) AS s FROM bad GROUP BY id) b ON b.id = rec.id LEFT JOIN g ON g.id = rec.id),
 bi AS (SELECT sale.no, valid, net_debt_kr, coalesce(s, 0) AS s FROM sale LEFT JOIN (SELECT no, sum(amount_kr) AS s FROM bad GROUP BY no) b ON b.no = sale.no), n AS (SELECT account, split_part(account, '.', 1) AS k, sum(debit_kr - credit_kr) AS net_kr FROM journal GROUP BY account), m AS (SELECT {NATURE} AS nature, net_kr FROM n JOIN chart ON code = k),
 t AS (SELECT (SELECT count(*) FILTER (WHERE s > open_kr) + count(*) FILTER (WHERE s <> g) FROM br) + (SELECT count(*) FILTER (WHERE s > net_debt_kr) * 2 + count(*) FILTER (WHERE NOT valid AND s <> 0) FROM bi) + (SELECT CAST(sum(debit_kr - credit_kr) <> 0 AS BIGINT) FROM journal) AS invariants, (SELECT count(*) FROM m WHERE (nature = 'debit') = (net_kr < 0) AND net_kr <> 0) AS contrary, (SELECT CAST(sum(debit_kr) <> sum(credit_kr) AS BIGINT) FROM journal) AS unbalanced)
 SELECT invariants, contrary, unbalanced, invariants + contrary + unbalanced = 0 AS sound FROM t""")),
    "allocation_voucher_lines": (lambda s, d: desk.allocation_lines(_all(s, d), _r(s, d)).unionByName(desk.allocation_lines(_paid(s, d), _p(s, d), "ALIS")), over("receipt payment", _ALL + f", {_PAID}" + _MONEY_SQL + " SELECT direction, id, no, 1 AS line_no, CASE WHEN direction = 'SATIS' THEN account ELSE '320' END AS account, amount_kr AS debit_kr, CAST(0 AS BIGINT) AS credit_kr FROM m UNION ALL SELECT direction, id, no, 2, CASE WHEN direction = 'SATIS' THEN '120' ELSE account END, 0, amount_kr FROM m")),
    "unallocated_by_bank": (lambda s, d: desk.waiting(_open(s, d), _r(s, d).where("id % 3 = 0")), over("receipt", _ALL + _STATUS + " SELECT bank, count(*) AS n, CAST(sum(remaining_kr) AS BIGINT) AS open_kr, max(age) AS oldest_days, count(*) FILTER (WHERE id % 3 = 0) AS awaited, count(*) FILTER (WHERE id % 3 = 0 AND age > 7) AS reminders FROM (SELECT rec.id, bank, remaining_kr, CAST((2001 - year(date)) * 360 + (12 - month(date)) * 30 + 31 - day(date) AS INTEGER) AS age FROM status s JOIN rec ON rec.id = s.id WHERE remaining_kr > 0) GROUP BY bank")),
    "cash_transfers": (lambda s, d: audit.cash_transfers(_r(s, d).unionByName(_p(s, d))), over("receipt payment", "SELECT CAST(date_trunc('month', date) AS DATE) AS date, count(*) AS n, CAST(sum(amount_kr) AS BIGINT) AS amount_kr FROM payment WHERE instrument = 'NAKIT' GROUP BY 1")),
    "asset_cards": (lambda s, d: desk.asset_cards(_assets(s, d), _j(s, d), "15"), over("journal", "WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN '252' WHEN 1 THEN '158' ELSE '153' END AS code, CAST(round(p_retailprice * 100) AS BIGINT) AS value_kr FROM part) SELECT a.*, CAST(coalesce((SELECT sum(debit_kr - credit_kr) FROM journal WHERE account = code), 0) AS BIGINT) AS booked_kr FROM a WHERE starts_with(code, '15')")),
    "code_normalize": (_codes, _CODES_SQL),
    "entry_states": (lambda s, d: desk.latest_state(_states(s, d)), "WITH e AS (SELECT event_id // 4 AS no, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'KESIN' WHEN event_id % 3 = 0 THEN 'VAZGECILDI' ELSE 'TASLAK' END AS state FROM events) SELECT no, CASE WHEN bool_or(state = 'KESIN') THEN 'KESIN' ELSE arg_max(state, seq) END AS state, bool_or(state = 'KESIN') OR arg_max(state, seq) <> 'VAZGECILDI' AS counts FROM e GROUP BY no"),
    "receipt_lists": (lambda s, d: desk.receipt_lists(_r(s, d), _all(s, d)), over("receipt", _ALL + ", p AS (SELECT id, count(*) AS n, min(no) AS first_no, max(no) AS last_no, sum(amount_kr) AS paid FROM alloc GROUP BY id) SELECT rec.id, rec.party, rec.date, rec.instrument, open_kr AS amount_kr, coalesce(n, 0) AS n, first_no, last_no, CAST(open_kr - coalesce(paid, 0) AS BIGINT) AS left_kr FROM rec LEFT JOIN p ON p.id = rec.id")),
    "party_statement": (lambda s, d: ledger.general_ledger(_j(s, d).where("account like '120.%'")).withColumn("party", F.substring_index("account", ".", -1)), over("journal", "SELECT account, date, voucher, line_no, debit_kr, credit_kr, CAST(sum(debit_kr - credit_kr) OVER (PARTITION BY account ORDER BY date, voucher, line_no) AS BIGINT) AS balance_kr, CASE WHEN debit_kr > 0 THEN 'debit' ELSE 'credit' END AS side, split_part(account, '.', 2) AS party FROM journal WHERE account LIKE '120.%'")),
}
DATES = {"invoice_states": ["voucher_date"], "voucher_finalize": ["date"], "voucher_chronology": ["date", "latest"], "period_ledger": ["date"], "voucher_detail": ["date"], "cash_transfers": ["date"], "receipt_lists": ["date"], "party_statement": ["date"]}
