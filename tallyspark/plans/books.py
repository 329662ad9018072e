"""Queries over the books: journal, balances, statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import ledger, posting, statements
from tallyspark.sources.model import ACCOUNTS, chart, order_lines, over, purchases, sales, table, view

_j = lambda s, d: view(s, d, "journal")
_s = lambda s, d: view(s, d, "sales")
_values = ", ".join(f"('{c}', '{n}')" for c, n in ACCOUNTS)
CHART_SQL = f"chart(code, name) AS (SELECT * FROM (VALUES {_values}) AS t(code, name))"
NATURE = """CASE WHEN code IN ('701', '711', '721', '731', '741', '751', '761', '771', '781', '798') THEN 'credit' WHEN (left(code, 1) IN ('1', '2', '7', '9')) = (name NOT LIKE '%(-)') THEN 'debit' ELSE 'credit' END"""
KIND = f"CASE WHEN left(code, 1) IN ('1', '2') THEN 'asset' WHEN left(code, 1) IN ('3', '4', '5') THEN 'liability' WHEN left(code, 1) = '6' THEN CASE WHEN {NATURE} = 'credit' THEN 'income' ELSE 'expense' END WHEN left(code, 1) = '7' THEN 'cost' ELSE 'memo' END"
TB = "SELECT account, CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr, CAST(greatest(sum(debit_kr) - sum(credit_kr), 0) AS BIGINT) AS debit_balance_kr, CAST(greatest(sum(credit_kr) - sum(debit_kr), 0) AS BIGINT) AS credit_balance_kr FROM journal GROUP BY account"


def _net(*prefixes: str) -> str:
    return "CAST(coalesce(sum(CASE WHEN " + " OR ".join(f"account LIKE '{p}%'" for p in prefixes) + " THEN debit_kr - credit_kr END), 0) AS BIGINT)"


FIGURES = ", ".join(f"{'-' if s < 0 else ''}{_net(*p)} AS {n}" for n, s, p in [
    ("gross_sales", -1, ["60"]), ("deductions", 1, ["61"]), ("cogs", 1, ["62"]), ("operating", 1, ["63"]), ("other_income", -1, ["64"]), ("other_expense", 1, ["65"]), ("financing", 1, ["66"]), ("extra_income", -1, ["67"]),
    ("extra_expense", 1, ["68"]), ("tax", 1, ["691"]), ("current_assets", 1, ["1"]), ("fixed_assets", 1, ["2"]), ("short_liabilities", -1, ["3"]), ("long_liabilities", -1, ["4"]), ("equity", -1, ["5"]), ("inventory", 1, ["15"]),
    ("liquid", 1, ["10", "11"]), ("receivables", 1, ["12"])])
DERIVED = """SELECT *, profit - tax AS net_profit, current_assets + fixed_assets AS assets, short_liabilities + long_liabilities + equity + profit - tax AS liabilities FROM (
 SELECT *, ordinary_profit + extra_income - extra_expense AS profit FROM (SELECT *, operating_profit + other_income - other_expense - financing AS ordinary_profit FROM (
 SELECT *, gross_profit - operating AS operating_profit FROM (SELECT *, net_sales - cogs AS gross_profit FROM (SELECT *, gross_sales - deductions AS net_sales FROM ({0}))))))"""
STATEMENT = DERIVED.format(f"SELECT {FIGURES} FROM journal")


def _ratios_sql(source: str, keys: str = "") -> str:
    each = " UNION ALL ".join(
        f"SELECT {keys}'{g}' AS grp, '{n}' AS ratio, CAST({v.replace('(current_assets', '1.0::DOUBLE * (current_assets').replace('(short_liabilities +', '1.0::DOUBLE * (short_liabilities +') if v.startswith('(') else v.replace('100.0', '100.0::DOUBLE').replace('365.0', '365.0::DOUBLE') if '.0' in v else '1.0::DOUBLE * ' + v} AS DOUBLE) AS value, {a} AS good, {b} AS fair, {str(up).lower()} AS up FROM src"
        for n, g, v, a, b, up in statements.RATIOS
    )
    return f"WITH src AS ({source}), r AS ({each}) SELECT {keys}grp, ratio, round(value, 6) AS value, CASE WHEN CASE WHEN up THEN value >= good ELSE value <= good END THEN 'good' WHEN CASE WHEN up THEN value >= fair ELSE value <= fair END THEN 'fair' ELSE 'poor' END AS status FROM r"


def _vertical_sql() -> str:
    rows = [(i, "assets") for i in ("current_assets", "fixed_assets", "short_liabilities", "long_liabilities", "equity")] + [(i, "net_sales") for i in ("cogs", "gross_profit", "operating_profit", "net_profit")]
    return f"WITH src AS ({STATEMENT}) " + " UNION ALL ".join(f"SELECT '{i}' AS item, '{b}' AS base, {i} AS amount_kr, round(100.0::DOUBLE * {i} / greatest({b}, 1), 6) AS share FROM src" for i, b in rows)


_STOCK = ["current_assets", "fixed_assets", "short_liabilities", "long_liabilities", "equity", "inventory", "liquid", "receivables", "assets"]
_FLOW = ["gross_sales", "deductions", "cogs", "operating", "other_income", "other_expense", "financing", "extra_income", "extra_expense", "tax", "net_sales", "gross_profit", "operating_profit", "ordinary_profit", "profit", "net_profit"]
MONTHLY = "SELECT month, " + ", ".join(_FLOW) + ", " + ", ".join(f"CAST(sum({c}) OVER (ORDER BY month) AS BIGINT) AS {c}" for c in _STOCK) + " FROM (" + DERIVED.format(f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {FIGURES} FROM journal GROUP BY 1") + ")"


def _period(journal, until):
    return statements.statement(journal.where(F.col("date") <= F.lit(until).cast("date"))).withColumn("period", F.lit(until))


def _period_ratios(s, d):
    j = _j(s, d)
    return statements.ratios(_period(j, "1999-12-31").unionByName(_period(j, "1998-12-31")), "period")


def _lines(spark):
    return spark.createDataFrame([("receivables", "12"), ("liquid", "10"), ("inventories", "15"), ("payables", "32"), ("taxes", "36"), ("taxes", "39"), ("recoverable_tax", "19"), ("equity", "5"), ("trade", "120"), ("trade", "320")], "line string, prefix string")


_LINES_SQL = "lines(line, prefix) AS (SELECT * FROM (VALUES ('receivables', '12'), ('liquid', '10'), ('inventories', '15'), ('payables', '32'), ('taxes', '36'), ('taxes', '39'), ('recoverable_tax', '19'), ('equity', '5'), ('trade', '120'), ('trade', '320')) AS t(line, prefix))"


def _invoice_lines(s, d):
    p = table(s, d, "lineitem")
    from tallyspark.functions.money import kurus

    return p.select(F.col("l_orderkey").alias("no"), F.col("l_quantity").cast("bigint").alias("qty"), kurus("l_extendedprice").alias("price_kr"), F.round(F.col("l_tax") * 100).cast("bigint").alias("rate"), (F.col("l_returnflag") == "N").alias("exempt")).withColumn(
        "unit_kr", F.call_function("div", F.col("price_kr"), F.col("qty"))
    )


def _draft(s, d):
    """Journal lines with planted faults, as vouchers to validate."""
    j = _j(s, d).where("kind <> 'opening'")
    k = F.col("doc_no") % 97
    return j.select(
        "voucher", "line_no", F.when(k == 1, F.lit("1990-01-01").cast("date")).otherwise(F.col("date")).alias("date"), F.when(k == 2, "Kesin").otherwise("Taslak").alias("status"),
        F.when(((k == 3) & (F.col("line_no") == 2)) | ((k == 6) & (F.col("line_no") == 1)), "999").otherwise(F.when(F.instr("account", ".") > 0, F.substring_index("account", ".", 1)).otherwise(F.col("account"))).alias("account"),
        F.when(k.isin(4, 6) & (F.col("line_no") == 1), F.lit(0)).otherwise(F.col("debit_kr")).cast("bigint").alias("debit_kr"),
        F.when((k == 5) & (F.col("line_no") == 2), F.col("credit_kr") + 1).when((k == 7) & (F.col("line_no") == 1), F.lit(-3)).otherwise(F.col("credit_kr")).cast("bigint").alias("credit_kr"),
        F.when(F.col("kind") == "receipt", "TAHSIL").otherwise("MAHSUP").alias("kind"), F.when(k != 8, F.col("doc_no")).alias("evidence"),
    )


_DRAFT_SQL = """draft AS (SELECT voucher, line_no, CASE WHEN doc_no % 97 = 1 THEN DATE '1990-01-01' ELSE date END AS date, CASE WHEN doc_no % 97 = 2 THEN 'Kesin' ELSE 'Taslak' END AS status,
 CASE WHEN doc_no % 97 = 3 AND line_no = 2 OR doc_no % 97 = 6 AND line_no = 1 THEN '999' ELSE split_part(account, '.', 1) END AS account, CASE WHEN doc_no % 97 IN (4, 6) AND line_no = 1 THEN 0 ELSE debit_kr END AS debit_kr,
 CASE WHEN doc_no % 97 = 5 AND line_no = 2 THEN credit_kr + 1 WHEN doc_no % 97 = 7 AND line_no = 1 THEN -3 ELSE credit_kr END AS credit_kr,
 CASE WHEN kind = 'receipt' THEN 'TAHSIL' ELSE 'MAHSUP' END AS kind, CASE WHEN doc_no % 97 <> 8 THEN doc_no END AS evidence FROM journal WHERE kind <> 'opening')"""


def _heads(s, d):
    series = F.when(F.col("type") == "Tahsil", "TAH").when(F.col("type") == "Tediye", "TED").otherwise("MAH")
    heads = _j(s, d).groupBy("voucher").agg(F.min("date").alias("date"))
    return heads.join(posting.voucher_types(_j(s, d)), "voucher").select("voucher", "date", series.alias("series"))


_TYPES = "SELECT voucher, CASE WHEN i AND NOT o THEN 'Tahsil' WHEN o AND NOT i THEN 'Tediye' ELSE 'Mahsup' END AS type FROM (SELECT voucher, bool_or(left(account, 3) IN ('100', '101', '102') AND debit_kr > 0) AS i, bool_or(left(account, 3) IN ('100', '101', '102') AND credit_kr > 0) AS o FROM journal GROUP BY voucher)"


def _levels(spark):
    return spark.createDataFrame([("UZMAN", 5_000_000), ("MUDUR", 20_000_000), ("YONETICI", 1_000), ("STAJYER", 0)], "level string, limit_kr long")


def _leveled(s, d):
    level = F.element_at(F.array(*map(F.lit, ("UZMAN", "MUDUR", "YONETICI", "STAJYER"))), (F.col("voucher") % 4 + 1).cast("int"))
    return ledger.voucher_totals(_j(s, d)).select("voucher", level.alias("level"), "debit_kr")


def _whole_chart(s, d):
    """The chart with the sub-accounts that the journal was posted to."""
    subs = _j(s, d).where("instr(account, '.') > 0").select(F.col("account").alias("code")).distinct()
    return chart(s).unionByName(subs.withColumn("name", F.concat(F.lit("Alt hesap "), "code")))


QUERIES = {
    "trial_balance": (lambda s, d: ledger.trial_balance(_j(s, d)), over("journal", TB)),
    "trial_balance_named": (
        lambda s, d: ledger.named(ledger.trial_balance(_j(s, d)), chart(s)),
        over("journal", f"WITH {CHART_SQL}, tb AS ({TB}), dim AS (SELECT code, name, {KIND} || ' · ' || {NATURE} AS nature FROM chart) SELECT tb.account, split_part(account, '.', 1) AS ledger, debit_kr, credit_kr, debit_balance_kr, credit_balance_kr, coalesce(name, '') AS name, coalesce(nature, '') AS nature FROM tb LEFT JOIN dim ON code = split_part(account, '.', 1)"),
    ),
    "ledger_long_contras": (
        lambda s, d: ledger.long_contras(_j(s, d)),
        over("journal", "WITH n AS (SELECT voucher FROM journal GROUP BY voucher HAVING count(*) > 1000), x AS (SELECT DISTINCT j.voucher, CASE WHEN debit_kr > 0 THEN 'credit' ELSE 'debit' END AS side, line_no, account FROM journal j JOIN n ON n.voucher = j.voucher), y AS (SELECT *, lag(account) OVER (PARTITION BY voucher, side ORDER BY line_no, account) AS before FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY voucher, side ORDER BY line_no, account) - 1 AS place FROM y WHERE before IS NULL OR before <> account) SELECT voucher, side, place // 1000 AS chunk, string_agg(account, ', ' ORDER BY place) AS contra FROM z GROUP BY voucher, side, place // 1000"),
    ),
    "general_ledger": (
        lambda s, d: ledger.general_ledger(_j(s, d)),
        over("journal", "SELECT account, date, voucher, line_no, debit_kr, credit_kr, CAST(sum(debit_kr - credit_kr) OVER (PARTITION BY account ORDER BY date, voucher, line_no) AS BIGINT) AS balance_kr, CASE WHEN debit_kr > 0 THEN 'debit' ELSE 'credit' END AS side FROM journal"),
    ),
    "ledger_contras": (
        lambda s, d: ledger.contras(_j(s, d)),
        over("journal", "WITH x AS (SELECT DISTINCT voucher, CASE WHEN debit_kr > 0 THEN 'credit' ELSE 'debit' END AS side, line_no, account FROM journal), y AS (SELECT *, lag(account) OVER (PARTITION BY voucher, side ORDER BY line_no, account) AS before FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY voucher, side ORDER BY line_no, account) - 1 AS place FROM y WHERE before IS NULL OR before <> account) SELECT voucher, side, place // 1000 AS chunk, string_agg(account, ', ' ORDER BY place) AS contra FROM z GROUP BY voucher, side, place // 1000"),
    ),
    "journal_last_n": (lambda s, d: ledger.journal_book(_j(s, d), 300), over("journal", "SELECT voucher, min(date) AS date, min(kind) AS kind, CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr, count(*) AS n_lines FROM journal GROUP BY voucher ORDER BY min(date) DESC, voucher DESC LIMIT 300")),
    "rollup_hierarchy": (
        lambda s, d: ledger.rollup(_j(s, d)),
        over("journal", "WITH a AS (SELECT account, sum(debit_kr) AS d, sum(credit_kr) AS c FROM journal GROUP BY account), u AS (SELECT DISTINCT account, code FROM (SELECT account, left(split_part(account, '.', 1), CAST(unnest(range(1, length(split_part(account, '.', 1)) + 1)) AS INTEGER)) AS code FROM a UNION ALL SELECT account, account FROM a)) SELECT code, CAST(sum(d) AS BIGINT) AS debit_kr, CAST(sum(c) AS BIGINT) AS credit_kr, CAST(sum(d - c) AS BIGINT) AS net_kr FROM a JOIN u ON u.account = a.account GROUP BY code"),
    ),
    "ledger_balanced": (lambda s, d: ledger.balanced(_j(s, d)), over("journal", "SELECT CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr, sum(debit_kr) = sum(credit_kr) AS balanced FROM journal")),
    "voucher_totals": (lambda s, d: ledger.voucher_totals(_j(s, d)), over("journal", "SELECT voucher, CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr FROM journal GROUP BY voucher")),
    "subsidiary_summary": (lambda s, d: ledger.subsidiary_summary(_j(s, d), "120"), over("journal", "SELECT account, count(*) AS n, CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS net_kr FROM journal WHERE account LIKE '120%' GROUP BY account")),
    "ledger_page": (lambda s, d: ledger.page(_j(s, d), "153", 100, 200), over("journal", "SELECT date, voucher, line_no, debit_kr, credit_kr, balance_kr FROM (SELECT *, CAST(sum(debit_kr - credit_kr) OVER (ORDER BY date, voucher, line_no) AS BIGINT) AS balance_kr, row_number() OVER (ORDER BY date DESC, voucher DESC, line_no DESC) AS k FROM journal WHERE account = '153') WHERE k > 100 AND k <= 300")),
    "account_levels": (lambda s, d: ledger.chart_levels(_whole_chart(s, d)), over("journal", f"WITH {CHART_SQL}, whole AS (SELECT code, name FROM chart UNION ALL SELECT DISTINCT account, 'Alt hesap ' || account FROM journal WHERE contains(account, '.')) SELECT code, name, {KIND} AS type, {NATURE} AS nature, CAST(CASE WHEN contains(code, '.') THEN 2 + len(string_split(code, '.')) ELSE length(code) END AS INTEGER) AS level, (length(code) = 3 OR contains(code, '.')) AND code NOT IN (SELECT split_part(code, '.', 1) FROM whole WHERE contains(code, '.')) AS postable FROM whole WHERE left(code, 1) <> '8'")),
    "party_balance": (lambda s, d: ledger.subsidiary_summary(_j(s, d), "320"), over("journal", "SELECT account, count(*) AS n, CAST(sum(debit_kr) AS BIGINT) AS debit_kr, CAST(sum(credit_kr) AS BIGINT) AS credit_kr, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS net_kr FROM journal WHERE account LIKE '320%' GROUP BY account")),
    "invoice_totals": (lambda s, d: posting.invoice_totals(_invoice_lines(s, d)), "WITH l AS (SELECT l_orderkey AS no, CAST(l_quantity AS BIGINT) * (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) AS net, CAST(round(l_tax * 100) AS BIGINT) AS rate, l_returnflag = 'N' AS exempt FROM lineitem) SELECT no, CAST(sum(net) AS BIGINT) AS net_kr, CAST(sum(CASE WHEN exempt THEN 0 ELSE (net * rate + 50) // 100 END) AS BIGINT) AS vat_kr, CAST(sum(net + CASE WHEN exempt THEN 0 ELSE (net * rate + 50) // 100 END) AS BIGINT) AS gross_kr FROM l GROUP BY no"),
    "invoice_postings": (lambda s, d: posting.sale_accruals(_s(s, d)), over("journal", "SELECT * FROM journal WHERE kind = 'accrual'")),
    "return_postings": (lambda s, d: posting.sale_returns(_s(s, d)), over("journal", "SELECT * FROM journal WHERE kind = 'return'")),
    "cogs_postings": (lambda s, d: posting.costs(_s(s, d)), over("journal", "SELECT * FROM journal WHERE kind = 'cost'")),
    "discount_postings": (lambda s, d: posting.discounts(_s(s, d)), over("journal", "SELECT * FROM journal WHERE kind = 'discount'")),
    "purchase_postings": (lambda s, d: posting.purchase_accruals(purchases(s, d)), over("journal", "SELECT * FROM journal WHERE kind = 'purchase'")),
    "net_debt": (lambda s, d: _s(s, d).select("no", "party", "state", "gross_kr", "net_debt_kr"), over("sale", "SELECT no, party, state, gross_kr, CAST(net_debt_kr AS BIGINT) AS net_debt_kr FROM sale")),
    "voucher_type": (lambda s, d: posting.voucher_types(_j(s, d)), over("journal", _TYPES)),
    "voucher_validation": (
        lambda s, d: posting.validate(_draft(s, d), ledger.chart_levels(chart(s)).where("postable"), "1994-01-01", "2002-12-31"),
        over("journal", f"WITH {CHART_SQL}, {_DRAFT_SQL}, l AS (SELECT d.*, CASE WHEN (debit_kr > 0) = (credit_kr > 0) OR debit_kr < 0 OR credit_kr < 0 THEN 3 WHEN c.code IS NULL THEN 4 END AS bad FROM draft d LEFT JOIN (SELECT code FROM chart WHERE length(code) = 3) c ON c.code = d.account), v AS (SELECT voucher, bool_or(status = 'Kesin') AS final, count(*) AS n, min(line_no * 10 + bad) AS line, min(date) AS date, sum(debit_kr) - sum(credit_kr) AS off, bool_or(kind IN ('TAHSIL', 'TEDIYE') AND evidence IS NULL) AS bare FROM l GROUP BY voucher) SELECT voucher, CASE WHEN final THEN 'FINAL' WHEN n < 2 THEN 'V2' WHEN line IS NOT NULL THEN 'V' || CAST(line % 10 AS VARCHAR) WHEN date NOT BETWEEN DATE '1994-01-01' AND DATE '2002-12-31' THEN 'V6' WHEN off <> 0 THEN 'V1' WHEN bare THEN 'V7' ELSE 'OK' END AS rule FROM v"),
    ),
    "voucher_numbering": (
        lambda s, d: posting.numbered(_heads(s, d), "date", "voucher"),
        over("journal", f"WITH t AS ({_TYPES}), h AS (SELECT j.voucher, min(date) AS date, min(CASE type WHEN 'Tahsil' THEN 'TAH' WHEN 'Tediye' THEN 'TED' ELSE 'MAH' END) AS series FROM journal j JOIN t ON t.voucher = j.voucher GROUP BY j.voucher) SELECT *, row_number() OVER (PARTITION BY series ORDER BY date, voucher) AS serial, row_number() OVER (ORDER BY date, voucher) AS journal_no FROM h"),
    ),
    "reversal": (lambda s, d: posting.voids(posting.sale_accruals(_s(s, d).where("state = 'IPTAL'"))), over("journal", "SELECT * FROM journal WHERE kind = 'void'")),
    "duplicate_documents": (lambda s, d: posting.duplicate_documents(_j(s, d).where("kind in ('accrual', 'void')").groupBy("voucher").agg(F.lit("invoice").alias("doc_type"), F.min("doc_no").alias("doc_no"), F.min("date").alias("date"))), over("journal", "WITH v AS (SELECT voucher, 'invoice' AS doc_type, min(doc_no) AS doc_no, min(date) AS date FROM journal WHERE kind IN ('accrual', 'void') GROUP BY voucher) SELECT * FROM (SELECT *, min(voucher) OVER (PARTITION BY doc_type, doc_no) AS first_voucher FROM v) WHERE voucher <> first_voucher")),
    "approval_breaches": (lambda s, d: posting.approval_breaches(_leveled(s, d), _levels(s)), over("journal", "WITH t AS (SELECT voucher, list_extract(['UZMAN', 'MUDUR', 'YONETICI', 'STAJYER'], CAST(voucher % 4 + 1 AS INTEGER)) AS level, CAST(sum(debit_kr) AS BIGINT) AS debit_kr FROM journal GROUP BY voucher), l(level, limit_kr) AS (SELECT * FROM (VALUES ('UZMAN', 5000000), ('MUDUR', 20000000), ('YONETICI', 1000), ('STAJYER', 0)) AS v(a, b)) SELECT t.level, voucher, debit_kr, CAST(limit_kr AS BIGINT) AS limit_kr FROM t JOIN l ON l.level = t.level WHERE limit_kr > 0 AND t.level <> 'YONETICI' AND debit_kr > limit_kr")),
    "balance_sheet": (lambda s, d: statements.statement(_j(s, d)).select(statements.BALANCE), over("journal", f"SELECT {', '.join(statements.BALANCE)} FROM ({STATEMENT})")),
    "income_statement": (lambda s, d: statements.statement(_j(s, d)).select(statements.INCOME), over("journal", f"SELECT {', '.join(statements.INCOME)} FROM ({STATEMENT})")),
    "period_result": (lambda s, d: statements.period_result(_j(s, d)), over("journal", "SELECT CAST(coalesce(sum(credit_kr - debit_kr), 0) AS BIGINT) AS result_kr FROM journal WHERE account LIKE '6%' AND account NOT LIKE '69%'")),
    "account_balance_sheet": (lambda s, d: statements.account_balance_sheet(_j(s, d)), over("journal", "SELECT code, CASE WHEN code < '3' THEN 'assets' ELSE 'liabilities' END AS side, CAST(CASE WHEN code < '3' THEN n ELSE -n END AS BIGINT) AS balance_kr FROM (SELECT split_part(account, '.', 1) AS code, sum(debit_kr - credit_kr) AS n FROM journal WHERE account < '6' GROUP BY 1) WHERE n <> 0 UNION ALL SELECT '-', 'liabilities', CAST(sum(credit_kr - debit_kr) AS BIGINT) FROM journal WHERE account LIKE '6%' AND (account NOT LIKE '69%' OR account LIKE '691%') HAVING sum(credit_kr - debit_kr) <> 0")),
    "closing_chain": (
        lambda s, d: statements.closing(_j(s, d), statements.estimated_tax()),
        over("journal", "WITH o AS (SELECT account, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS n FROM journal WHERE account LIKE '6%' AND account NOT LIKE '69%' GROUP BY account HAVING sum(debit_kr - credit_kr) <> 0), r AS (SELECT CAST(coalesce(sum(-n), 0) AS BIGINT) AS r FROM o), t AS (SELECT r, CASE WHEN r > 0 THEN r * 25 // 100 ELSE 0 END AS t FROM r), legs(step, account, k) AS (SELECT 1, '690', -r FROM t UNION ALL SELECT 2, '691', t FROM t UNION ALL SELECT 2, '370', -t FROM t UNION ALL SELECT 3, '690', r FROM t UNION ALL SELECT 3, '691', -t FROM t UNION ALL SELECT 3, '692', t - r FROM t UNION ALL SELECT 4, '692', r - t FROM t UNION ALL SELECT 4, CASE WHEN r - t >= 0 THEN '590' ELSE '591' END, t - r FROM t) SELECT 1 AS step, account, greatest(-n, 0) AS debit_kr, greatest(n, 0) AS credit_kr FROM o UNION ALL SELECT step, account, greatest(k, 0), greatest(-k, 0) FROM legs WHERE k <> 0"),
    ),
    "opening_entry": (lambda s, d: statements.balance_entry(_j(s, d), True), over("journal", "SELECT account, CAST(greatest(n, 0) AS BIGINT) AS debit_kr, CAST(greatest(-n, 0) AS BIGINT) AS credit_kr FROM (SELECT account, sum(debit_kr - credit_kr) AS n FROM journal WHERE account < '6' GROUP BY account) WHERE n <> 0")),
    "ratios": (lambda s, d: statements.ratios(statements.statement(_j(s, d))), over("journal", _ratios_sql(STATEMENT))),
    "vertical_analysis": (lambda s, d: statements.vertical(statements.statement(_j(s, d))), over("journal", _vertical_sql())),
    "monthly_comparison": (lambda s, d: statements.monthly(_j(s, d)), over("journal", MONTHLY)),
    "period_comparison": (
        lambda s, d: statements.compared(_period_ratios(s, d), "1999-12-31", "1998-12-31"),
        over("journal", "WITH p(period) AS (SELECT * FROM (VALUES ('1999-12-31'), ('1998-12-31')) AS t(a)), src AS (SELECT * FROM (" + DERIVED.format(f"SELECT period, {FIGURES} FROM p JOIN journal ON date <= CAST(period AS DATE) GROUP BY period") + ")), "
             + _ratios_sql("SELECT * FROM src0", "period, ").replace("WITH src AS (SELECT * FROM src0), ", "").replace(") SELECT period, grp", "), q AS (SELECT period, grp", 1)
             + ") SELECT a.ratio, a.value AS now, b.value AS before, CASE WHEN abs((a.value - b.value) / b.value) < 0.01 THEN 'flat' WHEN (a.value > b.value) = (a.ratio IN ('current', 'gross_margin', 'net_margin')) THEN 'better' ELSE 'worse' END AS trend FROM q a JOIN q b ON a.ratio = b.ratio AND a.period = '1999-12-31' AND b.period = '1998-12-31' WHERE a.ratio IN ('current', 'leverage', 'gross_margin', 'net_margin', 'collection_days') AND abs(b.value) >= 0.0001"),
    ),
    "presentation_map": (
        lambda s, d: statements.presentation(_j(s, d).groupBy("account").agg((F.sum("debit_kr") - F.sum("credit_kr")).alias("net_kr")), _lines(s)),
        over("journal", f"WITH {_LINES_SQL}, b AS (SELECT account, sum(debit_kr - credit_kr) AS n FROM journal GROUP BY account), e AS (SELECT account, n, line FROM b JOIN lines ON account LIKE prefix || '%'), c AS (SELECT account, count(DISTINCT line) AS k FROM e GROUP BY account) SELECT line, CAST(sum(n) AS BIGINT) AS net_kr, count(*) FILTER (WHERE k > 1) AS ambiguous FROM e JOIN c ON c.account = e.account GROUP BY line"),
    ),
}

DATES = {
    **dict.fromkeys(("general_ledger", "journal_last_n", "ledger_page", "invoice_postings", "return_postings", "cogs_postings", "discount_postings", "purchase_postings", "voucher_numbering", "reversal", "duplicate_documents"), ["date"]),
    "monthly_comparison": ["month"],
}
