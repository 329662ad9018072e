"""Queries over reconciliation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import audit, ledger, movements, reconcile
from tallyspark.plans.books import CHART_SQL, NATURE
from tallyspark.plans.money_flows import _ALL, _PAID, _all, _paid
from tallyspark.sources.model import INSTRUMENTS, chart, over, table, view

_j = lambda s, d: view(s, d, "journal")
_s = lambda s, d: view(s, d, "sales")
_r = lambda s, d: view(s, d, "receipts")


def _named(s, d):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, " - FAST Anlık Ödeme").when(k % 3 == 1, " - şube").otherwise("")
    return table(s, d, "customer").select(k.alias("id"), F.concat(F.lit("Sayın Şti "), F.initcap("c_mktsegment"), F.lit(" "), (k % 50).cast("string"), tail).alias("raw")).withColumn("name", names.canonical("raw"))


_NAMED_SQL = """named AS (SELECT id, raw, CASE WHEN tail THEN 'STI ' || seg || ' ' || k ELSE 'STI ' || seg || ' ' || k || more END AS name FROM (SELECT c_custkey AS id, upper(c_mktsegment) AS seg, CAST(c_custkey % 50 AS VARCHAR) AS k, c_custkey % 3 = 0 AS tail, CASE WHEN c_custkey % 3 = 1 THEN ' SUBE' ELSE '' END AS more,
 'Sayın Şti ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || CAST(c_custkey % 50 AS VARCHAR) || CASE c_custkey % 3 WHEN 0 THEN ' - FAST Anlık Ödeme' WHEN 1 THEN ' - şube' ELSE '' END AS raw FROM customer))"""


def _pairs(s, d):
    n = _named(s, d).select("id", "name")
    return reconcile.name_pairs(n.where("id % 100 = 0"), n, 0.75)


def _ours(s, d):
    return _r(s, d).select("id", F.col("bank").alias("name"), (F.col("amount_kr") % 997).alias("amount_kr"), "date")


def _theirs(s, d):
    return _ours(s, d).where("id % 4 <> 0").select((F.col("id") * 2 + 1).alias("id"), "name", "amount_kr", F.date_add("date", (F.col("id") % 9).cast("int")).alias("date"))


def _reconciled(s, d):
    return view(s, d, "reconciled", lambda s, d: reconcile.reconcile(_ours(s, d), _theirs(s, d), 31))


def _texts(s, d):
    """Movements with names and notes; some names have none, some notes hint at a reversal."""
    u = F.col("user")
    name = F.when(u % 11 != 0, F.concat(F.lit("Sayın Firma "), F.chr(65 + u % 5), F.lit(" Grup "), (u % 3).cast("string")))
    text = F.when(F.col("seq") % 4 == 0, "Havale iadesi").when(F.col("seq") % 4 == 1, "Payment REFUND").when(F.col("seq") % 4 == 2, "ödeme")
    return view(s, d, "movements").select("account", "seq", "direction", (F.col("amount_kr") % 300).alias("amount_kr"), text.alias("text"), name.alias("name"))


def _statements(s, d):
    m = view(s, d, "movements").withColumn("period", F.trunc("date", "week"))
    by = m.groupBy("account", "period").agg(F.min_by(F.col("balance_kr") - reconcile.signed(), "seq").alias("opening_kr"), F.max_by("balance_kr", "seq").alias("closing_kr"))
    return by.withColumn("opening_kr", F.when(F.col("account") % 4 == 3, F.col("opening_kr") + 5).otherwise(F.col("opening_kr")))


def _suggest(s, d):
    items = _r(s, d).select("id", "amount_kr", F.date_add("date", (F.col("id") % 70 / 10).cast("int")).alias("date"))
    v = _j(s, d).where("kind = 'receipt' and debit_kr > 0").select("voucher", F.col("debit_kr").alias("amount_kr"), "date")
    return reconcile.suggestions(items, v, 3)


def _documents(s, d):
    items = _s(s, d).select(F.col("no").alias("id"), F.col("gross_kr").alias("amount_kr"), F.date_add("date", (F.col("no") % 90 / 10).cast("int")).alias("date"))
    v = ledger.voucher_totals(_j(s, d)).join(_j(s, d).groupBy("voucher").agg(F.min("date").alias("date")), "voucher").select("voucher", F.col("debit_kr").alias("amount_kr"), "date")
    return reconcile.suggestions(items, v, 5)


_DAY = lambda x: f"(year({x}) * 372 + month({x}) * 31 + day({x}))"
#: Step by step, the i-th of ours in every group takes the nearest of what is left.
_GREEDY_SQL = f"""our AS (SELECT id, bank AS name, amount_kr % 997 AS amount_kr, date FROM receipt), their AS (SELECT id * 2 + 1 AS id, name, amount_kr, date + CAST(id % 9 AS INTEGER) AS date FROM our WHERE id % 4 <> 0),
g AS (SELECT * FROM (SELECT name, amount_kr, list({{'day': {_DAY("date")}, 'id': id}} ORDER BY {_DAY("date")}, id) AS ours FROM our GROUP BY ALL) JOIN (SELECT name, amount_kr, list({{'day': {_DAY("date")}, 'id': id}}) AS theirs FROM their GROUP BY ALL) USING (name, amount_kr)),
p AS (SELECT name, amount_kr, ours, 0 AS i, theirs AS rest, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS their_id FROM g
  UNION ALL SELECT name, amount_kr, ours, i + 1, list_filter(rest, lambda y: y.id IS DISTINCT FROM near.id), ours[i + 1].id, near.id FROM (SELECT *, list_sort(list_transform(list_filter(rest, lambda y: abs(y.day - ours[i + 1].day) <= 31), lambda y: {{'far': abs(y.day - ours[i + 1].day), 'id': y.id}}))[1] AS near FROM p WHERE i < len(ours)))"""
_REVERSAL_SQL = """m AS (SELECT account, seq, direction, amount_kr % 300 AS amount_kr, seq % 4 IN (0, 1) AS hint, CASE WHEN "user" % 11 <> 0 THEN ['FIRMA', chr(CAST(65 + "user" % 5 AS INTEGER)), 'GRUP', CAST("user" % 3 AS VARCHAR)] END AS w FROM movement)
SELECT a.account, a.seq, a.direction, a.amount_kr, max(b.seq) AS reverses FROM m a JOIN m b ON a.account = b.account AND a.amount_kr = b.amount_kr AND a.direction <> b.direction AND b.seq < a.seq AND a.hint AND ((a.w IS NULL AND b.w IS NULL) OR len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w)))) GROUP BY ALL"""
#: Texts of movements with what they are if money comes in and if it goes out.
_SAID = [
    ("GELEN TRANSFER 12", "havale_eft_fast_tahsilat", "DIGER"), ("Giden EFT ücreti", "havale_eft_fast_tahsilat", "banka_masrafi"), ("Hesap işletim bedeli", "DIGER", "banka_masrafi"), ("B.S.M.V", "DIGER", "bsmv_ayri_satir"),
    ("KKDF kesintisi", "DIGER", "kkdf"), ("spot kredi", "kredi_kullanim", "DIGER"), ("Kredi taksit ödeme", "DIGER", "kredi_taksit_odeme"), ("Vadeli faiz", "mevduat_faizi", "DIGER"), ("KDV ödeme", "DIGER", "vergi_sgk_odeme"),
    ("Damga", "DIGER", "damga_odeme"), ("toplu maaş", "DIGER", "maas_odemesi"), ("Kendi hesap virman", "kendi_hesap_virman", "kendi_hesap_virman"), ("Sanal POS", "pos_yatis", "DIGER"), ("USD kur farkı", "doviz_kur_farki", "doviz_kur_farki"),
    ("market", "DIGER", "DIGER"), ("", "DIGER", "DIGER"), ("EFT MTV", "havale_eft_fast_tahsilat", "havale_eft_fast_odeme"),
]
_SAID_SQL = "said(k, came, went) AS (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (_, a, b) in enumerate(_SAID)) + "), typed AS (SELECT seq AS id, direction, amount_kr, CASE WHEN direction = 'GIRIS' THEN came ELSE went END AS type FROM movement JOIN said ON k = seq % 17)"
_BOOKED = {"havale_eft_fast_tahsilat": ("102", "120"), "havale_eft_fast_odeme": ("320", "102"), "banka_masrafi": ("770", "102"), "bsmv_ayri_satir": ("780", "102"), "kkdf": ("153", "102"), "kredi_kullanim": ("102", "300"), "vergi_sgk_odeme": ("360", "102"), "damga_odeme": ("360", "102"), "maas_odemesi": ("335", "102"), "kendi_hesap_virman": ("102.hedef", "102.kaynak")}
_DRAFTED_SQL = f"""WITH {_SAID_SQL}, acc(type, debit, credit) AS (VALUES {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _BOOKED.items())}),
t AS (SELECT typed.*, debit, credit, CASE WHEN typed.type = 'DIGER' THEN 'YOK' WHEN debit IS NULL THEN 'AYRISTIRMA' WHEN typed.type = 'banka_masrafi' THEN 'OTOMATIK' ELSE 'ONAY' END AS status FROM typed LEFT JOIN acc ON acc.type = typed.type)
SELECT id, status, 0 AS line_no, CAST(NULL AS VARCHAR) AS account, CAST(NULL AS BIGINT) AS debit_kr, CAST(NULL AS BIGINT) AS credit_kr FROM t WHERE status IN ('YOK', 'AYRISTIRMA') UNION ALL SELECT id, status, 1, debit, amount_kr, 0 FROM t WHERE status IN ('ONAY', 'OTOMATIK') UNION ALL SELECT id, status, 2, credit, 0, amount_kr FROM t WHERE status IN ('ONAY', 'OTOMATIK')"""


def _typed(s, d):
    texts = F.array(*[F.lit(x) for x, _, _ in _SAID])
    said = view(s, d, "movements").select(F.col("seq").alias("id"), "direction", "amount_kr", F.get(texts, (F.col("seq") % len(_SAID)).cast("int")).alias("text"))
    return movements.classified(said, movements.MOVEMENTS)


_OPEN_SQL = _ALL + ", op AS (SELECT no, party, date, net_debt_kr - coalesce((SELECT sum(amount_kr) FROM alloc a WHERE a.no = sale.no), 0) AS open_kr FROM sale)"


def _both_ways(s, d):
    """Money in and out."""
    return _r(s, d).unionByName(view(s, d, "payments"))


def _allocations(s, d):
    """What is allocated, of both directions, with its instrument; written, since invoices ask for its sums and its instruments."""
    return view(s, d, "instruments", _instruments)


def _instruments(s, d):
    sold = _all(s, d).select(F.lit("SATIS").alias("direction"), "id", "no", "amount_kr")
    bought = _paid(s, d).select(F.lit("ALIS").alias("direction"), "id", "no", "amount_kr")
    return sold.unionByName(bought).join(_both_ways(s, d).select("direction", "id", "instrument"), ["direction", "id"])


def _invoices(s, d):
    """Sales and purchases with what is paid of them; every fourth customer gets archive invoices."""
    same = ["direction", "no", "party", "date", "state", "valid", "gross_kr", "net_debt_kr", "instrument", "document"]
    kind = F.when(F.col("party") % 4 == 0, "E_ARSIV").otherwise("E_FATURA")
    by = F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in INSTRUMENTS.items()])
    sold = _s(s, d).select("*", by.alias("instrument"), kind.alias("document")).select(same)
    bought = view(s, d, "purchases").select("*", F.lit("KABUL").alias("state"), F.lit(True).alias("valid"), F.col("gross_kr").alias("net_debt_kr"), F.lit("ACIK").alias("instrument"), F.lit("E_FATURA").alias("document")).select(same)
    out = sold.unionByName(bought).withColumn("name", F.concat(F.when(F.col("direction") == "SATIS", "Customer#").otherwise("Supplier#"), F.col("party").cast("string")))
    return view(s, d, "settled", lambda s, d: audit.settled(out, _allocations(s, d)))


def _found(s, d):
    return audit.found_invoices(_invoices(s, d), _allocations(s, d), text="CUSTOMER#1", direction="SATIS", instrument="BANKA", low_kr=1_000_000, since="1994-01-01", tab="giden", paid="kismi", allocatable=True)


_MONEY_SQL = "money AS (SELECT id, 'SATIS' AS direction, date, amount_kr, instrument FROM receipt UNION ALL SELECT id, 'ALIS', date, amount_kr, instrument FROM payment)"
_BOOK_SQL = f"""WITH {_MONEY_SQL}, rows_ AS (SELECT id, direction AS source, date, amount_kr, 1 AS rank FROM money WHERE instrument = 'NAKIT' UNION ALL
 SELECT NULL, 'VIRMAN', CAST(date_trunc('month', date) AS DATE), CAST(sum(amount_kr) AS BIGINT), 0 FROM money WHERE instrument = 'NAKIT' AND direction = 'ALIS' GROUP BY 3),
book AS (SELECT id, source, date, amount_kr, CAST(25000000 + sum(CASE WHEN source = 'ALIS' THEN -amount_kr ELSE amount_kr END) OVER (ORDER BY date, rank, id NULLS FIRST, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_kr, source <> 'VIRMAN' AND amount_kr > 700000 AS over_limit FROM rows_)"""
_SETTLED_SQL = (
    _ALL + ", " + _PAID + """, al AS (SELECT 'SATIS' AS direction, a.no, amount_kr, instrument FROM alloc a JOIN rec ON rec.id = a.id UNION ALL SELECT 'ALIS', a.no, amount_kr, instrument FROM palloc a JOIN pay ON pay.id = a.id),
invo AS (SELECT 'SATIS' AS direction, no, party, date, state, valid, gross_kr, net_debt_kr, CASE priority WHEN '1-URGENT' THEN 'BANKA' WHEN '2-HIGH' THEN 'NAKIT' WHEN '3-MEDIUM' THEN 'CEK' WHEN '4-NOT SPECIFIED' THEN 'SENET' WHEN '5-LOW' THEN 'ACIK' END AS instrument,
 CASE WHEN party % 4 = 0 THEN 'E_ARSIV' ELSE 'E_FATURA' END AS document, 'Customer#' || CAST(party AS VARCHAR) AS name FROM sale UNION ALL SELECT 'ALIS', no, party, date, 'KABUL', true, gross_kr, gross_kr, 'ACIK', 'E_FATURA', 'Supplier#' || CAST(party AS VARCHAR) FROM purchase),
settled AS (SELECT i.*, CAST(coalesce(p, 0) AS BIGINT) AS paid_kr, CAST(net_debt_kr - coalesce(p, 0) AS BIGINT) AS open_kr FROM invo i LEFT JOIN (SELECT direction AS pd, no AS pn, sum(amount_kr) AS p FROM al GROUP BY 1, 2) ON pd = direction AND pn = no)"""
)
_FOUND_SQL = _SETTLED_SQL + """, found AS (SELECT * FROM settled WHERE lower(CAST(no AS VARCHAR) || ' ' || name) LIKE '%customer#1%' AND direction = 'SATIS' AND gross_kr >= 1000000 AND date >= DATE '1994-01-01' AND document = 'E_FATURA' AND state <> 'TASLAK' AND paid_kr > 0 AND open_kr > 0 AND valid
 AND (instrument = 'BANKA' OR EXISTS (SELECT 1 FROM al WHERE al.direction = settled.direction AND al.no = settled.no AND al.instrument = 'BANKA')))"""


def _numbers(s, d):
    return table(s, d, "events").select((F.col("event_id") % 5).alias("series"), (F.call_function("div", F.col("event_id"), F.lit(5)) + F.call_function("div", F.col("event_id"), F.lit(200))).alias("number"), F.date_sub(F.col("ts").cast("date"), F.when(F.col("event_id") % 50 == 0, 9).otherwise(0)).alias("date"))


_RULES = [("600", "120"), ("391", "120"), ("621", "153"), ("610", "120")]

QUERIES = {
    "canonical_names": (_named, f"WITH {_NAMED_SQL} SELECT * FROM named"),
    "name_similarity": (_pairs, f"WITH {_NAMED_SQL}, w AS (SELECT id, name, list_distinct(string_split(name, ' ')) AS w FROM named WHERE id % 100 = 0), v AS (SELECT DISTINCT name, list_distinct(string_split(name, ' ')) AS v FROM named), p AS (SELECT id, v.name AS other, len(list_intersect(w, v)) AS i, len(w) + len(v) AS n FROM w, v) SELECT id, other, round(1.0::DOUBLE * i / (n - i), 6) AS score FROM p WHERE i > 0 AND round(1.0::DOUBLE * i / (n - i), 6) >= 0.75"),
    "name_links": (lambda s, d: reconcile.name_links(_named(s, d), 0.75), f"WITH {_NAMED_SQL}, w AS (SELECT name, list_distinct(string_split(name, ' ')) AS w FROM (SELECT DISTINCT name FROM named)), p AS (SELECT a.name, b.name AS other, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.name < b.name) SELECT name, other, round(1.0::DOUBLE * i / (n - i), 6) AS score FROM p WHERE round(1.0::DOUBLE * i / (n - i), 6) >= 0.75"),
    "reconcile_greedy": (_reconciled, over("receipt", f"WITH {_GREEDY_SQL} SELECT name, amount_kr, id, their_id FROM p WHERE their_id IS NOT NULL")),
    "reconcile_leftovers": (lambda s, d: reconcile.leftovers(_ours(s, d), _reconciled(s, d), _theirs(s, d)), over("receipt", f"WITH {_GREEDY_SQL} SELECT id, name, amount_kr, CASE WHEN name IN (SELECT name FROM their) THEN 'GrupIciEksik' ELSE 'IsimYok' END AS category FROM our WHERE id NOT IN (SELECT id FROM p WHERE their_id IS NOT NULL)")),
    "reversals": (lambda s, d: reconcile.reversals(_texts(s, d)), over("movement", f"WITH {_REVERSAL_SQL}")),
    "balance_chain": (lambda s, d: reconcile.balance_chain(view(s, d, "movements")), over("movement", "SELECT * FROM (SELECT account, seq, CAST(coalesce(lag(balance_kr) OVER (PARTITION BY account ORDER BY seq), 0) + CASE WHEN direction = 'GIRIS' THEN amount_kr ELSE -amount_kr END AS BIGINT) AS expected_kr, balance_kr FROM movement) WHERE expected_kr <> balance_kr")),
    "statement_carry": (lambda s, d: reconcile.statement_carry(_statements(s, d)), over("movement", "WITH m AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS period FROM movement), b AS (SELECT account, period, arg_min(balance_kr - CASE WHEN direction = 'GIRIS' THEN amount_kr ELSE -amount_kr END, seq) + CASE WHEN account % 4 = 3 THEN 5 ELSE 0 END AS opening_kr, arg_max(balance_kr, seq) AS closing_kr FROM m GROUP BY account, period) SELECT * FROM (SELECT *, lag(closing_kr) OVER (PARTITION BY account ORDER BY period) AS carried_kr FROM b) WHERE carried_kr <> opening_kr")),
    "reversal_pairs": (lambda s, d: reconcile.reversal_pairs(view(s, d, "movements").withColumn("amount_kr", F.col("amount_kr") % 500)), over("movement", "WITH m AS (SELECT account, seq, direction, amount_kr % 500 AS amount_kr FROM movement), w AS (SELECT *, max(CASE WHEN direction = 'GIRIS' THEN seq END) OVER w AS i, max(CASE WHEN direction = 'CIKIS' THEN seq END) OVER w AS o FROM m WINDOW w AS (PARTITION BY account, amount_kr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT account, seq, direction, amount_kr, CASE WHEN direction = 'GIRIS' THEN o ELSE i END AS reverses FROM w WHERE CASE WHEN direction = 'GIRIS' THEN o ELSE i END IS NOT NULL")),
    "bank_suggestions": (_suggest, over("journal", f"WITH i AS (SELECT id, amount_kr, date + CAST(id % 70 // 10 AS INTEGER) AS date FROM receipt), v AS (SELECT voucher, debit_kr AS amount_kr, date FROM journal WHERE kind = 'receipt' AND debit_kr > 0) SELECT id, voucher, days FROM (SELECT id, voucher, CAST(abs({_DAY('i.date')} - {_DAY('v.date')}) AS INTEGER) AS days, row_number() OVER (PARTITION BY id ORDER BY voucher) AS k FROM i JOIN v ON i.amount_kr = v.amount_kr AND abs({_DAY('i.date')} - {_DAY('v.date')}) <= 3) WHERE k <= 10")),
    "document_suggestions": (_documents, over("journal", f"WITH i AS (SELECT no AS id, gross_kr AS amount_kr, date + CAST(no % 90 // 10 AS INTEGER) AS date FROM sale), v AS (SELECT voucher, sum(debit_kr) AS amount_kr, min(date) AS date FROM journal GROUP BY voucher) SELECT id, voucher, days FROM (SELECT id, voucher, CAST(abs({_DAY('i.date')} - {_DAY('v.date')}) AS INTEGER) AS days, row_number() OVER (PARTITION BY id ORDER BY voucher) AS k FROM i JOIN v ON i.amount_kr = v.amount_kr AND abs({_DAY('i.date')} - {_DAY('v.date')}) <= 5) WHERE k <= 10")),
    "bank_text_types": (lambda s, d: _typed(s, d).select("id", "direction", "type"), over("movement", f"WITH {_SAID_SQL} SELECT id, direction, type FROM typed")),
    "bank_movement_drafts": (lambda s, d: movements.drafted(_typed(s, d), movements.MOVEMENTS), over("movement", _DRAFTED_SQL)),
    "contrary_nature": (lambda s, d: audit.contrary_nature(_j(s, d), chart(s)), over("journal", f"WITH {CHART_SQL}, n AS (SELECT account, split_part(account, '.', 1) AS k, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS net_kr FROM journal GROUP BY account), m AS (SELECT account, code, {NATURE} AS nature, net_kr FROM n JOIN chart ON code = k) SELECT account, nature, net_kr, CASE WHEN code IN ('100', '102', '153') THEN 'high' WHEN code IN ('120', '320', '191', '391') THEN 'mid' ELSE 'low' END AS severity FROM m WHERE (nature = 'debit' AND net_kr < 0) OR (nature = 'credit' AND net_kr > 0)")),
    "monthly_deviation": (lambda s, d: audit.monthly_deviation(_j(s, d), "6"), over("journal", "WITH b AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(abs(debit_kr - credit_kr)) AS BIGINT) AS amount_kr FROM journal WHERE account LIKE '6%' GROUP BY 1 HAVING sum(abs(debit_kr - credit_kr)) <> 0), m AS (SELECT sum(amount_kr)::DOUBLE / count(*) AS mean FROM b HAVING count(*) >= 3) SELECT * FROM (SELECT month, amount_kr, round(100 * (amount_kr - mean) / mean, 6) AS deviation FROM b, m) WHERE abs(deviation) > 15")),
    "ageing": (lambda s, d: audit.ageing(_invoices(s, d).where("direction = 'SATIS'"), "2001-08-01"), over("sale receipt", f"{_OPEN_SQL}, a AS (SELECT *, date_diff('day', date, DATE '2001-08-01') AS age FROM op WHERE open_kr > 0) SELECT party, CAST(sum(CASE WHEN age <= 30 THEN open_kr ELSE 0 END) AS BIGINT) AS upto_30, CAST(sum(CASE WHEN age > 30 AND age <= 90 THEN open_kr ELSE 0 END) AS BIGINT) AS upto_90, CAST(sum(CASE WHEN age > 90 AND age <= 180 THEN open_kr ELSE 0 END) AS BIGINT) AS upto_180, CAST(sum(CASE WHEN age > 180 AND age <= 365 THEN open_kr ELSE 0 END) AS BIGINT) AS upto_365, CAST(sum(CASE WHEN age > 365 THEN open_kr ELSE 0 END) AS BIGINT) AS older, CAST(sum(open_kr) AS BIGINT) AS total_kr FROM a GROUP BY party")),
    "benford": (lambda s, d: audit.benford(_s(s, d).select(F.col("gross_kr").alias("amount_kr"))), over("sale", "WITH c AS (SELECT CAST(left(CAST(gross_kr AS VARCHAR), 1) AS INTEGER) AS digit, count(*) AS n FROM sale WHERE gross_kr >= 100 GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM c) SELECT digit, n, round(n / total, 6) AS share, round(log10(1 + 1.0::DOUBLE / digit), 6) AS expected, round(pow(n - total * log10(1 + 1.0::DOUBLE / digit), 2) / (total * log10(1 + 1.0::DOUBLE / digit)), 4) AS chi2 FROM c, t")),
    "near_duplicates": (lambda s, d: audit.near_duplicates(_s(s, d).withColumn("gross_kr", F.call_function("div", F.col("gross_kr"), F.lit(1_000_000))), 60), over("sale", "WITH w AS (SELECT no, party, gross_kr // 1000000 AS gross_kr, date FROM sale WHERE gross_kr // 1000000 > 0) SELECT no, before, party, gross_kr, days FROM (SELECT *, lag(no) OVER w AS before, CAST(date_diff('day', lag(date) OVER w, date) AS INTEGER) AS days FROM w WINDOW w AS (PARTITION BY party, gross_kr ORDER BY date, no)) WHERE days <= 60")),
    "time_pattern": (lambda s, d: audit.time_pattern(table(s, d, "events")), "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 6) AS night, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend, round((count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 6) + count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)))::DOUBLE / count(*), 6) AS share FROM events GROUP BY user_id"),
    "round_amounts": (lambda s, d: audit.round_amounts(_j(s, d), 1000, 1_000_000), over("journal", "SELECT voucher, line_no, account, greatest(debit_kr, credit_kr) AS amount_kr FROM journal WHERE greatest(debit_kr, credit_kr) >= 1000000 AND greatest(debit_kr, credit_kr) % 1000 = 0")),
    "unexpected_contra": (lambda s, d: audit.unexpected_contra(_j(s, d).where("kind <> 'opening'"), s.createDataFrame(_RULES, "code string, contra string")), over("journal", "WITH r(code, contra) AS (SELECT * FROM (VALUES ('600', '120'), ('391', '120'), ('621', '153'), ('610', '120')) AS t(a, b)), s AS (SELECT DISTINCT voucher, split_part(account, '.', 1) AS code, debit_kr > 0 AS debit FROM journal WHERE kind <> 'opening'), p AS (SELECT a.code, b.code AS contra, count(DISTINCT a.voucher) AS vouchers FROM s a JOIN s b ON a.voucher = b.voucher AND a.debit <> b.debit GROUP BY a.code, b.code) SELECT * FROM p WHERE code IN (SELECT code FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.code = p.code AND r.contra = p.contra)")),
    "cut_off": (lambda s, d: audit.cut_off(_s(s, d), "1998-12-31"), over("sale", "SELECT no, party, CAST(date_diff('day', DATE '1998-12-31', date) AS INTEGER) AS offset_days, gross_kr, return_net_kr > 0 AS returned FROM sale WHERE abs(date_diff('day', DATE '1998-12-31', date)) <= 5")),
    "concentration": (lambda s, d: audit.concentration(_s(s, d), 1), over("sale", "WITH b AS (SELECT party, CAST(sum(net_kr) AS BIGINT) AS net_kr FROM sale WHERE valid GROUP BY party), t AS (SELECT sum(net_kr) AS total_kr FROM b) SELECT party, net_kr, round(1000.0::DOUBLE * net_kr / total_kr::DOUBLE, 6) AS per_mille FROM b, t WHERE 1000 * net_kr >= total_kr")),
    "chain_equality": (lambda s, d: audit.chain_equality(_j(s, d), ["621"], ["153"]), over("journal", "SELECT l AS left_kr, r AS right_kr, l - r AS difference_kr FROM (SELECT CAST(sum(CASE WHEN left(account, 3) = '621' THEN debit_kr ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN left(account, 3) = '153' THEN credit_kr ELSE 0 END) AS BIGINT) AS r FROM journal)")),
    "sequence_gaps": (lambda s, d: audit.sequence_gaps(_numbers(s, d)), "WITH n AS (SELECT event_id % 5 AS series, event_id // 5 + event_id // 200 AS number, CAST(ts AS DATE) - CASE WHEN event_id % 50 = 0 THEN 9 ELSE 0 END AS date FROM events), w AS (SELECT *, lag(number) OVER (PARTITION BY series ORDER BY number) AS before, lag(date) OVER (PARTITION BY series ORDER BY number) AS d FROM n) SELECT series, number, before, date < d AS back_dated FROM w WHERE number - before <> 1 OR date < d"),
    "cash_book": (lambda s, d: audit.cash_book(_both_ways(s, d)), over("receipt payment", _BOOK_SQL + " SELECT *, balance_kr < 0 AS negative FROM book")),
    "cash_findings": (lambda s, d: audit.cash_findings(audit.cash_book(_both_ways(s, d))), over("receipt payment", _BOOK_SQL + " SELECT count(*) AS n, CAST(count_if(over_limit) AS BIGINT) AS over_n, CAST(coalesce(sum(amount_kr) FILTER (over_limit), 0) AS BIGINT) AS over_kr, CAST(count_if(balance_kr < 0) AS BIGINT) AS negative_n, CAST(coalesce(sum(amount_kr) FILTER (source = 'VIRMAN'), 0) AS BIGINT) AS transfers_kr, CAST(25000000 + sum(CASE WHEN source = 'ALIS' THEN -amount_kr ELSE amount_kr END) AS BIGINT) AS closing_kr FROM book")),
    "bank_book": (lambda s, d: audit.bank_book(view(s, d, "movements")), over("movement", "SELECT account, seq, date, direction, amount_kr, CAST(500000000 + sum(CASE WHEN direction = 'GIRIS' THEN amount_kr ELSE -amount_kr END) OVER (PARTITION BY account ORDER BY seq) AS BIGINT) AS running_kr FROM movement")),
    "invoice_search": (lambda s, d: audit.invoice_page(_found(s, d), "tarih_desc", offset=2, limit=40), over("sale receipt payment", _FOUND_SQL + " SELECT direction, no, party, date, state, instrument, gross_kr, paid_kr, open_kr FROM found ORDER BY date DESC, direction, no LIMIT 40 OFFSET 2")),
    "invoice_search_totals": (lambda s, d: audit.invoice_totals(_found(s, d)), over("sale receipt payment", _FOUND_SQL + " SELECT count(*) AS n, CAST(coalesce(sum(open_kr), 0) AS BIGINT) AS open_kr FROM found")),
    "invoice_tabs": (lambda s, d: audit.invoice_tabs(_s(s, d)), over("sale", "SELECT state, count(*) AS n, CAST(sum(gross_kr) AS BIGINT) AS gross_kr, CAST(sum(net_debt_kr) AS BIGINT) AS net_debt_kr FROM sale GROUP BY state")),
    "party_summary": (lambda s, d: audit.party_summary(_s(s, d), _all(s, d)), over("receipt", _ALL + ", p AS (SELECT no, sum(amount_kr) AS paid FROM alloc GROUP BY no) SELECT party, count(*) AS n, CAST(sum(net_debt_kr) AS BIGINT) AS debt_kr, CAST(coalesce(sum(paid), 0) AS BIGINT) AS paid_kr, CAST(sum(net_debt_kr) - coalesce(sum(paid), 0) AS BIGINT) AS open_kr FROM sale LEFT JOIN p ON p.no = sale.no WHERE valid GROUP BY party")),
}
DATES = {"statement_carry": ["period"], "monthly_deviation": ["month"], "cash_book": ["date"], "bank_book": ["date"], "invoice_search": ["date"]}
