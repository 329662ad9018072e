"""Queries over adjustments, loans and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.functions.money import kurus
from tallyspark.operators import adjustments, credit, documents, terms
from tallyspark.plans.books import CHART_SQL
from tallyspark.sources.model import chart, over, table, view

_j = lambda s, d: view(s, d, "journal")


def _net(s, d):
    return _j(s, d).groupBy("account").agg((F.sum("debit_kr") - F.sum("credit_kr")).alias("net_kr"))


_ENTRIES = [
    ("AJE-1", "AJE", "TASI_BIRAK", "654.90", 500_000, 0), ("AJE-1", "AJE", "TASI_BIRAK", "129.90", 0, 500_000), ("AJE-2", "AJE", "TERS_CEVIR", "657.90", 120_000, 0), ("AJE-2", "AJE", "TERS_CEVIR", "122.90", 0, 120_000),
    ("RJE-1", "RJE", "AYNEN", "400", 900_000, 0), ("RJE-1", "RJE", "AYNEN", "303.90", 0, 900_000), ("RJE-2", "RJE", "TASIMA_YOK", "600", 10, 0), ("RJE-2", "RJE", "TASIMA_YOK", "120", 0, 10),
    ("AJE-3", "AJE", "YENIDEN_URET", "153", 77, 0), ("AJE-4", "AJE", "AYNEN", "153", 80, 0), ("AJE-4", "AJE", "AYNEN", "621", 0, 81), ("AJE-5", "AJE", "AYNEN", "999", 5, 0), ("AJE-5", "AJE", "AYNEN", "153", 0, 5),
    ("AJE-6", "AJE", "AYNEN", "153", 44, 0), ("AJE-6", "AJE", "AYNEN", "621", 0, 44), ("AJE-7", "AJE", "AYNEN", "153", 44, 0), ("AJE-7", "AJE", "AYNEN", "621", 0, 44),
]
_ENTRIES_SQL = "entries(no, kind, carry, account, debit_kr, credit_kr) AS (SELECT * FROM (VALUES " + ", ".join(str(e) for e in _ENTRIES) + ") AS t(a, b, c, d, e, f))"


def _entries(s):
    return s.createDataFrame(_ENTRIES, "no string, kind string, carry string, account string, debit_kr long, credit_kr long")


def _made(s, d):
    """An adjusting entry for each sale: against its party, some of one line, of two sides, unbalanced, on an unknown account or on profit and loss; many are alike."""
    no, c = F.col("no"), F.col
    fault, amount, zero = no % 11, c("net_kr") % 5 + 1, F.lit(0).cast("bigint")
    account = F.when(fault == 4, "999").when(no % 2 == 0, "654.90").otherwise("153")
    line = lambda a, debit, credit: F.struct(a.alias("account"), debit.alias("debit_kr"), credit.alias("credit_kr"))
    first = line(account, amount, F.when(fault == 2, amount).otherwise(zero))
    second = line(F.concat(F.lit("120."), c("party").cast("string")), zero, amount + F.when(fault == 3, 1).otherwise(0))
    carry = F.element_at(F.array(*map(F.lit, _CARRY)), (no % 5 + 1).cast("int"))
    return view(s, d, "sales").select(F.concat(F.lit("E"), no.cast("string")).alias("no"), F.when(no % 3 == 0, "RJE").otherwise("AJE").alias("kind"), carry.alias("carry"), F.inline(F.array_compact(F.array(first, F.when(fault != 1, second)))))


_CARRY = ["TASI_BIRAK", "TERS_CEVIR", "TASIMA_YOK", "YENIDEN_URET", "AYNEN"]
_MADE_SQL = f"""entries AS (SELECT 'E' || CAST(no AS VARCHAR) AS no, CASE WHEN no % 3 = 0 THEN 'RJE' ELSE 'AJE' END AS kind, list_extract({_CARRY}, CAST(no % 5 + 1 AS INTEGER)) AS carry, account, CAST(debit_kr AS BIGINT) AS debit_kr, CAST(credit_kr AS BIGINT) AS credit_kr FROM (
  SELECT no, CASE WHEN no % 11 = 4 THEN '999' WHEN no % 2 = 0 THEN '654.90' ELSE '153' END AS account, net_kr % 5 + 1 AS debit_kr, CASE WHEN no % 11 = 2 THEN net_kr % 5 + 1 ELSE 0 END AS credit_kr FROM sale
  UNION ALL SELECT no, '120.' || CAST(party AS VARCHAR), 0, net_kr % 5 + 1 + CASE WHEN no % 11 = 3 THEN 1 ELSE 0 END FROM sale WHERE no % 11 <> 1))"""


def _known(s, d):
    """The chart, accounts of adjustments, and whatever the journal was posted to."""
    extra = s.createDataFrame([("654.90",), ("129.90",), ("657.90",), ("122.90",), ("303.90",)], "code string")
    return chart(s).select("code").unionByName(extra).unionByName(_j(s, d).select(F.col("account").alias("code"))).distinct()


_N = "n AS (SELECT account, CAST(sum(debit_kr - credit_kr) AS BIGINT) AS net_kr FROM journal GROUP BY account)"
_HALF = lambda a, b: f"CAST(sign({a}) * ((2 * abs({a}) + {b}) // (2 * {b})) AS BIGINT)"


def _staff(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 + 1).alias("heads"), (F.col("s_suppkey") * 100_003 % 9_000_000 + 2_000_000).alias("wage_kr"), (F.col("s_suppkey") % 150).alias("tenths"), kurus(F.abs("s_acctbal")).alias("booked_kr"))


def _loans(s, d):
    c = F.col("c_custkey")
    method = F.element_at(F.array(*map(F.lit, ("Annuite", "EsitAnapara", "Spot"))), (c % 3 + 1).cast("int"))
    tranche = F.array(F.struct(F.lit(4).alias("months"), (c % 5000 + 100).alias("annual_bp")), F.struct(F.lit(3).alias("months"), (c % 3000 + 500).alias("annual_bp")))
    none = F.expr("cast(array() as array<struct<months:int,annual_bp:bigint>>)")
    return table(s, d, "customer").select(
        c.alias("id"), (c * 1_000_003 % 90_000_000 + 1_000_000).alias("principal_kr"), (c % 4800).alias("rate_bp"), (c % 23 + 2).alias("term"), F.lit("2026-01-31").cast("date").alias("start"), method.alias("method"),
        F.lit(500).alias("bsmv_bp"), F.when(c % 4 == 0, tranche).otherwise(none).alias("tranches"),
    )


_LOANS_SQL = """loans AS (SELECT c_custkey AS id, c_custkey * 1000003 % 90000000 + 1000000 AS p, c_custkey % 23 + 2 AS n, list_extract(['Annuite', 'EsitAnapara', 'Spot'], CAST(c_custkey % 3 + 1 AS INTEGER)) AS method FROM customer),
months AS (SELECT id, p, n, method, i, CAST(CASE WHEN id % 4 = 0 THEN CASE WHEN i <= 4 THEN id % 5000 + 100 ELSE id % 3000 + 500 END ELSE id % 4800 END AS DOUBLE) / 10000 / 12 AS r FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM loans)),
plan(id, i, p, n, method, r, fixed, part, interest, rest) AS (
 SELECT id, 0::BIGINT, p, n, method, -1.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT, p FROM loans
 UNION ALL SELECT id, i, p, n, method, r, fixed, part, interest, rest - part FROM (SELECT *, CAST(CASE WHEN i = n THEN rest WHEN method = 'Annuite' THEN least(greatest(fixed - interest, 0), rest) WHEN method = 'EsitAnapara' THEN least(p // n, rest) ELSE 0 END AS BIGINT) AS part FROM (
  SELECT m.id, m.i, m.p, m.n, m.method, m.r, x.rest, CAST(round(x.rest * m.r) AS BIGINT) AS interest, CASE WHEN m.r <> x.r THEN CASE WHEN m.r > 0 THEN CAST(round(x.rest * (m.r * pow(1 + m.r, m.n - m.i + 1) / (pow(1 + m.r, m.n - m.i + 1) - 1))) AS BIGINT) ELSE CAST(ceil(x.rest::DOUBLE / (m.n - m.i + 1)) AS BIGINT) END ELSE x.fixed END AS fixed
  FROM plan x JOIN months m ON m.id = x.id AND m.i = x.i + 1)))"""
_EQ = [("invoice", "net", 1), ("invoice", "vat", 1), ("invoice", "gross", 0), ("debt", "gross", 1), ("debt", "back", -1), ("debt", "owed", 0)]


def _values(s, d):
    v = view(s, d, "sales")
    legs = F.array(*[F.struct(F.lit(n).alias("field"), e.cast("bigint").alias("amount_kr")) for n, e in (("net", F.col("net_kr")), ("vat", F.col("vat_kr")), ("gross", F.col("gross_kr") + F.when(F.col("no") % 50 == 0, 9).otherwise(F.col("no") % 3)), ("back", F.col("return_net_kr") + F.col("return_vat_kr") + F.col("discount_net_kr") + F.col("discount_vat_kr")), ("owed", F.when(F.col("valid"), F.col("net_debt_kr"))))])
    return v.select(F.col("no").alias("doc_id"), F.inline(legs)).where("amount_kr is not null")


def _amounts(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), kurus("o_totalprice").alias("kr"))
    from tallyspark.functions.money import formatted

    raw = F.when(F.col("id") % 17 == 0, "okunamadı").otherwise(formatted("kr"))
    return o.select("id", raw.alias("raw"), names.parse_amount(raw, ",").alias("amount_kr"))


def _words(s, d):
    """Every word of the documents and how many hold it: texts are folded and taken apart once, for terms and lexicon."""
    each = lambda s, d: table(s, d, "documents").select(F.explode(F.array_distinct(F.split(names.simplify("text"), " "))).alias("term"))
    return view(s, d, "words", lambda s, d: each(s, d).groupBy("term").agg(F.count("*").alias("held")))


def _terms(s, d):
    return _words(s, d).select(F.xxhash64("term").alias("id"), "term")


def _lexicon(s, d):
    """Words of four letters or more that one document in fifty holds: a bounded number, whatever the documents are."""
    held = _words(s, d).where("length(term) >= 4")
    documents_ = table(s, d, "documents").agg(F.count("*").alias("n"))
    often = held.join(F.broadcast(documents_), F.col("held") * 50 >= F.col("n"))
    return often.select("term", F.lit(None).cast("string").alias("account"), F.pmod(F.xxhash64("term"), F.lit(1 << 62)).alias("place"))


def registry_corrections(s, d):
    """Every word of the documents against their frequent words."""
    return terms.corrections(_terms(s, d), _lexicon(s, d), s.createDataFrame([], "term string"))


LEXICON = ["the", "then", "there", "tion", "nicht", "dans", "avec", "para", "ción", "und", "eine", "that", "with", "from", "have"]


_ONES, _TENS = ("", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"), ("", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")


def _in_words(n):
    """Turkish words of a number from 0 to below 1000 milyar: its blocks of three digits, each with its scale."""
    ones, tens = F.array(*map(F.lit, _ONES)), F.array(*map(F.lit, _TENS))
    digit = lambda k: (F.call_function("div", n, F.lit(k)) % 10).cast("int")
    parts = []
    for scale, word in ((10**9, "milyar"), (10**6, "milyon"), (10**3, "bin"), (1, None)):
        hundred = digit(100 * scale)
        parts += [F.when(hundred > 1, F.get(ones, hundred)), F.when(hundred > 0, "yüz"), F.get(tens, digit(10 * scale)), F.get(ones, digit(scale))]
        if word:
            parts.append(F.when(F.call_function("div", n, F.lit(scale)) % 1000 > 0, word))
    return F.when(n == 0, "sıfır").otherwise(F.array_join(F.filter(F.array(*parts), lambda w: w != ""), " "))


def _all_numbers(s, d):
    text = _in_words(F.col("o_orderkey"))
    return documents.spelled(table(s, d, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", "number")


QUERIES = {
    "worksheet": (lambda s, d: adjustments.worksheet(_net(s, d), _entries(s)), over("journal", f"WITH {_N}, {_ENTRIES_SQL}, u AS (SELECT split_part(account, '.', 1) AS code, 'VUK' AS kind, net_kr, CAST(NULL AS VARCHAR) AS no FROM n UNION ALL SELECT account, kind, debit_kr - credit_kr, no FROM entries), g AS (SELECT code, CAST(sum(CASE WHEN kind = 'VUK' THEN net_kr ELSE 0 END) AS BIGINT) AS vuk, CAST(sum(CASE WHEN kind = 'AJE' THEN net_kr ELSE 0 END) AS BIGINT) AS aje, CAST(sum(CASE WHEN kind = 'RJE' THEN net_kr ELSE 0 END) AS BIGINT) AS rje, CAST(0 AS BIGINT) AS cf, coalesce(string_agg(DISTINCT no, ',' ORDER BY no), '') AS refs FROM u GROUP BY code) SELECT *, vuk + aje AS adjusted, vuk + aje + rje + cf AS tfrs FROM g WHERE vuk <> 0 OR aje <> 0 OR rje <> 0")),
    "carry_forward": (lambda s, d: adjustments.carried(_made(s, d)), over("sale", f"WITH {_MADE_SQL} SELECT no, 'CF' AS kind, CASE WHEN carry = 'TASI_BIRAK' AND left(account, 1) IN ('6', '7') THEN '570' ELSE account END AS account, CASE WHEN carry = 'TERS_CEVIR' THEN credit_kr ELSE debit_kr END AS debit_kr, CASE WHEN carry = 'TERS_CEVIR' THEN debit_kr ELSE credit_kr END AS credit_kr FROM entries WHERE carry NOT IN ('TASIMA_YOK', 'YENIDEN_URET')")),
    "entry_validation": (lambda s, d: adjustments.validated(_made(s, d), _known(s, d)), over("journal", f"WITH {CHART_SQL}, {_MADE_SQL}, k AS (SELECT code FROM chart UNION SELECT unnest(['654.90', '129.90', '657.90', '122.90', '303.90']) UNION SELECT account FROM journal), e AS (SELECT no, count(*) AS n, bool_or((debit_kr > 0) = (credit_kr > 0)) AS side, sum(debit_kr - credit_kr) AS off, bool_or(account NOT IN (SELECT code FROM k)) AS unknown, bool_or(kind = 'RJE' AND left(account, 1) IN ('6', '7')) AS touch, string_agg(account || ':' || debit_kr || ':' || credit_kr, ',' ORDER BY account, debit_kr, credit_kr) AS x FROM entries GROUP BY no), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY no) > 1 AS again FROM e) SELECT no, CASE WHEN n < 2 THEN 'U1' WHEN side THEN 'U2' WHEN off <> 0 THEN 'U3' WHEN unknown THEN 'U4' WHEN touch THEN 'U5' WHEN again THEN 'U6' ELSE 'OK' END AS rule FROM r")),
    "rediscount": (lambda s, d: adjustments.rediscount(_net(s, d)), over("journal", f"WITH {_N}, a AS (SELECT account, CASE WHEN account LIKE '12%' AND left(account, 3) NOT IN ('122', '128', '129') THEN 'receivable' WHEN account LIKE '32%' AND left(account, 3) <> '322' THEN 'payable' END AS side, net_kr FROM n), b AS (SELECT account, side, CASE WHEN side = 'receivable' THEN net_kr ELSE -net_kr END AS amount_kr FROM a WHERE side IS NOT NULL) SELECT *, amount_kr - CAST((2 * CAST(amount_kr AS HUGEINT) * 365000000 + 388850000) // (2 * 388850000) AS BIGINT) AS discount_kr FROM b WHERE amount_kr >= 1000000")),
    "expected_loss": (lambda s, d: adjustments.expected_loss(_net(s, d)), over("journal", f"WITH {_N}, g AS (SELECT CAST(greatest(sum(CASE WHEN account LIKE '120%' THEN net_kr ELSE 0 END), 0) + greatest(sum(CASE WHEN account LIKE '121%' THEN net_kr ELSE 0 END), 0) AS HUGEINT) AS g FROM n), p AS (SELECT g, {', '.join(f'(2 * g * {b} + 1000000) // 2000000 AS p{i}' for i, b in enumerate((500000, 250000, 120000, 80000), 1))} FROM g), q AS (SELECT *, g - p1 - p2 - p3 - p4 AS p5 FROM p) " + " UNION ALL ".join(f"SELECT {i} AS bucket, CAST(p{i} AS BIGINT) AS amount_kr, CAST((2 * p{i} * {r * 1050000} + 1000000000000) // 2000000000000 AS BIGINT) AS loss_kr FROM q" for i, r in enumerate((5000, 20000, 60000, 150000, 400000), 1)))),
    "severance": (lambda s, d: adjustments.severance(_staff(s, d)), f"WITH s AS (SELECT s_suppkey AS id, s_suppkey % 40 + 1 AS heads, s_suppkey * 100003 % 9000000 + 2000000 AS wage, s_suppkey % 150 AS tenths, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS booked FROM supplier), e AS (SELECT id, booked, (2 * heads * least(wage, 7372987) * tenths + 10) // 20 AS earned FROM s), p AS (SELECT *, CAST((2 * CAST(earned AS HUGEINT) * {950000 * adjustments.compound_ppm(35000, 10)} + 1000000000000) // 2000000000000 AS BIGINT) AS prov FROM e), d AS (SELECT *, prov - booked AS diff, (2 * greatest(prov - booked, 0) * 100000 + 1000000) // 2000000 AS short FROM p) SELECT id, earned AS earned_kr, prov AS provision_kr, diff AS difference_kr, short AS short_kr, greatest(diff, 0) - short AS long_kr FROM d"),
    "inventory_nrv": (lambda s, d: adjustments.realisable(_net(s, d)), over("journal", f"WITH {_N} SELECT account, net_kr, v AS value_kr, greatest(net_kr - v, 0) AS impairment_kr FROM (SELECT account, net_kr, CAST((2 * CAST(net_kr AS HUGEINT) * 912000000000 + 1000000000000) // 2000000000000 AS BIGINT) AS v FROM n WHERE account LIKE '15%' AND account NOT LIKE '158%' AND account NOT LIKE '159%' AND net_kr > 0)")),
    "scenario_legs": (lambda s, d: adjustments.scenario(view(s, d, "sales").where("gross_kr > 0").select(F.col("no").alias("id"), F.col("gross_kr").alias("amount_kr"), (F.col("no") % 2 == 0).alias("gain"))), over("sale", "WITH r AS (SELECT no AS id, gross_kr AS a, no % 2 = 0 AS gain, (gross_kr * 250000 + 500000) // 1000000 AS t FROM sale WHERE gross_kr > 0) " + " UNION ALL ".join(f"SELECT id, '{acc}' AS account, CAST({dd} AS BIGINT) AS debit_kr, CAST({cc} AS BIGINT) AS credit_kr FROM r WHERE {'gain' if g else 'NOT gain'}" for g, acc, dd, cc in [(1, "252", "a", "0"), (1, "522.90", "0", "a"), (1, "522.90", "t", "0"), (1, "484", "0", "t"), (0, "654.90", "a", "0"), (0, "252", "0", "a"), (0, "284", "t", "0"), (0, "691", "0", "t")]))),
    "loan_schedule": (lambda s, d: credit.schedule(_loans(s, d)), f"WITH RECURSIVE {_LOANS_SQL} SELECT id, CAST(i AS INTEGER) AS no, CAST(DATE '2026-01-31' + to_months(CAST(i AS INTEGER)) AS DATE) AS date, part + interest + CAST(round(interest * 500 / 10000.0::DOUBLE) AS BIGINT) AS payment_kr, part AS principal_kr, interest AS interest_kr, CAST(round(interest * 500 / 10000.0::DOUBLE) AS BIGINT) AS bsmv_kr, rest AS left_kr FROM plan WHERE i > 0"),
    "loan_entries": (
        lambda s, d: credit.entries(_loans(s, d)),
        f"WITH RECURSIVE {_LOANS_SQL}, acc AS (SELECT id, p, CASE WHEN n <= 12 THEN '300' ELSE '400' END AS loan FROM loans), e AS (SELECT id, 0 AS no, DATE '2026-01-31' AS date, '102' AS account, p AS debit_kr, 0 AS credit_kr FROM acc UNION ALL SELECT id, 0, DATE '2026-01-31', loan, 0, p FROM acc UNION ALL SELECT id, no, date, account, d, c FROM (SELECT id, i AS no, CAST(DATE '2026-01-31' + to_months(CAST(i AS INTEGER)) AS DATE) AS date, unnest([{{'account': loan, 'd': part, 'c': 0}}, {{'account': '780', 'd': interest, 'c': 0}}, {{'account': '780.01', 'd': tax, 'c': 0}}, {{'account': '102', 'd': 0, 'c': part + interest + tax}}], recursive := true) FROM (SELECT plan.id, i, part, interest, CAST(round(interest * 500 / 10000.0::DOUBLE) AS BIGINT) AS tax, loan FROM plan JOIN acc ON acc.id = plan.id WHERE i > 0))) SELECT id, CAST(no AS INTEGER) AS no, date, account, CAST(debit_kr AS BIGINT) AS debit_kr, CAST(credit_kr AS BIGINT) AS credit_kr FROM e WHERE debit_kr > 0 OR credit_kr > 0",
    ),
    "simplify_text": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(names.simplify("text")).alias("md5"), F.length(names.simplify("text")).alias("n")), "WITH x AS (SELECT doc_id, trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžğışß', 'aaaaaaceeeeiiiinooooouuuuyyszgiss'), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS md5, CAST(length(t) AS INTEGER) AS n FROM x"),
    "language_guess": (lambda s, d: documents.guess_language(table(s, d, "documents")), "WITH x AS (SELECT doc_id, string_split(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžğışß', 'aaaaaaceeeeiiiinooooouuuuyyszgiss'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS r, '{k}' AS language, CAST(len(list_filter(w, lambda v: list_contains({ws}, v))) AS INTEGER) AS score FROM x" for i, (k, ws) in enumerate(documents.FREQUENT.items())) + "), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r) AS k FROM s) SELECT doc_id, CASE WHEN score > 0 THEN language ELSE '' END AS language, score FROM b WHERE k = 1"),
    "parse_amounts": (_amounts, "WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS kr FROM orders) SELECT id, CASE WHEN id % 17 = 0 THEN 'okunamadı' ELSE replace(format('{:,}', kr // 100), ',', '.') || ',' || lpad(CAST(kr % 100 AS VARCHAR), 2, '0') END AS raw, CASE WHEN id % 17 <> 0 THEN kr END AS amount_kr FROM o"),
    "template_fingerprint": (lambda s, d: table(s, d, "documents").select("doc_id", documents.fingerprint("text").alias("fingerprint")), "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[1:60], lambda x: regexp_replace(lower(x), '[^a-z]+', '', 'g')), lambda x: x <> ''), '|')) AS fingerprint FROM documents"),
    "rule_confidence": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("trials"), F.count_if(F.col("event_type") == "purchase").alias("hits")).select("user_id", "trials", "hits", F.round(documents.wilson("hits", "trials"), 6).alias("confidence")), "WITH r AS (SELECT user_id, count(*) AS trials, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events GROUP BY user_id), p AS (SELECT *, hits::DOUBLE / trials AS p, trials::DOUBLE AS n, 1.96::DOUBLE AS z FROM r) SELECT user_id, trials, hits, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS confidence FROM p"),
    "equation_checks": (lambda s, d: documents.equations(_values(s, d), s.createDataFrame(_EQ, "equation string, field string, sign int")), over("sale", "WITH v AS (SELECT no, net_kr + vat_kr AS a, gross_kr + CASE WHEN no % 50 = 0 THEN 9 ELSE no % 3 END AS g, return_net_kr + return_vat_kr + discount_net_kr + discount_vat_kr AS b, CASE WHEN valid THEN CAST(net_debt_kr AS BIGINT) END AS o FROM sale) SELECT no AS doc_id, 'invoice' AS equation, CAST(a AS BIGINT) AS sum_kr, CAST(g AS BIGINT) AS target_kr, CASE WHEN abs(a - g) <= 3 THEN 'holds' ELSE 'fails' END AS status FROM v UNION ALL SELECT no, 'debt', CAST(g - b AS BIGINT), o, CASE WHEN o IS NULL THEN 'open' WHEN abs(g - b - o) <= 3 THEN 'holds' ELSE 'fails' END FROM v")),
    "words_to_number": (_all_numbers, "SELECT o_orderkey, o_orderkey AS number FROM orders"),
    "term_corrections": (registry_corrections, None),
    "term_distance": (lambda s, d: documents.corrected(_terms(s, d), LEXICON), None),
}
DATES = dict.fromkeys(("loan_schedule", "loan_entries"), ["date"])
