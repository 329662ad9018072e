"""Queries that read fields off printed invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import headings, readings
from tallyspark.operators.candidates import AMOUNT, DATE, TAX_ID, TEXT, Equation, Field
from tallyspark.sources.model import over, sale_amounts, table

FIELDS = [
    Field("matrah", AMOUNT, ("matrah", "mal hizmet toplam tutari", "net tutar")), Field("kdv", AMOUNT, ("kdv", "hesaplanan kdv")), Field("toplam", AMOUNT, ("toplam", "genel toplam", "odenecek tutar")),
    Field("tarih", DATE, ("fatura tarihi", "tarih")), Field("vkn", TAX_ID, ("vkn", "vergi no")), Field("unvan", TEXT, ("sayin",)),
]
EQUATIONS = [Equation("Matrah + KDV = Genel toplam", (("matrah", 1), ("kdv", 1)), "toplam")]


def _printed(s, d):
    """An invoice for each sale as a printed page, with traps by its number: two tax ids, two amounts in a cell, a wrong total, no tax, dots for commas, the total below."""
    k, c = F.col("no") % 7, F.col
    whole = lambda x: F.translate(F.format_number(F.call_function("div", x, F.lit(100)), 0), ",", ".")
    money = lambda x: F.concat(whole(x), F.when(k == 5, ".").otherwise(","), F.lpad((x % 100).cast("string"), 2, "0"))
    party = (F.lit(1_000_000_000) + c("party")).cast("string")
    total = money(c("gross_kr") + F.when(k == 3, 100).otherwise(0))
    lines = [
        F.concat(F.lit("Ataturk Bulvari No:12   VKN: "), party), F.when(k == 1, F.concat(F.lit("Vergi No 9"), party)).otherwise(""), F.lit("SAYIN"), F.concat(F.lit("Musteri "), c("party").cast("string"), F.lit("   Sira 1")),
        F.concat(F.lit("Fatura Tarihi   "), F.date_format("date", "dd.MM.yyyy")), F.concat(F.lit("Toplam Matrah: "), money(c("net_kr"))),
        F.when(k == 4, "").when(k == 2, F.concat(F.lit("KDV % 8   "), money(c("net_kr")), F.lit(" "), money(c("vat_kr")))).otherwise(F.concat(F.lit("KDV %8   "), money(c("vat_kr")))),
        F.when(k == 6, "Genel Toplam").otherwise(F.concat(F.lit("Genel Toplam   "), total)), F.when(k == 6, "").otherwise("Yalniz"), F.when(k == 6, total).otherwise("10,00"),
    ]
    return sale_amounts(s, d).where("gross_kr > 0").distinct().select(c("no").alias("doc_id"), F.array_join(F.array(*lines), "\n").alias("text"))


_LABELS_SQL = ", ".join(f"('{f.name}', '{f.kind}', '{x}')" for f in FIELDS for x in f.labels)
_MONEY = lambda x: f"replace(format('{{:,}}', {x} // 100), ',', '.') || CASE WHEN k = 5 THEN '.' ELSE ',' END || lpad(CAST({x} % 100 AS VARCHAR), 2, '0')"
_CANDIDATES = f"""pages AS (SELECT no AS doc_id, ['Ataturk Bulvari No:12   VKN: ' || tax, CASE WHEN k = 1 THEN 'Vergi No 9' || tax ELSE '' END, 'SAYIN', 'Musteri ' || CAST(party AS VARCHAR) || '   Sira 1', 'Fatura Tarihi   ' || strftime(date, '%d.%m.%Y'), 'Toplam Matrah: ' || {_MONEY('net_kr')},
  CASE WHEN k = 4 THEN '' WHEN k = 2 THEN 'KDV % 8   ' || {_MONEY('net_kr')} || ' ' || {_MONEY('vat_kr')} ELSE 'KDV %8   ' || {_MONEY('vat_kr')} END, CASE WHEN k = 6 THEN 'Genel Toplam' ELSE 'Genel Toplam   ' || total END, CASE WHEN k = 6 THEN '' ELSE 'Yalniz' END, CASE WHEN k = 6 THEN total ELSE '10,00' END] AS lines
  FROM (SELECT *, CAST(1000000000 + party AS VARCHAR) AS tax, {_MONEY('(gross_kr + CASE WHEN k = 3 THEN 100 ELSE 0 END)')} AS total FROM (SELECT *, no % 7 AS k FROM sale WHERE gross_kr > 0))),
grid AS (SELECT doc_id, line, list_filter(list_transform(string_split(lines[line + 1], '   '), lambda x: trim(x)), lambda x: x <> '') AS cells FROM pages, range(10) r(line)),
lab(field, kind, label) AS (VALUES {_LABELS_SQL}),
cell AS (SELECT doc_id, line, j, cells[j + 1] AS cell, cells[j + 2] AS beside, lower(regexp_replace(cells[j + 1], '[^A-Za-z0-9]+', ' ', 'g')) AS plain FROM grid, range(5) r(j) WHERE j < len(cells)),
hit AS (SELECT cell.*, field, kind, label FROM cell JOIN lab ON contains(plain, label) QUALIFY row_number() OVER (PARTITION BY doc_id, line, j, field ORDER BY length(label) DESC) = 1),
near AS (SELECT hit.*, coalesce(a.line, b.line) - hit.line AS step, coalesce(a.cells, b.cells) AS under FROM hit LEFT JOIN grid a ON a.doc_id = hit.doc_id AND a.line = hit.line + 1 AND len(a.cells) > 0 LEFT JOIN grid b ON b.doc_id = hit.doc_id AND b.line = hit.line + 2 AND len(b.cells) > 0 AND a.doc_id IS NULL),
text AS (SELECT doc_id, field, kind, line, j, label, 1 AS way, ltrim(substr(cell, strpos(lower(cell), string_split(label, ' ')[-1]) + length(string_split(label, ' ')[-1])), ': .-') AS x, 100 + length(label) AS base, 5 AS less FROM near
  UNION ALL SELECT doc_id, field, kind, line, j, label, 2, beside, 95 + length(label), 5 FROM near UNION ALL SELECT doc_id, field, kind, line, j, label, 3, coalesce(under[j + 1], under[1]), 95 - 10 * step + length(label), 0 FROM near),
toks AS (SELECT *, CASE kind WHEN 'TUTAR' THEN list_filter(list_transform(regexp_extract_all(regexp_replace(x, '% +', '%', 'g'), '%?[0-9][0-9.,]*%?'), lambda v: rtrim(v, '.,')), lambda v: NOT contains(v, '%')) WHEN 'TARIH' THEN list_filter(regexp_extract_all(x, '[0-9][0-9./-]*'), lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) = 8)
  WHEN 'VKN' THEN list_filter(regexp_extract_all(x, '[0-9]+'), lambda v: length(v) IN (10, 11)) ELSE list_filter([trim(x)], lambda v: v <> '') END AS t FROM text),
flat AS (SELECT doc_id, field, kind, line, j, way, n, t[n + 1] AS value, base - less * n AS score, row_number() OVER (PARTITION BY doc_id, field ORDER BY base - less * n DESC, line, j, way, n) AS g FROM toks, range(9) r(n) WHERE n < len(t)),
seen AS (SELECT *, lag(value) OVER w AS v, lag(line) OVER w AS l FROM flat WINDOW w AS (PARTITION BY doc_id, field ORDER BY g)),
cand AS (SELECT doc_id, field, kind, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY g) AS INTEGER) AS place, value, CASE way WHEN 1 THEN 'same cell' WHEN 2 THEN 'next cell' ELSE 'below' END AS strategy, CAST(line AS INTEGER) AS line, CAST(score AS INTEGER) AS score FROM seen WHERE v IS DISTINCT FROM value OR l IS DISTINCT FROM line)"""
#: All combinations, in the order of trial; amounts of these pages have two decimals.
_CHOSEN = """num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY place) AS i FROM (SELECT doc_id, field, place, value, CAST(regexp_replace(value, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN regexp_matches(value, '[.,][0-9]{2}$') THEN 1 ELSE 100 END AS number FROM cand WHERE place <= 6 AND kind = 'TUTAR')),
best AS (SELECT a.doc_id, [a.value, b.value, c.value] AS v FROM num a JOIN num b ON b.doc_id = a.doc_id AND b.field = 'kdv' JOIN num c ON c.doc_id = a.doc_id AND c.field = 'toplam' WHERE a.field = 'matrah' AND a.number + b.number = c.number AND c.number <> 0 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY c.i, b.i, a.i) = 1),
pick AS (SELECT doc_id, unnest(['matrah', 'kdv', 'toplam']) AS field, unnest(v) AS value FROM best)"""
_FILLED = """, one AS (SELECT cand.doc_id, cand.field, cand.kind, arg_min(cand.value, place) AS lead_value, count(DISTINCT CASE kind WHEN 'TUTAR' THEN CAST(CAST(regexp_replace(cand.value, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN regexp_matches(cand.value, '[.,][0-9]{2}$') THEN 1 ELSE 100 END AS VARCHAR) ELSE lower(cand.value) END) AS candidates FROM cand GROUP BY ALL),
put AS (SELECT one.*, coalesce(pick.value, lead_value) AS value FROM one LEFT JOIN pick ON pick.doc_id = one.doc_id AND pick.field = one.field),
val AS (SELECT *, CASE kind WHEN 'TUTAR' THEN CAST(regexp_replace(value, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN regexp_matches(value, '[.,][0-9]{2}$') THEN 1 ELSE 100 END WHEN 'TARIH' THEN CAST(strftime(strptime(value, '%d.%m.%Y'), '%Y%m%d') AS BIGINT) WHEN 'VKN' THEN CAST(value AS BIGINT) END AS number FROM put),
ok AS (SELECT doc_id, count(*) FILTER (field IN ('matrah', 'kdv', 'toplam')) = 3 AND abs(coalesce(sum(CASE field WHEN 'matrah' THEN number WHEN 'kdv' THEN number WHEN 'toplam' THEN -number END), 9)) <= 3 AS ok FROM val GROUP BY doc_id)
SELECT val.doc_id, field, CASE WHEN ok THEN value END AS value, CASE WHEN ok THEN number END AS number, candidates, ok AS filled, ok AND (field IN ('matrah', 'kdv', 'toplam') OR candidates = 1) AS approved FROM val JOIN ok ON ok.doc_id = val.doc_id"""


def _cells(s, d):
    """A page for each order with inflected headings in two languages, headings that say one thing twice, and lines with numbers."""
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    head = F.when(k == 0, "SIRA   CİNSİ   MİKTARLARI   BİRİM FİYATI   TUTARLARI").when(k == 1, "No   Description   Quantities   Unit Prices   Amounts").when(k == 2, "TUTAR   TUTARI   MİKTARI   BİRİMİ").otherwise("2026   MİKTAR   TUTAR")
    lines = F.array(F.lit("SAYIN   Musteri   Adres"), head, F.concat(F.lit("1   Pamuk   "), n, F.lit("   2,00")), F.lit("KDV Oranı   İskontosu   Toplam"))
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(lines).alias("line", "text"))
    return rows.select("doc_id", "line", F.posexplode(F.split("text", "   ")).alias("j", "text"))


_HEADINGS = [(0, 1, "SIRA:SIRA CİNSİ:MAL_ADI MİKTARLARI:MIKTAR BİRİM_FİYATI:BIRIM_FIYAT TUTARLARI:TUTAR"), (1, 1, "No:SIRA Description:MAL_ADI Quantities:MIKTAR Unit_Prices:BIRIM_FIYAT Amounts:TUTAR"), (2, 3, "KDV_Oranı:KDV_ORANI İskontosu:ISKONTO Toplam:TUTAR"), (3, 3, "KDV_Oranı:KDV_ORANI İskontosu:ISKONTO Toplam:TUTAR")]
_HEADINGS_SQL = ", ".join(f"({k}, {line}, {j}, '{x.split(':')[0].replace('_', ' ')}', '{x.split(':')[1]}')" for k, line, xs in _HEADINGS for j, x in enumerate(xs.split()))


def _parties(s, d):
    return table(s, d, "customer").select(_party_name(F.col("c_custkey") % 400).alias("name"))


def _party_name(k):
    """Names of four hundred parties; five pairs differ in letters that look alike."""
    code = F.when(k < 5, F.concat(F.lit("B"), k.cast("string"), F.lit("ROA"))).when(k < 10, F.concat(F.lit("B"), (k - 5).cast("string"), F.lit("R0A"))).otherwise(F.concat(F.lit("Ş"), F.translate(k.cast("string"), "0123456789", "KLMNPRTVYZ")))
    return F.concat(code, F.lit(" TİCARET VE SANAYİ A.Ş."))


def _names_read(s, d):
    """Each customer's name as it was read: as it is, without accents, with a letter that looks like another, cut at a word, or something else."""
    k = F.col("c_custkey")
    name = _party_name(k % 400)
    return table(s, d, "customer").select(k.alias("id"), F.when(k % 5 == 0, name).when(k % 5 == 1, F.translate(name, "Şİ", "Si")).when(k % 5 == 2, F.replace(name, F.lit("SAN"), F.lit("5AN"))).when(k % 5 == 3, F.regexp_replace(name, " A.*$", "")).otherwise(F.concat(F.lit("qqwwxx jj "), k.cast("string"))).alias("text"))


def _rules(s, d):
    """A third of all events concern one rule; how often a rule is right follows its number."""
    e = F.col("event_id")
    rule = F.when(e % 3 == 0, 0).otherwise(F.col("user_id") + 1)
    return table(s, d, "events").select(rule.alias("rule"), e.alias("seq"), ((e * 7919 % 101) < (rule * 37 % 90) + 5).alias("right"), F.concat(F.lit("made "), e.cast("string")).alias("made"))


def _rule_kinds(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("same cell", "next cell", "below"))), (F.col("rule") % 3 + 1).cast("int"))
    return _rules(s, d).select("rule").distinct().select("rule", kind.alias("strategy"), F.concat(F.lit("field "), (F.col("rule") % 4).cast("string")).alias("field"))


_RULES_SQL = """e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS rule, event_id AS seq FROM events), o AS (SELECT rule, seq, (seq * 7919 % 101) < (rule * 37 % 90) + 5 AS ok FROM e),
c AS (SELECT *, sum(ok::BIGINT) OVER w AS h, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY rule ORDER BY seq)),
b AS (SELECT *, (h::DOUBLE / n + 1.9208 / n - 1.96 * sqrt((h::DOUBLE / n) * (1 - h::DOUBLE / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS low FROM c),
g AS (SELECT rule, min(seq) AS gone FROM b WHERE NOT ok AND n >= 3 AND low < 0.2 GROUP BY rule),
u AS (SELECT b.*, gone FROM b LEFT JOIN g ON g.rule = b.rule WHERE gone IS NULL OR seq <= gone),
s AS (SELECT rule, CAST(arg_max(h, seq) AS BIGINT) AS hits, arg_max(n, seq) AS trials, round(arg_max(low, seq), 6) AS confidence, CASE WHEN max(gone) IS NULL THEN 'AKTIF' ELSE 'EMEKLI' END AS state, max(gone) AS retired_at, 'made ' || CAST(max(CASE WHEN NOT ok THEN seq END) AS VARCHAR) AS counterexample FROM u GROUP BY rule)"""


QUERIES = {
    "column_names": (lambda s, d: headings.column_names(_cells(s, d)), f"WITH h(k, line, j, raw, meaning) AS (VALUES {_HEADINGS_SQL}) SELECT o_orderkey AS doc_id, CAST(line AS INTEGER) AS line, CAST(j AS INTEGER) AS j, raw, meaning FROM orders JOIN h ON h.k = o_orderkey % 4"),
    "party_match": (lambda s, d: headings.party_match(_names_read(s, d), _parties(s, d)), None),
    "rule_states": (lambda s, d: headings.rule_states(_rules(s, d)), f"WITH {_RULES_SQL} SELECT * FROM s"),
    "dirty_rules": (lambda s, d: headings.dirty_rules(headings.rule_states(_rules(s, d)), _rule_kinds(s, d)), f"WITH {_RULES_SQL} SELECT list_extract(['same cell', 'next cell', 'below'], CAST(rule % 3 + 1 AS INTEGER)) AS strategy, 'field ' || CAST(rule % 4 AS VARCHAR) AS field, count(*) FILTER (state = 'EMEKLI') AS retired, count(*) FILTER (state = 'AKTIF') AS active, round(100.0::DOUBLE * count(*) FILTER (state = 'EMEKLI') / count(*), 1) AS decay, round(avg(confidence), 6) AS mean_confidence FROM s GROUP BY 1, 2"),
    "field_candidates": (lambda s, d: readings.field_candidates(_printed(s, d), FIELDS), over("sale", f"WITH {_CANDIDATES} SELECT * FROM cand")),
    "candidate_selection": (lambda s, d: readings.chosen(_printed(s, d), FIELDS, EQUATIONS, ","), over("sale", f"WITH {_CANDIDATES}, {_CHOSEN} SELECT * FROM pick")),
    "auto_fill": (lambda s, d: readings.filled(_printed(s, d), FIELDS, EQUATIONS, ","), over("sale", f"WITH {_CANDIDATES}, {_CHOSEN} {_FILLED}")),
}
DATES: dict[str, list[str]] = {}
