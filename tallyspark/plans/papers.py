"""Queries over instalments, provenance and documents as they were read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import documents, layout, ledger, sheets, tracing
from tallyspark.plans.money_flows import _ALL, _all
from tallyspark.sources.model import over, table, view

_j = lambda s, d: view(s, d, "journal")
_s = lambda s, d: view(s, d, "sales")
_r = lambda s, d: view(s, d, "receipts")
AS_OF = "1998-01-01"


def _items(s, d):
    """Three instalments for each valid invoice, at 30, 60 and 90 days, in coarse amounts, so that many are alike."""
    part = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("part")
    df = _s(s, d).where("net_debt_kr > 0").select("no", part, F.lit("GIRIS").alias("direction"), (F.call_function("div", F.col("net_debt_kr"), F.lit(15_000_000)) + 1).alias("amount_kr"), (F.col("party") % 40).cast("string").alias("name"), "date")
    return df.withColumn("due", F.date_add("date", F.col("part") * 30))


def _movements(s, d):
    """Two in three instalments are paid, some of them early."""
    i = _items(s, d).where("(no + part) % 3 <> 0")
    return i.select((F.col("no") * 4 + F.col("part")).alias("ref"), "direction", "amount_kr", "name", F.date_add("date", (F.col("part") * 30 + F.col("no") % 45 - 40).cast("int")).alias("date"))


_ITEMS_SQL = "i AS (SELECT no, CAST(part AS BIGINT) AS part, net_debt_kr // 15000000 + 1 AS amount_kr, CAST(party % 40 AS VARCHAR) AS name, date, date + CAST(part * 30 AS INTEGER) AS due FROM sale, (SELECT unnest([1, 2, 3]) AS part) WHERE net_debt_kr > 0), m AS (SELECT no * 4 + part AS ref, amount_kr, name, date + CAST(part * 30 + no % 45 - 40 AS INTEGER) AS date FROM i WHERE (no + part) % 3 <> 0)"
_MATCH_SQL = (
    f"WITH {_ITEMS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY amount_kr, name ORDER BY date, ref) AS place FROM m), f AS (SELECT i.*, row_number() OVER (PARTITION BY amount_kr, name ORDER BY date, no, part) AS k, 1 + (SELECT count(*) FROM m WHERE m.amount_kr = i.amount_kr AND m.name = i.name AND m.date < i.date) AS f FROM i),"
    " p AS (SELECT *, k + max(f - k) OVER (PARTITION BY amount_kr, name ORDER BY date, no, part) AS place FROM f), x AS (SELECT p.no, CAST(p.part AS BIGINT) AS part, p.amount_kr, CASE WHEN ref IS NOT NULL THEN 'TAHSIL' WHEN due < DATE '1998-01-01' THEN 'GECIKMIS' ELSE 'BEKLIYOR' END AS status, ref, r.date AS paid_on FROM p LEFT JOIN ranked r ON r.amount_kr = p.amount_kr AND r.name = p.name AND r.place = p.place)"
)


def _matched(s, d):
    return tracing.instalments(_items(s, d), _movements(s, d), AS_OF)


def _vouchers(s, d):
    kinds = _j(s, d).groupBy("voucher").agg(F.min("kind").alias("kind"), F.min("doc_no").alias("doc_no"))
    return ledger.voucher_totals(_j(s, d)).join(kinds, "voucher").where("kind in ('accrual', 'return', 'cost', 'discount', 'void', 'receipt')").select("voucher", "kind", "doc_no", F.col("debit_kr").alias("amount_kr"))


_EDGES_SQL = (
    ", v AS (SELECT voucher, min(kind) AS kind, min(doc_no) AS doc_no, CAST(sum(debit_kr) AS BIGINT) AS amount_kr FROM journal GROUP BY voucher) SELECT 'invoice:' || CAST(doc_no AS VARCHAR) AS source, 'voucher:' || CAST(voucher AS VARCHAR) AS target, kind, amount_kr FROM v JOIN sale ON sale.no = doc_no WHERE kind IN ('accrual', 'return', 'cost', 'discount', 'void')"
    " UNION ALL SELECT 'receipt:' || CAST(id AS VARCHAR), 'invoice:' || CAST(no AS VARCHAR), 'allocation', amount_kr FROM alloc UNION ALL SELECT 'receipt:' || CAST(doc_no AS VARCHAR), 'voucher:' || CAST(voucher AS VARCHAR), 'receipt', amount_kr FROM v WHERE kind = 'receipt' UNION ALL SELECT 'bank:' || bank, 'receipt:' || CAST(id AS VARCHAR), 'bank', open_kr FROM rec"
)


def _read(s, d):
    """Invoices as they would be read from paper, with planted faults by number."""
    k, c = F.col("no") % 29, F.col
    return _s(s, d).where("gross_kr > 0").select(
        c("no").alias("doc_id"), F.when(k == 1, "").when(k == 14, "ru").otherwise("tr").alias("language"), F.when(k == 2, "").otherwise("fatura").alias("kind"), F.when(k != 3, c("date")).alias("date"), F.when(k != 4, c("party").cast("string")).alias("party"),
        F.when(k != 5, c("net_kr")).alias("net_kr"), F.when(k == 6, c("vat_kr") + 7).otherwise(c("vat_kr")).alias("vat_kr"), F.when(k.isin(7, 8), F.lit(10)).alias("rate"), F.when(k != 9, c("gross_kr")).alias("total_kr"),
        F.when(k == 10, c("gross_kr") + 100).when(k < 20, c("gross_kr") - c("gross_kr") % 100).alias("words_kr"), F.when(k == 11, c("net_kr") - 1).otherwise(c("net_kr")).alias("items_kr"), F.lit(3).alias("n_items"), F.when(k == 12, 2).when(k == 13, 0).otherwise(3).alias("n_read"), F.lit(True).alias("needs_party"),
        F.when(k == 15, F.array(*map(F.lit, ("TAM", "ONERI", "BELIRSIZ", "ONERI")))).when(k == 16, F.array(F.lit("TAM"))).alias("label_states"),
    )


_READ_SQL = """d AS (SELECT no AS doc_id, k <> 1 AS lang, k <> 2 AS kind, CASE WHEN k <> 3 THEN date END AS date, k <> 4 AS party, CASE WHEN k <> 5 THEN net_kr END AS net, CASE WHEN k = 6 THEN vat_kr + 7 ELSE vat_kr END AS vat, CASE WHEN k IN (7, 8) THEN 10 END AS rate, CASE WHEN k <> 9 THEN gross_kr END AS total,
 CASE WHEN k = 10 THEN gross_kr + 100 WHEN k < 20 THEN gross_kr - gross_kr % 100 END AS words, CASE WHEN k = 11 THEN net_kr - 1 ELSE net_kr END AS items, CASE WHEN k = 12 THEN 2 WHEN k = 13 THEN 0 ELSE 3 END AS n_read, k FROM (SELECT *, no % 29 AS k FROM sale WHERE gross_kr > 0)),
t AS (SELECT *, coalesce(words = total OR words = total - total % 100, false) AS said, coalesce(NOT (words = total OR words = total - total % 100), false) AS unsaid, coalesce(n_read > 0 AND items = CASE WHEN net IS NOT NULL AND vat IS NOT NULL THEN net ELSE total END AND total IS NOT NULL, false) AS summed,
 coalesce(n_read > 0 AND total IS NOT NULL AND items <> CASE WHEN net IS NOT NULL AND vat IS NOT NULL THEN net ELSE total END, false) AS unsummed, coalesce(net + vat <> total, false) AS off, coalesce(net + vat = total, false) AS even, coalesce(rate > 0 AND net > 0 AND total IS NOT NULL AND abs(net * rate // 100 - vat) > 100, false) AS rated, date IS NULL OR total IS NULL OR (NOT party AND kind) AS lacks FROM d),
c AS (SELECT doc_id, list_filter([CASE WHEN NOT lang THEN 'B01' END, CASE WHEN k = 14 THEN 'B09' END, CASE WHEN NOT kind THEN 'B02' END, CASE WHEN n_read < 3 THEN 'B08' END, CASE WHEN said THEN 'B00' END, CASE WHEN unsaid THEN 'B03' END, CASE WHEN summed THEN 'B00' END, CASE WHEN unsummed THEN 'B04' END, CASE WHEN off THEN 'B05' END, CASE WHEN rated THEN 'B06' END, CASE WHEN lacks THEN 'B07' END, CASE WHEN k = 15 THEN 'B10' END, CASE WHEN k = 15 THEN 'B11' END, CASE WHEN k = 15 THEN 'B10' END], lambda x: x IS NOT NULL) AS codes,
 greatest(least(10 * lang::INT + 10 * kind::INT + CASE WHEN total IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 10 ELSE 0 END + 10 * party::INT + 25 * said::INT + 20 * summed::INT + 15 * even::INT - 40 * (NOT lang)::INT - 10 * (NOT kind)::INT - 10 * (n_read < 3)::INT - 40 * unsaid::INT - 10 * unsummed::INT - 10 * off::INT - 10 * rated::INT - 40 * lacks::INT - CASE WHEN k = 15 THEN 30 ELSE 0 END, 100), 0) AS score FROM t)
SELECT doc_id, array_to_string(codes, ',') AS findings, CAST(score AS INTEGER) AS confidence, NOT list_has_any(codes, ['B01', 'B03', 'B07']) AND score >= 60 AS ready FROM c"""


def _printed(s, d):
    """A printed line for each order line: name, position, quantity, price, amount."""
    money = lambda x: F.concat(F.call_function("div", x, F.lit(100)).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))
    price, qty = F.col("l_partkey") % 900 + 101, F.col("l_quantity").cast("bigint")
    amount = price * qty + F.when(F.col("l_orderkey") % 13 == 0, 5).otherwise(0)
    text = F.concat_ws(" ", F.lit("Mal"), F.lit("adet"), qty.cast("string"), money(price), money(amount))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("line"), text.alias("text"))


def _lines(s, d):
    found = documents.line_items(_printed(s, d))
    return found.select("doc_id", "line", "name", F.round("qty", 2).alias("qty"), F.round("price", 2).alias("price"), F.round("amount", 2).alias("amount"))


_LINES_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, 'Mal adet' AS name, CAST(l_quantity AS DOUBLE) AS qty, (l_partkey % 900 + 101) / 100.0::DOUBLE AS price, ((l_partkey % 900 + 101) * CAST(l_quantity AS BIGINT)) / 100.0::DOUBLE AS amount FROM lineitem WHERE l_orderkey % 13 <> 0"


def _sheets(s, d):
    """A row for each order and each of its line numbers (the least of what lines with one number say), by document: what `_WORDS` is made of."""
    c, none = F.col, lambda kind: F.lit(None).cast(kind)
    heads = table(s, d, "orders").select(c("o_orderkey").alias("doc_id"), F.lit(True).alias("head"), none("long").alias("n"), c("o_custkey").alias("party"), c("o_orderdate").alias("date"), none("long").alias("part"), none("long").alias("supplier"), none("double").alias("quantity"))
    items = table(s, d, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit(False).alias("head"), c("l_linenumber").cast("long").alias("n"), none("long").alias("party"), none("timestamp").cast(heads.schema["date"].dataType).alias("date"), c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("l_quantity").alias("quantity"))
    least = [F.min(x).alias(x) for x in ("part", "supplier", "quantity")]
    return heads.unionByName(items).where("doc_id is not null").repartition("doc_id").groupBy("doc_id", "head", "n", "party", "date").agg(*least, F.count("*").cast("int").alias("copies"))


def _printed_words():
    """A printed invoice for each order: a head of two columns, a table whose words drift up and down, and a total, on the next page for every fourth."""
    c = F.col
    n, o, part, text = c("n"), c("doc_id"), c("part"), lambda x: x.cast("string")
    word = lambda k, said, x0, y0, wide, high=10, page=1: F.struct(F.lit(page).alias("page"), (F.lit(k) if isinstance(k, int) else k).cast("long").alias("k"), said.alias("text"), F.lit(x0).cast("double").alias("x0"), (F.lit(y0) if isinstance(y0, int) else y0).cast("double").alias("y0"), F.lit(x0 + wide).cast("double").alias("x1"), ((F.lit(y0) if isinstance(y0, int) else y0) + high).cast("double").alias("y1"))
    head = [
        word(0, F.lit("FATURA"), 60, 20, 80, 18), word(1, F.lit("Fatura"), 60, 60, 35), word(2, F.lit("No:"), 96, 60, 18), word(3, text(o), 400, 60 + o % 8, 60), word(4, F.lit("Sayin"), 60, 90, 32), word(5, F.lit("Tarih"), 330, 90, 30),
        word(6, F.lit("Musteri"), 60, 106, 40), word(7, text(c("party")), 104, 106 + o % 3, 36), word(8, F.date_format("date", "dd.MM.yyyy"), 330, 106, 50), word(9, F.lit("Toplam"), 360, 312, 40),
    ]
    last = F.when(o % 4 == 0, word(0, text(o * 3), 370, 20, 50, page=2)).otherwise(word(10, text(o * 3), 470, 312 + o % 8, 50))
    y = lambda x: 160 + n * 14 + x
    row = [word(100 + n * 4, F.lit("Kalem"), 45, y(0), 35), word(101 + n * 4, text(part), 165, y(part % 5), 35), word(102 + n * 4, text(c("quantity").cast("long")), 240, y(n % 3 * 2), 20), word(103 + n * 4, text(c("supplier")), 330, y(part % 5 + n % 3 * 2), 30)]
    heads = F.array(*head, last)
    return F.when(c("head") & (c("copies") > 1), F.flatten(F.array_repeat(heads, c("copies")))).when(c("head"), heads).otherwise(F.array(*row))


_NAMES = ["fatura no", "sayin", "tarih", "toplam"]


#: Lines by recursion over the words of a page in order.
_LAYOUT_SQL = """WITH RECURSIVE li AS (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, CAST(min(l_partkey) AS BIGINT) AS p, CAST(min(l_suppkey) AS BIGINT) AS s, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
w AS (SELECT doc_id, page, k, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + wide AS DOUBLE) AS x1, CAST(y0 + high AS DOUBLE) AS y1 FROM (
  SELECT o_orderkey AS doc_id, unnest([{'page': 1, 'k': 0, 'text': 'FATURA', 'x0': 60, 'y0': 20, 'wide': 80, 'high': 18}, {'page': 1, 'k': 1, 'text': 'Fatura', 'x0': 60, 'y0': 60, 'wide': 35, 'high': 10}, {'page': 1, 'k': 2, 'text': 'No:', 'x0': 96, 'y0': 60, 'wide': 18, 'high': 10},
    {'page': 1, 'k': 3, 'text': CAST(o_orderkey AS VARCHAR), 'x0': 400, 'y0': 60 + o_orderkey % 8, 'wide': 60, 'high': 10}, {'page': 1, 'k': 4, 'text': 'Sayin', 'x0': 60, 'y0': 90, 'wide': 32, 'high': 10}, {'page': 1, 'k': 5, 'text': 'Tarih', 'x0': 330, 'y0': 90, 'wide': 30, 'high': 10},
    {'page': 1, 'k': 6, 'text': 'Musteri', 'x0': 60, 'y0': 106, 'wide': 40, 'high': 10}, {'page': 1, 'k': 7, 'text': CAST(o_custkey AS VARCHAR), 'x0': 104, 'y0': 106 + o_orderkey % 3, 'wide': 36, 'high': 10}, {'page': 1, 'k': 8, 'text': strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y'), 'x0': 330, 'y0': 106, 'wide': 50, 'high': 10},
    {'page': 1, 'k': 9, 'text': 'Toplam', 'x0': 360, 'y0': 312, 'wide': 40, 'high': 10}, CASE WHEN o_orderkey % 4 = 0 THEN {'page': 2, 'k': 0, 'text': CAST(o_orderkey * 3 AS VARCHAR), 'x0': 370, 'y0': 20, 'wide': 50, 'high': 10} ELSE {'page': 1, 'k': 10, 'text': CAST(o_orderkey * 3 AS VARCHAR), 'x0': 470, 'y0': 312 + o_orderkey % 8, 'wide': 50, 'high': 10} END], recursive := true) FROM orders
  UNION ALL SELECT o, unnest([{'page': 1, 'k': 100 + n * 4, 'text': 'Kalem', 'x0': 45, 'y0': 160 + n * 14, 'wide': 35, 'high': 10}, {'page': 1, 'k': 101 + n * 4, 'text': CAST(p AS VARCHAR), 'x0': 165, 'y0': 160 + n * 14 + p % 5, 'wide': 35, 'high': 10}, {'page': 1, 'k': 102 + n * 4, 'text': CAST(q AS VARCHAR), 'x0': 240, 'y0': 160 + n * 14 + n % 3 * 2, 'wide': 20, 'high': 10},
    {'page': 1, 'k': 103 + n * 4, 'text': CAST(s AS VARCHAR), 'x0': 330, 'y0': 160 + n * 14 + p % 5 + n % 3 * 2, 'wide': 30, 'high': 10}], recursive := true) FROM li)),
s AS (SELECT doc_id, page, text, x0, x1, (y0 + y1) / 2 AS mid, y1 - y0 AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY CAST(trunc((y0 + y1) / 2) AS BIGINT), CAST(trunc(x0) AS BIGINT), k) AS i FROM w),
f AS (SELECT doc_id, page, i, CAST(1 AS BIGINT) AS line, mid AS total, 1 AS n FROM s WHERE i = 1 UNION ALL SELECT doc_id, page, i, CASE WHEN far THEN line + 1 ELSE line END, CASE WHEN far THEN mid ELSE total + mid END, CASE WHEN far THEN 1 ELSE n + 1 END FROM (SELECT s.doc_id, s.page, s.i, s.mid, line, total, n, abs(total / n - s.mid) > greatest(0.6::DOUBLE * s.h, 2) AS far FROM f JOIN s ON s.doc_id = f.doc_id AND s.page = f.page AND s.i = f.i + 1)),
t AS (SELECT s.*, line, lag(x1) OVER (PARTITION BY s.doc_id, s.page, line ORDER BY x0, s.i) AS before FROM s JOIN f ON f.doc_id = s.doc_id AND f.page = s.page AND f.i = s.i),
z AS (SELECT doc_id, page, line, avg(mid) AS y, string_agg(CASE WHEN x0 - before > 0.9::DOUBLE * h THEN '   ' WHEN x0 - before > 0.5 THEN ' ' ELSE '' END || text, '' ORDER BY x0, i) AS text FROM t GROUP BY ALL)"""
_GRID_SQL = (
    _LAYOUT_SQL
    + """, g AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY line)) AS gap FROM z), m AS (SELECT doc_id, page, list_sort(list(gap) FILTER (gap > 0)) AS gs FROM g GROUP BY ALL),
b AS (SELECT g.doc_id, g.page, line, CAST(sum(CASE WHEN gap > 1.8::DOUBLE * gs[len(gs) // 2 + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id, g.page ORDER BY line) AS BIGINT) AS band FROM g JOIN m ON m.doc_id = g.doc_id AND m.page = g.page),
v AS (SELECT t.*, band FROM t JOIN b ON b.doc_id = t.doc_id AND b.page = t.page AND b.line = t.line), hs AS (SELECT doc_id, page, band, list_sort(list(h)) AS hs FROM v GROUP BY ALL),
r AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, band ORDER BY x0, x1, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v),
k AS (SELECT r.doc_id, r.page, r.band, list((reached + x0) / 2) AS cs FROM r JOIN hs ON hs.doc_id = r.doc_id AND hs.page = r.page AND hs.band = r.band WHERE len(hs) >= 4 AND x0 - reached >= 1.2::DOUBLE * greatest(hs[len(hs) // 2 + 1], 1) GROUP BY ALL),
c AS (SELECT v.*, sum(CASE WHEN len(list_filter(cs, lambda u: u > before AND u < x0)) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY v.doc_id, v.page, line ORDER BY x0, i) AS cell FROM v LEFT JOIN k ON k.doc_id = v.doc_id AND k.page = v.page AND k.band = v.band)
SELECT doc_id, page, line, band, CAST(cell AS INTEGER) AS cell, string_agg(text, ' ' ORDER BY x0, i) AS text FROM c GROUP BY ALL"""
)
_LABELS_SQL = (
    _LAYOUT_SQL
    + f""", lab(label) AS (VALUES {', '.join(f"('{x}')" for x in _NAMES)}), plain AS (SELECT t.*, trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS p FROM t),
hit AS (SELECT z.doc_id, z.page, z.line, y, label FROM z JOIN lab ON contains(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), label)),
e AS (SELECT hit.*, p.x0 AS ex0, p.x1 AS ex1, p.h AS eh FROM hit JOIN plain p ON p.doc_id = hit.doc_id AND p.page = hit.page AND p.line = hit.line WHERE contains(label, p.p) QUALIFY row_number() OVER (PARTITION BY hit.doc_id, hit.page, hit.line, label ORDER BY p.x0 DESC, p.i DESC) = 1),
seq AS (SELECT doc_id, page, line, y, lead(page) OVER o AS np, lead(line) OVER o AS nl, lead(y) OVER o AS ny FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY page, line)),
rt AS (SELECT e.doc_id, label, e.page, e.line, string_agg(t.text, ' ' ORDER BY x0, i) AS value, min(x0 - ex1) AS distance FROM e JOIN t ON t.doc_id = e.doc_id AND t.page = e.page AND t.line = e.line WHERE x0 > ex1 + 1 AND h <= 2 * eh GROUP BY ALL),
un AS (SELECT e.doc_id, label, e.page, e.line, string_agg(t.text, ' ' ORDER BY x0, i) AS value, min(abs(ny - e.y)) AS distance FROM e JOIN seq ON seq.doc_id = e.doc_id AND seq.page = e.page AND seq.line = e.line JOIN t ON t.doc_id = e.doc_id AND t.page = np AND t.line = nl WHERE t.x1 > ex0 - 2 * eh AND t.x0 < ex1 + 12 * eh AND h <= 2 * eh GROUP BY ALL)
SELECT doc_id, label, CAST(row_number() OVER (PARTITION BY doc_id, label ORDER BY distance, page, line, w) AS INTEGER) AS place, value, relation, distance FROM (SELECT *, 'SAGINDA' AS relation, 1 AS w FROM rt UNION ALL SELECT *, 'ALTINDA', 2 FROM un)"""
)


def _below(language: str) -> list[str]:
    """How a language says 0 to 999."""
    w = documents.NUMBER_WORDS[language]
    ones, tens, hundred = w["ones"].split(), ["", "", *w["tens"].split()], list(w["hundreds"])

    def two(n: int) -> str:
        if n < len(ones):
            return ones[n]
        if language == "fr" and n >= 60:
            rest = n - (60 if n < 80 else 80)
            return ("soixante" if n < 80 else "quatre-vingt") + (f" {two(rest)}" if rest else "")
        if n < 20:
            return f"{ones[10]} {ones[n - 10]}"
        one = ones[n % 10] if n % 10 else ""
        return f"{'ein' if n % 10 == 1 else one}und{tens[n // 10]}" if language == "de" and one else f"{tens[n // 10]} {one}".strip()

    def three(n: int) -> str:
        h = n // 100
        front = "" if not h else hundred[h - 1] if language == "ru" else hundred[0] if h == 1 and language in ("tr", "fr") else f"{'ein' if language == 'de' and h == 1 else ones[h]} {hundred[0]}"
        return f"{front} {two(n % 100) if n % 100 or not h else ''}".strip()

    return [three(n) for n in range(1000)]


def _spelled(s, d):
    """Orders' keys in words of five languages, read back."""
    out = None
    for language, w in documents.NUMBER_WORDS.items():
        said = F.array(*map(F.lit, _below(language)))
        thousand, million = (next(k for k, v in w["scales"].items() if v == size) for size in (10**3, 10**6))
        n = F.col("o_orderkey")
        part = lambda k: (F.call_function("div", n, F.lit(k)) % 1000).cast("int")
        block = lambda k, word: F.when(part(k) > 0, F.concat_ws(" ", F.get(said, part(k)), F.lit(word)))
        text = F.concat_ws(" ", block(10**6, million), block(10**3, thousand), F.when((part(1) > 0) | (n == 0), F.get(said, part(1))))
        one = documents.spelled(table(s, d, "orders").select("o_orderkey", text.alias("text")), language).select("o_orderkey", F.lit(language).alias("language"), "number")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "words_to_number_languages": (_spelled, "SELECT o_orderkey, language, o_orderkey AS number FROM orders, (SELECT unnest(['tr', 'en', 'de', 'fr', 'ru']) AS language)"),
    "instalment_match": (_matched, over("sale", _MATCH_SQL + " SELECT * FROM x")),
    "instalment_leftovers": (lambda s, d: tracing.unmatched(_movements(s, d), _matched(s, d)).select("ref", "amount_kr", "name", "date"), over("sale", _MATCH_SQL + " SELECT ref, amount_kr, name, date FROM m WHERE ref NOT IN (SELECT ref FROM x WHERE ref IS NOT NULL)")),
    "provenance_edges": (lambda s, d: tracing.provenance(_s(s, d), _r(s, d), _all(s, d), _vouchers(s, d)), over("receipt journal", _ALL + _EDGES_SQL)),
    "provenance_confidence": (lambda s, d: tracing.provenance_confidence(_s(s, d), _all(s, d)), over("receipt", _ALL + " SELECT no, CAST(net_debt_kr AS BIGINT) AS net_debt_kr, CAST(paid AS BIGINT) AS paid_kr, CASE WHEN paid >= net_debt_kr THEN 'TAM' WHEN paid > 0 THEN 'KISMI' ELSE 'ESLESMEYEN' END AS level, CASE WHEN paid >= net_debt_kr THEN 100 WHEN paid > 0 THEN 60 ELSE 30 END AS confidence FROM (SELECT sale.no, net_debt_kr, coalesce(p, 0) AS paid FROM sale LEFT JOIN (SELECT no, sum(amount_kr) AS p FROM alloc GROUP BY no) a ON a.no = sale.no)")),
    "document_checks": (lambda s, d: documents.resolve(_read(s, d)), over("sale", f"WITH {_READ_SQL}")),
    "line_items": (_lines, _LINES_SQL),
    "layout_lines": (lambda s, d: sheets.lines(_sheets(s, d), _printed_words()), _LAYOUT_SQL + " SELECT * FROM z"),
    "layout_grid": (lambda s, d: sheets.grid(_sheets(s, d), _printed_words()), _GRID_SQL),
    "label_values": (lambda s, d: sheets.label_values(_sheets(s, d), _printed_words(), _NAMES), _LABELS_SQL),
}
DATES = {"instalment_match": ["paid_on"], "instalment_leftovers": ["date"]}
