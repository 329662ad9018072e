"""Queries over voucher templates and expense accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import div, kurus
from tallyspark.operators import expenses, templates
from tallyspark.plans.books import CHART_SQL
from tallyspark.sources.model import chart, over, table, view

#: Templates that come with the model: (name, side, code).
BUILT_IN = [
    ("Satis", "B", "120"), ("Satis", "A", "600"), ("Satis", "A", "391"), ("Alis", "B", "153"), ("Alis", "B", "191"), ("Alis", "A", "320"), ("Tahsilat", "B", "102"), ("Tahsilat", "A", "120"),
    ("Iade", "B", "610"), ("Iade", "B", "191"), ("Iade", "A", "120"), ("Maliyet", "B", "621"), ("Maliyet", "A", "153"),
]
CODES = ["102", "120", "600", "391", "999", "153", "320", "191"]
#: Kinds of expense: 7A, 7B, sectors, percent that is not deductible.
KINDS = [
    ("AIR", "760", "793,796", ["*"], None), ("REG AIR", "760/770 ", "793", ["TIC"], None), ("RAIL", "-", "790,794", ["*"], None), ("SHIP", "770", "-", ["*"], 30), ("TRUCK", "740", "791", ["TIC", "URT"], 100),
    ("MAIL", "", "792 , 795", ["URT"], None), ("FOB", "780", "797", ["*"], None),
]
#: What each option makes of them in sector TIC, for the check.
_ACCOUNTS = {"AIR": ("760", "793", "631"), "REG AIR": ("760/770", "793", "631"), "RAIL": ("790", "790", "790"), "SHIP": ("770", "770", "632"), "TRUCK": ("740", "791", "622"), "FOB": ("780", "797", "660")}


def _saves(s, d):
    """Each customer saves a template of up to three lines."""
    k = F.col("c_custkey")
    name = F.when(k % 23 == 0, "  ").when(k % 23 == 1, "x" * 61).when(k % 23 == 2, " Satis ").otherwise(F.concat(F.lit(" Ornek "), (k % 40).cast("string")))
    lines = table(s, d, "customer").select(k.alias("save"), name.alias("name"), F.explode_outer(F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int")))).alias("line_no"))
    side = F.when(F.col("line_no").isNotNull(), F.when((div("save", 7) + F.col("line_no")) % 2 == 0, "B").otherwise("A"))
    code = F.element_at(F.array(*map(F.lit, CODES)), ((div("save", 4) + 3 * F.col("line_no")) % len(CODES) + 1).cast("int"))
    return lines.select("save", "name", "line_no", side.alias("side"), code.alias("code"))


def _built_in(s):
    return s.createDataFrame([(n, i, side, code) for i, (n, side, code) in enumerate(BUILT_IN)], "name string, line_no int, side string, code string")


def _findings(s, d):
    return templates.template_findings(_saves(s, d), chart(s), _built_in(s))


def _list(s, d):
    return templates.template_list(_built_in(s), templates.current(_saves(s, d), _findings(s, d)), view(s, d, "journal"))


_SAVES_SQL = f"""built(name, side, code) AS (VALUES {", ".join(map(str, BUILT_IN))}), {CHART_SQL}, saves AS (SELECT c_custkey AS save, trim(CASE c_custkey % 23 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 61) WHEN 2 THEN 'Satis' ELSE 'Ornek ' || CAST(c_custkey % 40 AS VARCHAR) END) AS name, k,
 CASE WHEN (c_custkey // 7 + k) % 2 = 0 THEN 'B' WHEN k IS NOT NULL THEN 'A' END AS side, list_extract({CODES}, CAST((c_custkey // 4 + 3 * k) % 8 + 1 AS INTEGER)) AS code FROM customer LEFT JOIN range(1, 4) t(k) ON k <= c_custkey % 4),
judged AS (SELECT save, name, count(k) AS n, CASE WHEN name = '' OR length(name) > 60 THEN 'T01' WHEN count(k) < 2 THEN 'T02' WHEN count(DISTINCT side) < 2 THEN 'T03' WHEN count_if(code NOT IN (SELECT code FROM chart)) > 0 THEN 'T04' WHEN name IN (SELECT name FROM built) THEN 'T05' END AS code FROM saves GROUP BY save, name)"""
_LIST_SQL = f"""WITH {_SAVES_SQL}, held AS (SELECT name, max(save) AS save FROM judged WHERE code IS NULL GROUP BY name), every AS (SELECT name, false AS own, side, code FROM built UNION ALL SELECT s.name, true, side, code FROM saves s JOIN held h ON h.save = s.save),
shape AS (SELECT name, bool_or(own) AS own, count(*) AS n, array_to_string(list_sort(list(DISTINCT side || code)), ',') AS s FROM every GROUP BY name),
used AS (SELECT s, count(*) AS usage FROM (SELECT voucher, array_to_string(list_sort(list(DISTINCT CASE WHEN debit_kr > 0 THEN 'B' ELSE 'A' END || split_part(account, '.', 1))), ',') AS s FROM journal GROUP BY voucher) GROUP BY s)
SELECT name, own AS "user", n, coalesce(usage, 0) AS usage FROM shape LEFT JOIN used ON used.s = shape.s"""


def _booked(s, d):
    """Expenses of a hundredth of a line's price, of a kind by line and supplier, by each way of keeping costs."""
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), ((F.col("l_linenumber") + F.col("l_suppkey")) % len(KINDS) + 1).cast("int"))
    spent = table(s, d, "lineitem").select(kind.alias("kind"), div(kurus("l_extendedprice"), 100).alias("amount_kr"))
    kinds = s.createDataFrame(KINDS, "kind string, a string, b string, sectors array<string>, refused_percent int")
    each = [expenses.booked_expenses(spent, expenses.expense_catalogue(kinds, "TIC", o)).withColumn("option", F.lit(o)) for o in expenses.OPTIONS]
    return reduce(DataFrame.unionByName, each)


_MADE = ", ".join(str((o, k, a[i], {"SHIP": 30, "TRUCK": 100}.get(k, 0))) for k, a in _ACCOUNTS.items() for i, o in enumerate(expenses.OPTIONS))
_BOOKED_SQL = f"""WITH made(option, kind, account, pct) AS (VALUES {_MADE}), e AS (SELECT o.option, account, pct, CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS kr FROM lineitem CROSS JOIN (VALUES ('7A'), ('7B'), ('yok')) o(option) LEFT JOIN made m ON m.kind = list_extract({[k[0] for k in KINDS]}, CAST((l_linenumber + l_suppkey) % 7 + 1 AS INTEGER)) AND m.option = o.option)
SELECT option, account, CAST(sum(n) AS BIGINT) AS n, CAST(sum(kr) AS BIGINT) AS amount_kr FROM (SELECT option, account, count(*) AS n, sum(kr - kr * coalesce(pct, 0) // 100) AS kr FROM e GROUP BY 1, 2 UNION ALL SELECT option, account || '.99', 0, sum(kr * pct // 100) FROM e WHERE pct > 0 GROUP BY 1, 2) GROUP BY 1, 2"""

QUERIES = {
    "template_findings": (_findings, f"WITH {_SAVES_SQL} SELECT * FROM judged"),
    "template_list": (_list, over("journal", _LIST_SQL)),
    "expense_accounts": (_booked, _BOOKED_SQL),
}
DATES = {}
