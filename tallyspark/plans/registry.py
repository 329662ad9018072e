"""All queries over the accounting model, by name.

Dates leave a query as ISO strings, so that every engine's result compares alike; each module lists in DATES the columns
of its queries that are dates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans import books, catalogues, checks, desk, filings, money_flows, papers, reading, valuation

MODULES = (books, money_flows, checks, valuation, papers, desk, reading, filings, catalogues)


def _iso(fn, columns):
    return lambda spark, sf_dir: fn(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def _iso_sql(sql, columns):
    return f"SELECT * REPLACE ({', '.join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in columns)}) FROM ({sql})"


QUERIES, ORACLES = {}, {}
for _m in MODULES:
    for _name, (_fn, _sql) in _m.QUERIES.items():
        _dates = _m.DATES.get(_name)
        QUERIES[_name] = _iso(_fn, _dates) if _dates else _fn
        if _sql:
            ORACLES[_name] = _iso_sql(_sql, _dates) if _dates else _sql
