"""The accounting model over the trade tables: invoices, receipts, bank movements, journal.

Sales invoices are orders with their lines, purchase invoices the monthly lines of a supplier; receipts follow from valid
orders.  `MODEL_SQL` says the same in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import div, kurus, percent
from tallyspark.operators import posting
from tallyspark.operators.running import PART, ranged, running
from tallyspark.sources.scratch import version, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the accounts in use (uniform chart, fixed values).
ACCOUNTS = [
    ("1", "Current assets"), ("10", "Liquid assets"), ("100", "Cash"), ("101", "Cheques received"), ("102", "Banks"), ("103", "Cheques given (-)"),
    ("12", "Trade receivables"), ("120", "Customers"), ("121", "Notes receivable"), ("122", "Rediscount of notes receivable (-)"), ("128", "Doubtful receivables"),
    ("129", "Provision for doubtful receivables (-)"), ("15", "Inventories"), ("153", "Merchandise"), ("158", "Inventory impairment (-)"), ("159", "Advances given"),
    ("19", "Other current assets"), ("190", "Deferred VAT"), ("191", "Deductible VAT"), ("2", "Fixed assets"), ("25", "Tangible assets"), ("252", "Buildings"),
    ("3", "Short-term liabilities"), ("30", "Financial liabilities"), ("300", "Bank loans"), ("303", "Current part of long-term loans"), ("32", "Trade payables"), ("320", "Suppliers"),
    ("321", "Notes payable"), ("322", "Rediscount of notes payable (-)"), ("36", "Taxes payable"), ("360", "Taxes and funds payable"), ("37", "Provisions"),
    ("370", "Tax provision"), ("372", "Severance provision"), ("39", "Other short-term liabilities"), ("391", "Computed VAT"), ("4", "Long-term liabilities"), ("400", "Bank loans"),
    ("472", "Severance provision"), ("5", "Equity"), ("50", "Paid-in capital"), ("500", "Capital"), ("57", "Retained earnings"), ("570", "Profits of earlier years"), ("590", "Net profit of the period"),
    ("591", "Net loss of the period (-)"), ("6", "Income statement"), ("60", "Gross sales"), ("600", "Domestic sales"), ("601", "Export sales"), ("61", "Sales deductions (-)"),
    ("610", "Sales returns (-)"), ("611", "Sales discounts (-)"), ("62", "Cost of sales (-)"), ("621", "Cost of merchandise sold (-)"), ("69", "Profit or loss"), ("690", "Profit or loss of the period"),
    ("691", "Tax provision on profit (-)"), ("692", "Net profit or loss"), ("7", "Cost accounts"), ("770", "General administration"), ("771", "General administration reflection"),
]

INSTRUMENTS = {"1-URGENT": "BANKA", "2-HIGH": "NAKIT", "3-MEDIUM": "CEK", "4-NOT SPECIFIED": "SENET", "5-LOW": "ACIK"}


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCOUNTS, "code string, name string")


def _priced():
    """A line's rate of VAT and its net amount."""
    rate, disc = F.round(F.col("l_tax") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    return rate, percent(kurus("l_extendedprice"), 100 - disc)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", kurus("p_retailprice").alias("retail_kr"))
    rate, net = _priced()
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    lines = lines.select(
        F.col("l_orderkey").alias("no"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        rate.alias("rate"),
        net.alias("net_kr"),
        percent(F.col("l_quantity").cast("bigint") * F.coalesce("retail_kr", F.lit(0)), 60).alias("cost_kr"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    return lines.withColumn("vat_kr", percent("net_kr", "rate"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order: amounts, the VAT of each rate, returns, discount, cost, state."""
    rates = [F.sum(F.when(F.col("rate") == r, F.col("vat_kr")).otherwise(0)).alias(f"vat{r}") for r in range(1, 9)]
    sums = view(spark, sf_dir, "lines").groupBy("no").agg(
        F.sum("net_kr").alias("net_kr"), F.sum("vat_kr").alias("vat_kr"), F.sum("cost_kr").alias("cost_kr"),
        F.sum(F.when(F.col("returned"), F.col("net_kr")).otherwise(0)).alias("return_net_kr"), F.sum(F.when(F.col("returned"), F.col("vat_kr")).otherwise(0)).alias("return_vat_kr"), *rates,
    )
    orders = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "KABUL").when(F.col("o_orderstatus") == "O", "GONDERILDI").when(F.col("o_orderkey") % 3 == 0, "IPTAL").otherwise("TASLAK")
    amounts = [c for c in sums.columns if c != "no"]
    df = orders.join(sums, orders["o_orderkey"] == sums["no"], "left").select(
        F.col("o_orderkey").alias("no"), F.lit("SATIS").alias("direction"), F.col("o_custkey").alias("party"), F.col("o_orderdate").cast("date").alias("date"),
        state.alias("state"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 11 == 0).alias("export"), *[F.coalesce(sums[c], F.lit(0)).alias(c) for c in amounts],
    )
    df = df.withColumn("valid", F.col("state").isin("KABUL", "GONDERILDI")).withColumn("gross_kr", F.col("net_kr") + F.col("vat_kr"))
    discounted = (F.col("return_net_kr") == 0) & (F.col("priority") == "1-URGENT")
    df = df.withColumn("discount_net_kr", F.when(discounted, percent("net_kr", 2)).otherwise(0)).withColumn("discount_vat_kr", F.when(discounted, percent("vat_kr", 2)).otherwise(0))
    return df.withColumn("net_debt_kr", posting.net_debt())


def sale_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no, party, date, net_kr, vat_kr, gross_kr of `sales`, by order.  Its parts say nothing of these unless a key of theirs is there twice, so lines do not meet them."""
    columns = ["no", "party", "date", "net_kr", "vat_kr", "gross_kr"]
    twice = table(spark, sf_dir, "part").where("p_partkey is not null").groupBy("p_partkey").count().where("count > 1")
    if _key(spark, sf_dir, "sales") in _views or not twice.isEmpty():
        return view(spark, sf_dir, "sales").select(*columns)
    rate, net = _priced()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", net.alias("net_kr"), rate.alias("rate")).withColumn("vat_kr", percent("net_kr", "rate"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("net_kr").alias("net_kr"), F.sum("vat_kr").alias("vat_kr"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("party"), F.col("o_orderdate").cast("date").alias("date"))
    met = orders.join(sums, orders["no"] == sums["l_orderkey"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("net_kr", "vat_kr")})
    return met.withColumn("gross_kr", F.col("net_kr") + F.col("vat_kr")).select(*columns)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each supplier and month of shipping: the lines' cost with 10 percent VAT, dated at the month's end."""
    month = F.last_day("ship_date")
    df = view(spark, sf_dir, "lines").groupBy(F.col("supplier").alias("party"), month.alias("date")).agg(F.sum("cost_kr").alias("net_kr"))
    number = F.col("party") * 1_000_000 + F.date_format("date", "yyyyMM").cast("bigint")
    return df.select(number.alias("no"), F.lit("ALIS").alias("direction"), "party", "date", "net_kr", percent("net_kr", 10).alias("vat_kr")).withColumn("gross_kr", F.col("net_kr") + F.col("vat_kr"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money received: 40 to 120 percent of a valid order's gross, up to 44 days later; every fiftieth without a party."""
    instrument = F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in INSTRUMENTS.items()])
    return view(spark, sf_dir, "sales").where("valid").select(
        F.col("no").alias("id"), F.when(F.col("no") % 50 != 0, F.col("party")).alias("party"), F.lit("SATIS").alias("direction"),
        F.date_add("date", (F.col("no") % 45).cast("int")).alias("date"), div(F.col("gross_kr") * (40 + F.col("no") % 81), 100).alias("amount_kr"), instrument.alias("instrument"),
        F.concat(F.lit("BANK"), (F.col("party") % 5).cast("string")).alias("bank"),
    ).where("amount_kr > 0")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money paid to suppliers: 50 to 110 percent of a purchase invoice, up to 39 days later, by an instrument of its number."""
    instrument = F.element_at(F.array(*map(F.lit, INSTRUMENTS.values())), (F.col("no") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "purchases").select(
        F.col("no").alias("id"), "party", F.lit("ALIS").alias("direction"), F.date_add("date", (F.col("no") % 40).cast("int")).alias("date"), div(F.col("gross_kr") * (50 + F.col("no") % 61), 100).alias("amount_kr"), instrument.alias("instrument"),
        F.concat(F.lit("BANK"), (F.col("party") % 5).cast("string")).alias("bank"),
    ).where("amount_kr > 0")


def bank_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an account's movements: purchases come in, the rest goes out; every 97th reported balance is off by one."""
    df = table(spark, sf_dir, "events").where("value is not null").select(
        (F.col("user_id") % 10).alias("account"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("date"), F.col("user_id").alias("user"),
        F.when(F.col("event_type") == "purchase", "GIRIS").otherwise("CIKIS").alias("direction"), kurus("value").alias("amount_kr"),
    )
    from tallyspark.operators.reconcile import signed

    parts = ranged(df.where("amount_kr > 0"), ["account"], ["seq"])
    out = running(parts, ["account"], ["seq"], {"balance_kr": (F.sum, signed())}).drop(PART)
    return out.withColumn("balance_kr", F.col("balance_kr") + F.when(F.col("seq") % 97 == 0, 1).otherwise(0))


_views: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), name


def view(spark: SparkSession, sf_dir: str, name: str, make=None) -> DataFrame:
    """A model table that several queries of a session share, written once; `make` if it is none of this module.

    Lines of orders are one: sales and purchases read them, so that they meet their parts once.  It is made anew when the files under `sf_dir` are others, and outlives lost executors.
    """
    key = _key(spark, sf_dir, name)
    if key not in _views:
        _views[key] = written((make or {"lines": order_lines, "journal": journal, "sales": sales, "receipts": receipts, "purchases": purchases, "payments": payments, "movements": bank_movements}[name])(spark, sf_dir), name)
    return _views[key]


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voucher, kind, line_no, date, account, debit_kr, credit_kr, doc_no."""
    s = view(spark, sf_dir, "sales")
    rec = receipts(spark, sf_dir).where("party is not null and instrument <> 'ACIK'")
    return (
        posting.sale_accruals(s)
        .unionByName(posting.voids(posting.sale_accruals(s.where("state = 'IPTAL'"))))
        .unionByName(posting.sale_returns(s))
        .unionByName(posting.costs(s))
        .unionByName(posting.discounts(s))
        .unionByName(posting.purchase_accruals(view(spark, sf_dir, "purchases")))
        .unionByName(posting.receipt_vouchers(rec))
        .unionByName(posting.opening(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")))
    )


MODEL_SQL = {
    "line": """SELECT l_orderkey AS no, l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS ship_date, CAST(round(l_tax * 100) AS BIGINT) AS rate, net_kr, net_kr * CAST(round(l_tax * 100) AS BIGINT) // 100 AS vat_kr,
  CAST(l_quantity AS BIGINT) * coalesce(CAST(round(p_retailprice * 100) AS BIGINT), 0) * 60 // 100 AS cost_kr, l_returnflag = 'R' AS returned
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS net_kr FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey""",
    "sale": """SELECT *, CASE WHEN valid THEN greatest(gross_kr - return_net_kr - return_vat_kr - discount_net_kr - discount_vat_kr, 0) ELSE 0 END AS net_debt_kr FROM (SELECT *, net_kr + vat_kr AS gross_kr,
  CASE WHEN return_net_kr = 0 AND priority = '1-URGENT' THEN net_kr * 2 // 100 ELSE 0 END AS discount_net_kr, CASE WHEN return_net_kr = 0 AND priority = '1-URGENT' THEN vat_kr * 2 // 100 ELSE 0 END AS discount_vat_kr,
  state IN ('KABUL', 'GONDERILDI') AS valid FROM (SELECT o_orderkey AS no, o_custkey AS party, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, o_custkey % 11 = 0 AS export,
  CASE WHEN o_orderstatus = 'F' THEN 'KABUL' WHEN o_orderstatus = 'O' THEN 'GONDERILDI' WHEN o_orderkey % 3 = 0 THEN 'IPTAL' ELSE 'TASLAK' END AS state,
  CAST(coalesce(n, 0) AS BIGINT) AS net_kr, CAST(coalesce(v, 0) AS BIGINT) AS vat_kr, CAST(coalesce(c, 0) AS BIGINT) AS cost_kr, CAST(coalesce(rn, 0) AS BIGINT) AS return_net_kr, CAST(coalesce(rv, 0) AS BIGINT) AS return_vat_kr
  FROM orders LEFT JOIN (SELECT no AS k, sum(net_kr) AS n, sum(vat_kr) AS v, sum(cost_kr) AS c, sum(CASE WHEN returned THEN net_kr ELSE 0 END) AS rn, sum(CASE WHEN returned THEN vat_kr ELSE 0 END) AS rv FROM line GROUP BY no) ON k = o_orderkey))""",
    "rate_vat": "SELECT no, rate, CAST(sum(vat_kr) AS BIGINT) AS vat_kr FROM line GROUP BY no, rate HAVING sum(vat_kr) > 0",
    "purchase": """SELECT *, net_kr + vat_kr AS gross_kr FROM (SELECT supplier * 1000000 + CAST(strftime(last_day(ship_date), '%Y%m') AS BIGINT) AS no, supplier AS party, last_day(ship_date) AS date,
  CAST(sum(cost_kr) AS BIGINT) AS net_kr, CAST(sum(cost_kr) AS BIGINT) * 10 // 100 AS vat_kr FROM line GROUP BY supplier, last_day(ship_date))""",
    "receipt": """SELECT * FROM (SELECT no AS id, CASE WHEN no % 50 <> 0 THEN party END AS party, date + CAST(no % 45 AS INTEGER) AS date, gross_kr * (40 + no % 81) // 100 AS amount_kr,
  CASE priority WHEN '1-URGENT' THEN 'BANKA' WHEN '2-HIGH' THEN 'NAKIT' WHEN '3-MEDIUM' THEN 'CEK' WHEN '4-NOT SPECIFIED' THEN 'SENET' WHEN '5-LOW' THEN 'ACIK' END AS instrument, 'BANK' || CAST(party % 5 AS VARCHAR) AS bank
  FROM sale WHERE valid) WHERE amount_kr > 0""",
    "payment": """SELECT * FROM (SELECT no AS id, party, date + CAST(no % 40 AS INTEGER) AS date, gross_kr * (50 + no % 61) // 100 AS amount_kr, list_extract(['BANKA', 'NAKIT', 'CEK', 'SENET', 'ACIK'], CAST(no % 5 + 1 AS INTEGER)) AS instrument, 'BANK' || CAST(party % 5 AS VARCHAR) AS bank
  FROM purchase) WHERE amount_kr > 0""",
    "posted": """SELECT 1000000000000 + no AS voucher, 'accrual' AS kind, line_no, date, account, d AS debit_kr, c AS credit_kr, no AS doc_no FROM (
  SELECT no, date, 1 AS line_no, '120.' || CAST(party AS VARCHAR) AS account, gross_kr AS d, 0 AS c FROM sale WHERE state <> 'TASLAK'
  UNION ALL SELECT no, date, 2, CASE WHEN export THEN '601' ELSE '600' END, 0, net_kr FROM sale WHERE state <> 'TASLAK'
  UNION ALL SELECT s.no, date, CAST(2 + rate AS INTEGER), '391.0' || CAST(rate AS VARCHAR), 0, v.vat_kr FROM sale s JOIN rate_vat v ON v.no = s.no WHERE state <> 'TASLAK')""",
    "journal": """SELECT voucher, kind, CAST(line_no AS INTEGER) AS line_no, date, account, CAST(debit_kr AS BIGINT) AS debit_kr, CAST(credit_kr AS BIGINT) AS credit_kr, doc_no FROM (
  SELECT * FROM posted
  UNION ALL SELECT voucher + 1000000000000, 'void', line_no, date, account, credit_kr, debit_kr, doc_no FROM posted WHERE doc_no IN (SELECT no FROM sale WHERE state = 'IPTAL')
  UNION ALL SELECT 3000000000000 + no, 'return', l, date, a, d, c, no FROM (SELECT no, date, unnest([{'l': 1, 'a': '610', 'd': return_net_kr, 'c': 0}, {'l': 2, 'a': '191.01', 'd': return_vat_kr, 'c': 0},
    {'l': 3, 'a': '120.' || CAST(party AS VARCHAR), 'd': 0, 'c': return_net_kr + return_vat_kr}], recursive := true) FROM sale WHERE valid AND return_net_kr > 0)
  UNION ALL SELECT 4000000000000 + no, 'cost', l, date, a, d, c, no FROM (SELECT no, date, unnest([{'l': 1, 'a': '621', 'd': cost_kr, 'c': 0}, {'l': 2, 'a': '153', 'd': 0, 'c': cost_kr}, {'l': 3, 'a': '153', 'd': cost_kr * return_net_kr // net_kr, 'c': 0},
    {'l': 4, 'a': '621', 'd': 0, 'c': cost_kr * return_net_kr // net_kr}], recursive := true) FROM sale WHERE valid AND net_kr > 0)
  UNION ALL SELECT 5000000000000 + no, 'discount', l, date, a, d, c, no FROM (SELECT no, date, unnest([{'l': 1, 'a': '611', 'd': discount_net_kr, 'c': 0}, {'l': 2, 'a': '191.01', 'd': discount_vat_kr, 'c': 0},
    {'l': 3, 'a': '120.' || CAST(party AS VARCHAR), 'd': 0, 'c': discount_net_kr + discount_vat_kr}], recursive := true) FROM sale WHERE valid AND discount_net_kr > 0)
  UNION ALL SELECT 6000000000000 + no, 'purchase', l, date, a, d, c, no FROM (SELECT no, date, unnest([{'l': 1, 'a': '153', 'd': net_kr, 'c': 0}, {'l': 2, 'a': '191.02', 'd': vat_kr, 'c': 0},
    {'l': 3, 'a': '320.' || CAST(party AS VARCHAR), 'd': 0, 'c': gross_kr}], recursive := true) FROM purchase)
  UNION ALL SELECT 8000000000000 + id, 'receipt', l, date, a, d, c, id FROM (SELECT id, date, unnest([{'l': 1, 'a': CASE instrument WHEN 'BANKA' THEN '102' WHEN 'NAKIT' THEN '100' WHEN 'CEK' THEN '101' ELSE '121' END, 'd': amount_kr, 'c': 0},
    {'l': 2, 'a': '120.' || CAST(party AS VARCHAR), 'd': 0, 'c': amount_kr}], recursive := true) FROM receipt WHERE party IS NOT NULL AND instrument <> 'ACIK')
  UNION ALL SELECT 0, 'opening', 1, DATE '1994-12-31', '120.' || CAST(c_custkey AS VARCHAR), greatest(k, 0), greatest(-k, 0), 0 FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS k FROM customer)
  UNION ALL SELECT 0, 'opening', 2, DATE '1994-12-31', '320.' || CAST(s_suppkey AS VARCHAR), greatest(-k, 0), greatest(k, 0), 0 FROM (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS k FROM supplier)
  UNION ALL SELECT 0, 'opening', 3, DATE '1994-12-31', '500', greatest(-k, 0), greatest(k, 0), 0 FROM (SELECT (SELECT sum(CAST(round(c_acctbal * 100) AS BIGINT)) FROM customer) - (SELECT sum(CAST(round(s_acctbal * 100) AS BIGINT)) FROM supplier) AS k)
  ) WHERE debit_kr > 0 OR credit_kr > 0""",
    "movement": """SELECT *, CAST(sum(CASE WHEN direction = 'GIRIS' THEN amount_kr ELSE -amount_kr END) OVER (PARTITION BY account ORDER BY seq) AS BIGINT) + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END AS balance_kr FROM (
  SELECT user_id % 10 AS account, event_id AS seq, CAST(ts AS DATE) AS date, user_id AS "user", CASE WHEN event_type = 'purchase' THEN 'GIRIS' ELSE 'CIKIS' END AS direction, CAST(round(value * 100) AS BIGINT) AS amount_kr FROM events WHERE value IS NOT NULL) WHERE amount_kr > 0""",
}
_NEEDS = {"sale": ["line"], "rate_vat": ["line"], "purchase": ["line"], "receipt": ["sale"], "payment": ["purchase"], "posted": ["sale", "rate_vat"], "journal": ["posted", "purchase", "receipt"]}


def over(names: str, sql: str) -> str:
    """`sql`, which may begin with CTEs of its own, over the model tables `names`."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    head = ",\n".join(f"{n} AS ({MODEL_SQL[n]})" for n in wanted)
    return f"WITH RECURSIVE {head}" + (",\n" + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)
