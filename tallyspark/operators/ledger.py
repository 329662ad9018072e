"""Books: trial balance, general ledger, journal, hierarchical balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import accounts as A
from tallyspark.functions.money import formatted, total
from tallyspark.operators.posting import numbered
from tallyspark.operators.running import ranged, running
from tallyspark.sources.scratch import written


def net() -> Column:
    return F.sum(F.col("debit_kr") - F.col("credit_kr"))


def trial_balance(journal: DataFrame) -> DataFrame:
    """Debits, credits and the balance on its side, for each account."""
    sums = journal.groupBy("account").agg(total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"))
    off = F.col("debit_kr") - F.col("credit_kr")
    return sums.withColumn("debit_balance_kr", F.greatest(off, F.lit(0))).withColumn("credit_balance_kr", F.greatest(-off, F.lit(0)))


def named(balance: DataFrame, chart: DataFrame) -> DataFrame:
    """With ledger code, its name and `type · nature`; empty where the chart lacks it.  The chart is of bounded size."""
    dim = chart.select(F.col("code").alias("ledger"), F.col("name"), F.concat_ws(" · ", A.kind("code", "name"), A.nature("code", "name")).alias("nature"))
    out = balance.withColumn("ledger", A.ledger_code("account")).join(F.broadcast(dim), "ledger", "left")
    return out.select("account", "ledger", *[c for c in balance.columns if c != "account"], F.coalesce("name", F.lit("")).alias("name"), F.coalesce("nature", F.lit("")).alias("nature"))


def general_ledger(journal: DataFrame) -> DataFrame:
    """Movements of each account by date, voucher and line, with the running balance and the line's `side`.

    A line's contra accounts are those of its voucher and side in `contras`: written once, not with each line.
    """
    rows = journal.select("account", "date", "voucher", "line_no", "debit_kr", "credit_kr")
    order = ["date", "voucher", "line_no"]
    out = running(ranged(rows, ["account"], order), ["account"], order, {"balance_kr": (F.sum, F.col("debit_kr") - F.col("credit_kr"))})
    return out.select(*rows.columns, "balance_kr", F.when(F.col("debit_kr") > 0, "debit").otherwise("credit").alias("side"))


def kinds(journal: DataFrame) -> DataFrame:
    """Lines (voucher, debit, code, vouchers) of one voucher of each kind, each once, with the number of vouchers of the kind.

    Vouchers are of a kind if they have the same ledger accounts on the same sides equally often.  Most vouchers are of few kinds: what depends
    on sides and ledger accounts alone is asked of one of each.  A kind is the number of lines and sums of two 64-bit hashes of them,
    in halves that cannot overflow; sums of numbers combine in hash tables before they are shuffled.
    """
    lines = journal.select("voucher", (F.col("debit_kr") > 0).alias("debit"), A.ledger_code("account").alias("code"))
    hashed = lines.select("voucher", *[F.xxhash64(F.lit(seed), "debit", "code").alias(f"h{seed}") for seed in (1, 2)])
    halves = [F.sum(half(F.col(h))).alias(f"{h}{i}") for h in ("h1", "h2") for i, half in enumerate((lambda x: x.bitwiseAND(0xFFFFFFFF), lambda x: F.shiftrightunsigned(x, 32)))]
    each = hashed.groupBy("voucher").agg(F.count("*").alias("lines"), *halves)
    found = written(each.groupBy([c for c in each.columns if c != "voucher"]).agg(F.min("voucher").alias("one"), F.count("*").alias("vouchers")).select("one", "vouchers"), "kinds")
    return lines.join(found, F.col("voucher").eqNullSafe(F.col("one"))).select("voucher", "debit", "code", "vouchers").distinct()


#: Lines of a voucher up to which its contra accounts gather in one row, and accounts of a row.
CONTRA_LINES = 1000


def contras(journal: DataFrame, chunk: int = CONTRA_LINES) -> DataFrame:
    """For each voucher and `side` the accounts on the other side, neighbouring repeats once, in line order: `contra` in numbered
    chunks of `chunk` accounts.  Short vouchers gather in one row, long ones go through ranges and prefix sums."""
    side = F.when(F.col("debit_kr") > 0, "credit").otherwise("debit").alias("side")
    # Long vouchers are a thousandth of the lines at most.  Equal lines need not be dropped here: they are neighbours in the list.
    many = _many(journal)
    lines = journal.where("voucher is not null").join(many, "voucher", "left_anti").select("voucher", side, F.struct("line_no", "account").alias("x"))
    listed = lines.groupBy("voucher", "side").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["account"]).alias("contra"))
    once = F.filter("contra", lambda x, i: (i == 0) | (x != F.get("contra", i - 1)))
    short = listed.select("voucher", "side", F.posexplode(F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(once) - 1, F.lit(chunk)).cast("int")), lambda k: F.array_join(F.slice(once, k * chunk + 1, F.lit(chunk)), ", "))).alias("chunk", "contra"))
    return short.select("voucher", "side", F.col("chunk").cast("long").alias("chunk"), "contra").unionByName(long_contras(journal, chunk, many))


def _many(journal: DataFrame) -> DataFrame:
    """Vouchers of more than CONTRA_LINES lines."""
    return written(journal.groupBy("voucher").count().where(f"count > {CONTRA_LINES} and voucher is not null").select("voucher"), "many")


def long_contras(journal: DataFrame, chunk: int = CONTRA_LINES, many: DataFrame | None = None) -> DataFrame:
    """Contra accounts of vouchers with more than CONTRA_LINES lines: `contra` in chunks of `chunk` accounts, numbered from 0, once
    for all lines of a `side` (debit or credit) of a voucher.

    The order and repeats are those of `general_ledger`; a side whose other side is empty has no rows.  Numbers come from
    ranges and prefix sums, so no task sees more than its part of a voucher.
    """
    side = F.when(F.col("debit_kr") > 0, "credit").otherwise("debit").alias("side")
    lines = journal.join(_many(journal) if many is None else many, "voucher", "left_semi").select("voucher", side, "line_no", "account").distinct()
    order = ("voucher", "side", "line_no", "account")
    series = F.concat_ws(" ", F.col("voucher").cast("string"), "side")
    at = numbered(lines.withColumn("series", series), *order).drop("journal_no")
    before = at.select("series", (F.col("serial") + 1).alias("serial"), F.col("account").alias("last"))
    once = at.join(before, ["series", "serial"], "left").where("last is null or last <> account").select("voucher", "side", "line_no", "account", "series")
    place = (F.col("serial") - 1).alias("place")
    out = numbered(once, *order).select("voucher", "side", "account", place).withColumn("chunk", F.call_function("div", F.col("place"), F.lit(chunk)))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "account"))), lambda x: x["account"])
    return out.groupBy("voucher", "side", "chunk").agg(F.array_join(listed, ", ").alias("contra"))


def journal_book(journal: DataFrame, last: int) -> DataFrame:
    """The last vouchers by date and number, with their totals."""
    heads = journal.groupBy("voucher").agg(F.min("date").alias("date"), F.min("kind").alias("kind"), total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"), F.count("*").alias("n_lines"))
    return heads.orderBy(F.desc("date"), F.desc("voucher")).limit(last)


def rollup(journal: DataFrame) -> DataFrame:
    """Debits, credits and net of every code that has something under it."""
    leaves = journal.groupBy("account").agg(total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"))
    each = leaves.select(F.explode(A.ancestors("account")).alias("code"), "debit_kr", "credit_kr")
    return each.groupBy("code").agg(total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"), net().cast("bigint").alias("net_kr"))


def balanced(journal: DataFrame) -> DataFrame:
    sums = journal.agg(total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"))
    return sums.withColumn("balanced", F.col("debit_kr") == F.col("credit_kr"))


def voucher_totals(journal: DataFrame) -> DataFrame:
    return journal.groupBy("voucher").agg(total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"))


def subsidiary_summary(journal: DataFrame, prefix: str) -> DataFrame:
    return journal.where(A.under("account", prefix)).groupBy("account").agg(F.count("*").alias("n"), total("debit_kr").alias("debit_kr"), total("credit_kr").alias("credit_kr"), net().cast("bigint").alias("net_kr"))


def page(journal: DataFrame, account: str, offset: int, limit: int) -> DataFrame:
    """Movements `offset` to `offset + limit` from the end, in order, with the running balance: the account's balance less what follows."""
    own = journal.where(F.col("account") == account)
    amount = F.col("debit_kr") - F.col("credit_kr")
    order = [F.desc("date"), F.desc("voucher"), F.desc("line_no")]
    balance = own.agg(F.coalesce(F.sum(amount), F.lit(0))).first()[0]
    last = own.orderBy(*order).limit(offset + limit).withColumn("page", F.lit(1))  # the only rows that a task sees together
    after = F.coalesce(F.sum(amount).over(Window.partitionBy("page").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = last.withColumn("balance_kr", (F.lit(balance) - after).cast("bigint")).orderBy(*order).offset(offset).limit(limit)
    return out.select("date", "voucher", "line_no", "debit_kr", "credit_kr", "balance_kr").orderBy("date", "voucher", "line_no")


def chart_levels(chart: DataFrame) -> DataFrame:
    """Class, nature, level and whether an account can be posted to: three digits and no account below it."""
    parents = chart.where("instr(code, '.') > 0").select(F.substring_index("code", ".", 1).alias("code")).distinct().withColumn("parent", F.lit(True))
    leaf = (F.length("code") == 3) | (F.instr("code", ".") > 0)
    out = chart.join(parents, "code", "left")
    return out.where("substring(code, 1, 1) <> '8'").select("code", "name", A.kind("code", "name").alias("type"), A.nature("code", "name").alias("nature"), A.level("code").alias("level"), (leaf & F.col("parent").isNull()).alias("postable"))


def with_sub_account(chart: DataFrame, parent: str, sub: str, name: str) -> DataFrame:
    """`chart` with an account below `parent`."""
    return chart.unionByName(chart.where(F.col("code") == parent).select(F.concat_ws(".", "code", F.lit(sub)).alias("code"), F.lit(name).alias("name"))).dropDuplicates(["code"])


def account_text(codes: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each code, else that of its ledger account."""
    texts = texts.where("text is not null")
    own, parent = texts.select(F.col("code"), F.col("text").alias("own")), texts.select(F.col("code").alias("ledger"), F.col("text").alias("parent"))
    out = codes.withColumn("ledger", A.ledger_code("code")).join(own, "code", "left").join(parent, "ledger", "left")
    return out.select("code", F.coalesce("own", "parent", F.lit("")).alias("text"))


def text_lines(journal: DataFrame) -> DataFrame:
    """The general ledger as fixed-width lines, to be written as text."""
    line = F.concat(F.rpad("account", 14, " "), F.date_format("date", "dd.MM.yyyy"), *[F.lpad(formatted(c), 20, " ") for c in ("debit_kr", "credit_kr", "balance_kr")])
    return general_ledger(journal).select("account", "date", "voucher", "line_no", line.alias("value"))
