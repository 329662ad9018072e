"""Money to invoices: frozen, manual and first-in-first-out allocation in closed form, and what follows from it.

First in, first out: with C(t) the running sum of a party's invoices dated up to t and P the running sum of its
receipts, what is allocated after a receipt is P + least(0, running minimum of C - P): the loop unrolled, since eligible
invoices are always a prefix.  A receipt then covers an interval of that sum, an invoice one of C, and the allocations are
their overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import total
from tallyspark.operators.running import PART
from tallyspark.sources.scratch import written

KEY = ["direction", "party"]
#: Invoices or receipts of a party between two checkpoints of its running sums: intervals meet within a stride only.
STRIDE = 64


def fifo(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """`invoices` (direction, party, no, date, open_kr) and `receipts` (direction, party, id, date, open_kr) to (id, no, amount_kr).

    Receipts by (date, id) take invoices by (date, no) that are dated no later; receipts without a party take none.  The
    overlap join is on party, direction and stride of the running sum, so that a party's receipts meet only invoices near
    them and never all of them.
    """
    inv = invoices.where("open_kr > 0 and party is not null").select(*KEY, "date", F.lit(0).alias("side"), F.col("no").alias("key"), "open_kr")
    rec = receipts.where("open_kr > 0 and party is not null").select(*KEY, "date", F.lit(1).alias("side"), F.col("id").alias("key"), "open_kr")
    order = ["date", "side", "key"]
    of = lambda side: F.when(F.col("side") == side, F.col("open_kr")).otherwise(F.lit(0))
    # As in `running`, but at once: sums and minima within a range come from one window, the ranges before it give two sums and a minimum.
    own = Window.partitionBy(PART, *KEY).orderBy(*order)
    now, past = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    rows = inv.unionByName(rec).repartitionByRange(*KEY, *order).withColumn(PART, F.spark_partition_id())
    rows = rows.withColumns({"c": F.sum(of(0)).over(now), "p": F.sum(of(1)).over(now)}).withColumn("short", F.when(F.col("side") == 1, F.col("c") - F.col("p")))
    rows = written(rows.withColumns({"least": F.min("short").over(now), "before": F.min("short").over(past)}), "sums")
    here = rows.groupBy(PART, *KEY).agg(F.sum(of(0)).alias("c"), F.sum(of(1)).alias("p"), F.min("short").alias("short"))
    earlier = Window.partitionBy(*KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumns({"c0": F.coalesce(F.sum("c").over(earlier), F.lit(0)), "p0": F.coalesce(F.sum("p").over(earlier), F.lit(0)), "ranges": F.count("*").over(earlier)})
    here = here.withColumn("short0", F.min(F.col("c0") - F.col("p0") + F.col("short")).over(earlier))
    carried = here.where("ranges > 0").select(PART, *KEY, "c0", "p0", "short0")  # a row for each range at most
    both = rows.join(F.broadcast(carried), [PART, *KEY], "left").na.fill(0, ["c0", "p0"])
    moved = lambda c: F.least(F.col(c) + F.col("c0") - F.col("p0"), "short0")
    both = both.withColumns({"c": F.col("c") + F.col("c0"), "p": F.col("p") + F.col("p0"), "least": moved("least"), "before": moved("before")})
    # An invoice's interval ends at C; a receipt's at what is allocated after it, and begins where that of the receipt before it ended.
    upto = F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("p") + F.least(F.lit(0), "least")).cast("bigint")
    since = F.when(F.col("side") == 0, F.col("c") - F.col("open_kr")).otherwise(F.col("p") - F.col("open_kr") + F.least(F.lit(0), "before")).cast("bigint")
    both = both.select(*KEY, "side", "key", since.alias("since"), upto.alias("upto")).where("upto > since")
    # Cells of the sum: about STRIDE invoices each, from the party's own mean.
    mean = both.where("side = 0").groupBy(*KEY).agg(F.greatest(F.ceil(F.max("upto") / F.greatest(F.count("*") / STRIDE, F.lit(1))), F.lit(1)).cast("bigint").alias("cell"))
    met = both.join(mean, KEY)
    cells = F.sequence(F.call_function("div", F.col("since"), F.col("cell")), F.call_function("div", F.col("upto") - 1, F.col("cell")))
    met = met.select(*KEY, "side", "key", "since", "upto", "cell", F.explode(cells).alias("at"))
    a = met.where("side = 1").select(*KEY, "at", "cell", F.col("key").alias("id"), F.col("since").alias("rs"), F.col("upto").alias("ru"))
    b = met.where("side = 0").select(*KEY, "at", F.col("key").alias("no"), F.col("since").alias("s"), F.col("upto").alias("u"))
    low = F.greatest("rs", "s", F.col("at") * F.col("cell"))
    high = F.least("ru", "u", (F.col("at") + 1) * F.col("cell"))
    parts = a.join(b, [*KEY, "at"]).where(high > low).select("id", "no", (high - low).alias("part"))
    return parts.groupBy("id", "no").agg(total("part").alias("amount_kr"))


def manual(decisions: DataFrame, invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """`decisions` (id, no): in the order of the receipts each takes what its invoice has left; other parties' are refused."""
    i = invoices.select("no", F.col("party").alias("ip"), F.col("direction").alias("idir"), F.col("open_kr").alias("cap"))
    r = receipts.select("id", "date", F.col("party").alias("rp"), F.col("direction").alias("rdir"), F.col("open_kr").alias("amount"))
    met = decisions.join(r, "id").join(i, "no").where("rdir = idir and (rp is null or rp = ip) and cap > 0 and amount > 0")
    w = Window.partitionBy("no").orderBy("date", "id")
    upto = F.least("cap", F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("upto", upto).withColumn("since", F.coalesce(F.lag("upto").over(w), F.lit(0)))
    return met.where("upto > since").select("id", "no", (F.col("upto") - F.col("since")).cast("bigint").alias("amount_kr"))


def less(rows: DataFrame, key: str, allocated: DataFrame) -> DataFrame:
    used = allocated.groupBy(key).agg(total("amount_kr").alias("_used"))
    return rows.join(used, key, "left").withColumn("open_kr", F.col("open_kr") - F.coalesce("_used", F.lit(0))).drop("_used")


def allocate(invoices: DataFrame, receipts: DataFrame, frozen: DataFrame, decisions: DataFrame) -> DataFrame:
    """Frozen allocations (unless their invoice is decided by hand), then decisions, then first in first out: (id, no, amount_kr, source).

    Receipts with a decision take no part in the last step.  Each step is written, since every later step reads it twice.
    """
    decisions = written(decisions, "decisions")
    kept = frozen.join(decisions.select("no").distinct(), "no", "left_anti").join(decisions.select("id").distinct(), "id", "left_anti").select("id", "no", "amount_kr")
    kept = written(kept, "frozen")
    inv, rec = less(invoices, "no", kept), less(receipts, "id", kept)
    hand = written(manual(decisions, inv, rec), "manual")
    used = kept.unionByName(hand)
    inv, rec = less(invoices, "no", used), less(receipts, "id", used)
    auto = fifo(inv, rec.join(decisions.select("id").distinct(), "id", "left_anti"))
    label = lambda df, s: df.withColumn("source", F.lit(s))
    return label(kept, "DONMUS").unionByName(label(hand, "MANUEL")).unionByName(label(auto, "FIFO"))


def receipt_status(receipts: DataFrame, allocated: DataFrame, decisions: DataFrame) -> DataFrame:
    """Allocated and remaining money of each receipt; MANUEL, BEKLIYOR (unnamed or nothing allocated), OTOMATIK."""
    used = allocated.groupBy("id").agg(total("amount_kr").alias("allocated_kr"))
    out = receipts.join(used, "id", "left").join(decisions.select("id").distinct().withColumn("decided", F.lit(True)), "id", "left")
    got = F.coalesce("allocated_kr", F.lit(0))
    status = F.when(F.col("decided") & (got > 0), "MANUEL").when(F.col("party").isNull() | (got == 0), "BEKLIYOR").otherwise("OTOMATIK")
    return out.select("id", "party", F.col("open_kr").alias("amount_kr"), got.alias("allocated_kr"), (F.col("open_kr") - got).alias("remaining_kr"), status.alias("status"))


def money_account(instrument: str | Column, sale: Column) -> Column:
    """Where the money of an instrument is booked: cheques and notes received for sales, given for purchases; all else goes through the bank."""
    i = F.col(instrument) if isinstance(instrument, str) else instrument
    return F.when(i == "NAKIT", "100").when(i == "CEK", F.when(sale, "101").otherwise("103")).when(i == "SENET", F.when(sale, "121").otherwise("321")).otherwise("102")


def payment_legs(allocated: DataFrame, money: DataFrame, direction: str = "SATIS") -> DataFrame:
    """The account legs that pay each invoice of a direction: one for each instrument's account and one for the party, KARMA if instruments differ.

    Sales debit the money's accounts and credit 120, purchases debit 320 and credit the money's accounts.
    """
    sale = direction == "SATIS"
    met = allocated.join(money.select("id", "instrument"), "id").withColumn("account", money_account("instrument", F.lit(sale)))
    legs = met.groupBy("no", "account").agg(total("amount_kr").alias("amount_kr"))
    kinds = met.groupBy("no").agg(F.when(F.countDistinct("instrument") > 1, "KARMA").otherwise(F.min("instrument")).alias("instrument"), total("amount_kr").alias("amount_kr"))
    zero = F.lit(0).cast("bigint")
    side = lambda df, account, debit: df.select(F.lit(direction).alias("direction"), "no", "instrument", account.alias("account"), (F.col("amount_kr") if debit else zero).alias("debit_kr"), (zero if debit else F.col("amount_kr")).alias("credit_kr"))
    own = legs.join(kinds.select("no", "instrument"), "no")
    return side(own, F.col("account"), sale).unionByName(side(kinds, F.lit("120" if sale else "320"), not sale))


def sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns ledger `old` into `new` by the key receipt|invoice|amount: YENI to post, IPTAL to reverse."""
    key = F.concat_ws("|", "id", "no", "amount_kr").alias("key")
    a, b = old.select("id", "no", "amount_kr", key), new.select("id", "no", "amount_kr", key)
    return b.join(a, "key", "left_anti").withColumn("action", F.lit("YENI")).unionByName(a.join(b, "key", "left_anti").withColumn("action", F.lit("IPTAL")))


def effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Allocations that a decision wrote, dropped or changed."""
    a, b = before.select("id", "no", F.col("amount_kr").alias("before_kr")), after.select("id", "no", F.col("amount_kr").alias("after_kr"))
    met = a.join(b, ["id", "no"], "full_outer").select("id", "no", F.coalesce("before_kr", F.lit(0)).alias("before_kr"), F.coalesce("after_kr", F.lit(0)).alias("after_kr")).where("before_kr <> after_kr")
    outcome = F.when(F.col("before_kr") == 0, "written").when(F.col("after_kr") == 0, "dropped").otherwise("changed")
    return met.withColumn("outcome", outcome)


def outcomes(decisions: DataFrame, invoices: DataFrame, receipts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each of `decisions` (id, no; one a receipt) between two allocations (id, no, amount_kr).

    `written_kr` reached the invoice, `elsewhere_kr` of the same money went to other invoices, `advance_kr` to none; `moved_kr` left this
    money's former invoices, `dropped_kr` is other money's that made room in the invoice.  YAZILAMADI if nothing was written, KISMEN_YAZILDI
    if not all, else TAM_YAZILDI with FATURA_ACIK or FATURA_KAPANDI by what `invoices` (no, net_debt_kr) still owe.  Decisions on unknown
    receipts or invoices have no row; `prechecks` names them.
    """
    was, now = (x.groupBy("id", "no").agg(total("amount_kr").alias(n)) for x, n in ((before, "was"), (after, "now")))
    both = was.join(now, ["id", "no"], "full_outer").select("id", "no", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    both = both.withColumn("lost", F.greatest(F.col("was") - F.col("now"), F.lit(0)))
    own = both.groupBy("id").agg(total("now").alias("given"), total("lost").alias("moved_kr"))
    of = both.join(decisions.select("id", "no").withColumn("chosen", F.lit(True)), ["id", "no"], "left")
    target = of.groupBy("no").agg(total("now").alias("paid"), total("lost").alias("lost"))
    pair = of.where("chosen").select("id", "no", F.col("now").alias("written"), F.col("lost").alias("own_lost"))
    met = decisions.select("id", "no").join(receipts.select("id", "amount_kr"), "id").join(invoices.select("no", "net_debt_kr"), "no")
    met = met.join(own, "id", "left").join(target, "no", "left").join(pair, ["id", "no"], "left").na.fill(0, ["given", "moved_kr", "paid", "lost", "written", "own_lost"])
    whole = F.when(F.col("net_debt_kr") > F.col("paid"), "TAM_YAZILDI_FATURA_ACIK").otherwise("TAM_YAZILDI_FATURA_KAPANDI")
    outcome = F.when(F.col("written") == 0, "YAZILAMADI").when(F.col("written") < F.col("amount_kr"), "KISMEN_YAZILDI").otherwise(whole)
    return met.select(
        "id", "no", "amount_kr", F.col("written").alias("written_kr"), (F.col("given") - F.col("written")).alias("elsewhere_kr"), F.greatest(F.col("amount_kr") - F.col("given"), F.lit(0)).alias("advance_kr"),
        "moved_kr", (F.col("lost") - F.col("own_lost")).alias("dropped_kr"), outcome.alias("outcome"),
    )


def unallocated(status: DataFrame, receipts: DataFrame, as_of: str) -> DataFrame:
    """Receipts with money left, with their age in days of a 360-day year."""
    d, t = F.col("date"), F.lit(as_of).cast("date")
    age = (F.year(t) - F.year(d)) * 360 + (F.month(t) - F.month(d)) * 30 + F.dayofmonth(t) - F.dayofmonth(d)
    return status.where("remaining_kr > 0").join(receipts.select("id", "date", "bank"), "id").select("id", "party", "bank", "remaining_kr", "status", age.alias("age_days"))


def invariants(invoices: DataFrame, receipts: DataFrame, allocated: DataFrame, journal: DataFrame) -> DataFrame:
    """What must hold of `invoices` (no, direction, valid, net_debt_kr, remaining_kr), `receipts` (id, direction, amount_kr,
    allocated_kr) and their allocations: a row (code, key, amount_kr) where it does not.

    D01 a receipt gives more than it has; D02 its recorded allocation is another; D03 an invoice gets more than its debt; D04 its
    recorded remainder is negative; D05 an invoice without effect gets something; D06 the ledger is unbalanced; D07 money of
    the other direction.
    """
    a = allocated
    by_receipt = receipts.join(a.groupBy("id").agg(total("amount_kr").alias("s")), "id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    by_invoice = invoices.join(a.groupBy("no").agg(total("amount_kr").alias("s")), "no", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    finding = lambda code, key, amount: F.struct(F.lit(code).alias("code"), F.col(key).cast("bigint").alias("key"), amount.cast("bigint").alias("amount_kr"))
    some = lambda *found: F.inline(F.array_compact(F.array(*[F.when(c, x) for c, x in found])))
    rec = by_receipt.select(some(
        (F.col("s") > F.col("amount_kr"), finding("D01", "id", F.col("s") - F.col("amount_kr"))), (F.col("s") != F.col("allocated_kr"), finding("D02", "id", F.col("s") - F.col("allocated_kr"))),
    ))
    inv = by_invoice.select(some(
        (F.col("s") > F.col("net_debt_kr"), finding("D03", "no", F.col("s") - F.col("net_debt_kr"))), (F.col("remaining_kr") < 0, finding("D04", "no", F.col("remaining_kr"))), (~F.col("valid") & (F.col("s") != 0), finding("D05", "no", F.col("s"))),
    ))
    way = a.join(invoices.select("no", F.col("direction").alias("idir")), "no").join(receipts.select("id", F.col("direction").alias("rdir")), "id").where("idir <> rdir")
    off = journal.agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("off")).where("off <> 0").select(F.lit("D06"), F.lit(0).cast("bigint"), "off")
    return rec.union(inv).union(way.select(F.lit("D07"), "no", "amount_kr")).union(off)


def prechecks(requests: DataFrame, invoices: DataFrame, receipts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings for requested decisions (id, no): K01, K02 unknown, K03 void, K04 party, K05 direction, K06 no debt, K07 taken, K08 so decided already, K09 later invoice, K10 exceeds."""
    i = invoices.select("no", F.col("party").alias("ip"), F.col("direction").alias("idir"), F.col("date").alias("idate"), "valid", "net_debt_kr")
    r = receipts.select("id", F.col("party").alias("rp"), F.col("direction").alias("rdir"), F.col("date").alias("rdate"), "amount_kr")
    taken = decisions.select("no", F.col("id").alias("holder"))
    met = requests.join(r, "id", "left").join(i, "no", "left").join(taken.groupBy("no").agg(F.min("holder").alias("holder")), "no", "left")
    met = met.join(decisions.select("id", "no").distinct().withColumn("own", F.lit(True)), ["id", "no"], "left")
    when = lambda c, code: F.when(c, F.lit(code))
    known = F.array_compact(F.array(
        when(~F.col("valid"), "K03"), when(F.col("rp").isNotNull() & (F.col("rp") != F.col("ip")), "K04"), when(F.col("rdir") != F.col("idir"), "K05"), when(F.col("net_debt_kr") <= 0, "K06"),
        when(F.col("holder") != F.col("id"), "K07"), when(F.col("own"), "K08"), when(F.col("idate") > F.col("rdate"), "K09"), when((F.col("net_debt_kr") > 0) & (F.col("amount_kr") > F.col("net_debt_kr")), "K10"),
    ))
    codes = F.when(F.col("rdir").isNull(), F.array(F.lit("K01"))).when(F.col("idir").isNull(), F.array(F.lit("K02"))).otherwise(known)
    return met.select("id", "no", F.explode(codes).alias("code"))
