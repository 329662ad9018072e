"""Streams against the same rows in one batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyspark.streaming import balances, ingest

SCHEMA = "account long, seq long, at timestamp, amount_kr long"


def files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_balances_of_shuffled_batches(spark, tmp_path):
    """Movements in any order within an hour, some of them twice, a third of them of one account; the last one only moves the watermark."""
    rnd = random.Random(9)
    start, rows, seq = datetime(2026, 1, 1), [], {}
    for i in range(600):
        account = 1 if rnd.random() < 0.4 else rnd.randrange(2, 12)
        seq[account] = seq.get(account, 0) + 1
        rows.append((account, seq[account], start + timedelta(minutes=i), rnd.randrange(-50, 50)))
    batches = []
    for lo in range(0, 600, 100):
        part = rows[lo : lo + 100] + rnd.sample(rows[max(0, lo - 30) : lo + 100], 15)
        late = [r for r in rows[max(0, lo - 20) : lo]]
        batches.append(rnd.sample(part + late, len(part) + len(late)))
    batches.append([(99, 1, start + timedelta(days=9), 0)])
    out, name = tmp_path / "out", f"file://{tmp_path}"
    for batch in batches:  # a file, a batch; the query goes on from its checkpoint
        files(spark, name, [batch], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{name}/in")
        q = balances.running_balances(stream, "2 hours").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{name}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.account, r.seq): (r.amount_kr, r.balance_kr) for r in spark.read.parquet(str(out)).collect()}
    want, sums = {}, {}
    for account, s, _, amount in rows:
        sums[account] = sums.get(account, 0) + amount
        want[account, s] = (amount, sums[account])
    assert got == want and spark.read.parquet(str(out)).count() == len(want)


def test_hourly_volume(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1, 1, m), 2.0) for m in (0, 30, 59)] + [("b", datetime(2026, 1, 1, 2, 0), 1.0), ("a", datetime(2026, 1, 1, 9, 0), 7.0)]
    schema, name = "event_type string, ts timestamp, value double", f"file://{tmp_path}"
    files(spark, name, [rows], schema)
    out = ingest.hourly_volume(spark.readStream.schema(schema).parquet(f"{name}/in"))
    q = out.writeStream.format("memory").queryName("volume").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.hour, r.event_type): (r.n, r.value) for r in spark.table("volume").select(F.hour("window.start").alias("hour"), "event_type", "n", "value").collect()}
    assert got == {(1, "a"): (3, 6.0), (2, "b"): (1, 1.0), (9, "a"): (1, 7.0)}
