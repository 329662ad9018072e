"""Times headline queries: cold once, then the median of warm runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

QUERIES = ["trial_balance", "general_ledger", "rollup_hierarchy", "income_statement", "monthly_comparison", "vat_return", "fifo_allocation", "full_allocation", "instalment_match", "unexpected_contra", "voucher_numbering", "worksheet"]
WARM = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyspark.plans.registry import QUERIES as known
    from tallyspark.sources.model import view

    t = time.time()
    rows = view(spark, sf_dir, "journal").count()
    build = time.time() - t
    warm, cold = {}, {}
    for name in QUERIES:
        times = []
        for _ in range(1 + WARM):
            t = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(round(time.time() - t, 3))
        cold[name], warm[name] = times[0], round(statistics.median(times[1:]), 3)
    warm["full_allocation"] = cold["full_allocation"]  # later runs read what the first one wrote
    warm["journal_build"] = round(build, 3)
    print(json.dumps({"metric": "sum of warm medians, with the builds of journal and allocation", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "journal_rows": rows, "journal_build_sec": round(build, 2), "cores": int(cpus), "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
