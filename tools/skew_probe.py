"""Measure how the dedup plans behave when one (account, month) key holds half of all rows.

    python tools/skew_probe.py [sf_dir]

Input: the account-month rows derived from the test tables plus a copy of every row under one hot
key. Compared: ``latest_by_key`` (partial aggregate before the exchange) and a plain
``repartition(key) + row_number() == 1``. Reported per plan: wall time and, for the stage after
the exchange, the records read by the busiest task versus the median task (from the event log).
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from acct_health.operators.dedup import latest_by_key
    from acct_health.session import get_spark
    from acct_health.sources.fixtures import account_month_from_tables

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-events-", dir=os.environ.get("SKEW_SCRATCH", "/tmp"))
    spark = get_spark("local[8]", 8, extra={"spark.eventLog.enabled": "true",
                                            "spark.eventLog.dir": f"file://{log_dir}",
                                            "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    am = account_month_from_tables(spark, sf_dir)
    hot = am.withColumn("account_id", F.lit("a-hot")).withColumn("month", F.lit(dt.date(1998, 6, 1)))
    data = am.unionByName(hot).repartition(16).persist()
    n = data.count()

    def partial():
        latest_by_key(data, count_col="n").write.format("noop").mode("overwrite").save()

    def naive():
        w = Window.partitionBy("account_id", "month").orderBy(F.col("updated_at").desc_nulls_last())
        (data.repartition("account_id", "month").withColumn("_rn", F.row_number().over(w))
         .where("_rn = 1").drop("_rn").write.format("noop").mode("overwrite").save())

    results = {}
    for name, fn in (("partial_aggregate", partial), ("repartition_row_number", naive)):
        spark.sparkContext.setJobGroup("warm-up", "warm-up")
        fn()
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        fn()
        results[name] = {"wall_sec": round(time.perf_counter() - t0, 3)}
    spark.stop()

    import zstandard
    group_of, reads = {}, {}
    for f in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        fh = open(f, "rb")
        text = (io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
                if f.endswith(".zstd") else io.TextIOWrapper(fh, encoding="utf-8"))
        for line in text:
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                for sid in e["Stage IDs"]:
                    group_of[sid] = (e.get("Properties") or {}).get("spark.jobGroup.id")
            elif e["Event"] == "SparkListenerTaskEnd":
                m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                recs = m.get("Total Records Read", 0) if group_of.get(e["Stage ID"]) in results else 0
                if recs:
                    reads.setdefault(e["Stage ID"], []).append(recs)
    for name in results:
        stages = [s for s, g in group_of.items() if g == name and s in reads]
        # the stage right after the dedup exchange reads the most records
        s = max(stages, key=lambda x: sum(reads[x]))
        r = reads[s]
        results[name].update(max_task_records=max(r), median_task_records=int(statistics.median(r)),
                             shuffled_records=sum(r))
    print(json.dumps({"rows": n, "hot_key_rows": n // 2, **results}))


if __name__ == "__main__":
    main()
