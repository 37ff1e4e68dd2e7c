"""Print the physical plan shape of the main operators (after execution, AQE final plans).

    python tools/plans.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Scan parquet|PushedFilters|PartitionFilters|ReadSchema|Exchange|HashAggregate|SortAggregate|"
                  r"ObjectHashAggregate|WindowGroupLimit|Window |BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                  r"BroadcastExchange|MapInPandas|Generate|Expand|Union|AQEShuffleRead)")


def shape(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in text.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line[:160].rstrip())
            if "FileScan" in line:
                indent = " " * (len(line) - len(line.lstrip()) + 3)
                for tag in ("PartitionFilters", "PushedFilters", "ReadSchema"):
                    m = re.search(tag + r": (\[[^\]]*\]|struct<\S*)", line)
                    if m:
                        out.append(f"{indent}{tag}: {m.group(1)[:200]}")
    return out


def main():
    from acct_health.operators.dedup import latest_by_key
    from acct_health.operators.streak import streaks_all
    from acct_health.params import Params
    from acct_health.plans.alerts import backfill_alerts, preview
    from acct_health.plans.registry import QUERIES
    from acct_health.session import get_spark, scratch_path
    from acct_health.sources.account_month import read_account_month, write_account_month
    from acct_health.sources.fixtures import LOOKBACK, TARGET_MONTH, account_month_from_tables

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    table = scratch_path(spark, "plans-am")
    write_account_month(account_month_from_tables(spark, sf_dir), table)
    am = read_account_month(spark, table)
    alerts, counts = preview(spark, am, TARGET_MONTH, Params())
    cases = {
        "preview alerts (month-partitioned table)": alerts,
        "preview counts": counts,
        "streaks_all over full history": streaks_all(latest_by_key(am), LOOKBACK),
        "backfill_alerts (every month in one pass)": backfill_alerts(spark, am, Params()),
    }
    for name in ("status_samples", "resolve_attempts", "outcomes_current", "decisions", "deliver_replay",
                 "unknown_region_digest"):
        cases[f"registered: {name}"] = QUERIES[name](spark, sf_dir)
    print(f"# Physical plan shapes ({os.path.basename(sf_dir)}, local[8], AQE final plans)\n")
    print("Generated by `python tools/plans.py`. Operators only; read bottom-up within each block.\n")
    for name, df in cases.items():
        print(f"## {name}\n\n```")
        print("\n".join(shape(df)))
        print("```\n")


if __name__ == "__main__":
    main()
