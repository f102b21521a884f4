"""Print physical-plan facts for registered queries: exchanges, broadcasts,
sort-merge joins, pushed filters and read schemas.

usage: python tools/plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.plans.registry import queries  # noqa: E402
from ledgerline.session import build_session  # noqa: E402


def facts(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"(?m)^\(\d+\) (?:Exchange|ShuffleQueryStage)", plan)),
        "single_partition": len(re.findall(r"SinglePartition", plan)),
        "broadcasts": len(re.findall(r"(?m)^\(\d+\) (?:BroadcastExchange|BroadcastQueryStage)", plan)),
        "smj": len(re.findall(r"(?m)^\(\d+\) SortMergeJoin", plan)),
        "bucketed_scans": len(re.findall(r"Bucketed: true", plan)),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))[:3],
        "read_schema": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))[:3],
    }


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    qs = queries()
    for n in names:
        df = qs[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString() if os.environ.get("RAW") else \
            df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        print(f"== {n}: {facts(plan)}")
        if os.environ.get("SHOW"):
            print(plan)
    spark.stop()


if __name__ == "__main__":
    main()
