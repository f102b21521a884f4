"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "total_query_seconds", "value": N, "unit": "sec",
   "queries": {"name": sec, ...}, "sf": ..., ...}

Each query is executed completely with the ``noop`` sink (no driver
collection).  ``panel_build`` is the one-off ETL from line items to the
ticker-bucketed standard table that the analyses read; ``etl_panel`` re-runs
that ETL lazily from raw as a query of its own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from ledgerline.session import build_session
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if not os.environ.get("SPARK_CHECKPOINT_DIR_SET"):
        extra["spark.eventLog.enabled"] = "false"
    spark = build_session(f"local[{cpus}]", app="ledgerline-bench",
                          shuffle_partitions=max(8, cpus * 2), extra=extra)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerline-bench-"))

    from ledgerline.plans.registry import queries
    from ledgerline.sources.panel import panel, standard_table

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    run(standard_table(spark, sf_dir))
    run(panel(spark, sf_dir))
    timings["panel_build"] = round(time.perf_counter() - t0, 3)

    qs = queries()
    names = [n for n in qs if not only or any(re.fullmatch(p, n) for p in only)]
    errors = {}
    for name in names:
        t = time.perf_counter()
        try:
            run(qs[name](spark, sf_dir))
            timings[name] = round(time.perf_counter() - t, 3)
        except Exception as e:  # report, keep going
            errors[name] = str(e).splitlines()[0][:200]
    total = round(sum(v for k, v in timings.items()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": total, "unit": "sec",
           "queries": timings, "sf": float(sf.group(1)) if sf else sf_dir,
           "n_queries": len(timings) - 1, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
