"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main():
    from tallyveil.plans import bench_queries
    from tallyveil.session import build_session

    spark = build_session("bench", CPUS)
    only = sys.argv[1:]
    times = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the clock
    for name, run in bench_queries.QUERIES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, SF_DIR)
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
