"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query runs once to
load classes and once for the clock; results are computed in full and not collected. Deriving the
sheet rows from the driver's tables is timed on its own, as stage_rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowgate.session import local_session  # noqa: E402
from suite import fixture  # noqa: E402
from suite.queries import HEADLINE, QUERIES  # noqa: E402


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "rowgate-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def compute(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    seconds = {"stage_rows": timed(lambda: fixture.raw_rows(spark, sf_dir))}
    for name in names:
        compute(QUERIES[name](spark, sf_dir))
        seconds[name] = timed(lambda: compute(QUERIES[name](spark, sf_dir)))
    rows = fixture.raw_rows(spark, sf_dir).count()
    total = round(sum(v for k, v in seconds.items() if k != "stage_rows"), 3)
    result = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "sheet_rows": rows,
        "rows_per_sec": {k: round(rows / v) for k, v in seconds.items() if v},
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
