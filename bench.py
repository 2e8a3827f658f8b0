"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

from wxlake.operators import reports  # noqa: E402
from wxlake.plans import render  # noqa: E402
from wxlake.plans.queries import QUERIES  # noqa: E402
from wxlake.session import local  # noqa: E402

HEADLINES = ("active_at", "timeline_status", "lead_time", "family_histogram", "import_actions")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"))
    took: dict[str, float] = {}

    def timed(name: str, query) -> None:
        start = time.time()  # queries write what they read twice as they are built, so building counts
        query().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)

    timed("warm_up", lambda: QUERIES["family_histogram"](spark, sf))
    texts = render.messages(spark, sf).cache()
    n = texts.count()
    timed("parse", lambda: reports.parsed(texts))
    texts.unpersist()
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, sf))
    total = sum(v for k, v in took.items() if k != "warm_up")
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "messages": n, "parsed_per_second": round(n / took["parse"])}))
    spark.stop()


if __name__ == "__main__":
    main()
