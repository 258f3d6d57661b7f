"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lonja.session import local_session  # noqa: E402

HEADLINE = ["d1_order_costing", "d17_order_totals", "d6_door_to_door", "d15_scenarios", "a4_supplier_comparison", "a5_rollups", "a8_outliers", "j3_upsert", "v4_graded", "x8_search", "st1_status_replay"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    from lonja.plans.everything import QUERIES

    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # compiles and warms the session
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
