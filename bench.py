"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: the median of three runs of each query, after one that isn't counted."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from hypersurf.plans import registry

NAMES = [
    "edge_test", "edge_test_n4", "free_edges", "coverage_histogram", "coverage_prune", "vertex_codes", "link_class", "priority_edges", "extend_closed", "extend_boundary", "vertex_signature",
    "canonical_label", "keep_first", "insert_if_absent", "combinadic_rank", "enumerate_closed_n3", "enumerate_closed_n4", "log_levels",
]
RUNS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, first = {}, {}
    for name in NAMES:
        times = []
        for _ in range(1 if name.startswith("enumerate") else 1 + RUNS):
            began = time.time()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name], first[name] = round(median(times[1:] or times), 3), round(times[0], 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
