"""Times the headline queries, each from the tables with nothing cached.

Prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores;
arguments choose queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

import registry

HEADLINE = (
    "entities", "observed_edges", "incidence", "fanout_guard", "inferred_edges", "components", "density",
    "cluster_aggregate", "scored_clusters", "account_baseline", "confusion", "timeline", "subgraph_nodes",
    "overview", "louvain", "injection_rule_counts", "pii_mask",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.sql.files.maxPartitionBytes", "4m")  # few row groups: keep all cores busy
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.build()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        registry.forget(spark)
        began = time.time()
        # every column of every row is produced, none reaches the driver
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    run(names[0])  # start the JVM's compilers
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, cold",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
