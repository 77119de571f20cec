"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from orthobox.functions import morton
from orthobox.operators import layout, lookup, search
from orthobox.plans.box import LINEITEM_LINES, BoxQuery, random_boxes
from orthobox.schema import LINEITEM7, ORDERS4
from orthobox.sources import tables

RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from orthobox.queries_util import scratch

    stores = {"lineitem7": scratch(spark), "orders4": scratch(spark)}
    boxes = [BoxQuery.parse(line, LINEITEM7) for line in LINEITEM_LINES]
    many = random_boxes(ORDERS4, 1000, seed=1)
    box = lambda k: search.range_search(spark.read.parquet(stores["lineitem7"]), boxes[k])
    orders = lambda: spark.read.parquet(stores["orders4"])
    runs = {
        "load_lineitem": lambda: layout.write_clustered(tables.lineitem7(spark, sf), stores["lineitem7"], LINEITEM7, 16),
        "load_orders": lambda: layout.write_clustered(tables.orders4(spark, sf), stores["orders4"], ORDERS4, 8),
        "box_q1": lambda: box(0).count(),
        "box_q4": lambda: box(3).count(),
        "box_unclustered_q4": lambda: search.range_search(tables.lineitem7(spark, sf, boxes[3]), boxes[3]).count(),
        "box_batch_10": lambda: search.batch_counts(spark.read.parquet(stores["lineitem7"]), boxes, LINEITEM7).collect(),
        "box_batch_1000": lambda: search.batch_counts(orders(), many, ORDERS4).collect(),
        "lookup_one": lambda: lookup.lookup(orders(), 42, ORDERS4).collect(),
        "lookup_1000": lambda: lookup.lookup_many(orders(), spark.range(1000).withColumnRenamed("id", "pk"), ORDERS4).count(),
        "check_all": lambda: lookup.check_many(orders(), tables.orders4(spark, sf), ORDERS4).count(),
        "morton_words": lambda: morton.with_key(tables.lineitem7(spark, sf), LINEITEM7).write.format("noop").mode("overwrite").save(),
        "level_nodes": lambda: layout.level_nodes(orders(), ORDERS4, [0, 7, 15, 25]).collect(),
    }
    took = {}
    for name, run in runs.items():
        each = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total of the headline queries' medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
