"""Timed workloads from the command line, one JSON line each:

python -m orthobox.cli SCHEMA DATA STORE WORKLOAD [--operations N] [--corpus FILE] [--metrics FOLDER]

SCHEMA is a preset. DATA is a folder of headless delimited files in that preset's order, or of this repository's tables for
lineitem7, orders4 and events5. STORE is the folder of the clustered store that `insert` writes and the others read.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.operators.layout import storage_report
from orthobox.plans.box import BoxQuery, random_boxes, read_corpus
from orthobox.plans.workload import load, lookups, searches
from orthobox.schema import PRESETS, PointSchema
from orthobox.sources import tables
from orthobox.sources.files import read_csv, write_metrics, zipf_keys
from orthobox.streaming.ingest import run_mixed

TABLES = {"lineitem7": tables.lineitem7, "orders4": tables.orders4, "events5": tables.events5}
# Shares of inserts, lookups and searches.
MIXES = {"mixed_lookup": (5, 95, 0), "mixed_search": (1, 0, 20), "mixed_insert": (9, 0, 1)}
WORKLOADS = ["insert", "storage", "lookup", "zipf", "latency", "throughput", *MIXES]


def points_of(spark: SparkSession, schema: PointSchema, data: str) -> DataFrame:
    points = TABLES[schema.name](spark, data) if schema.name in TABLES else read_csv(spark, data, schema)
    return points if "pk" in points.columns else points.withColumn("pk", F.xxhash64(*schema.names))


def run(spark: SparkSession, schema: PointSchema, data: str, store: str, workload: str, operations: int = 1000, corpus: str | None = None) -> dict:
    if workload == "insert":
        files = max(1, spark.sparkContext.defaultParallelism)
        return load(points_of(spark, schema, data), store, schema, files)
    if workload in MIXES:
        points = points_of(spark, schema, data)
        return run_mixed(spark, points.where("pmod(pk, 10) != 0"), points.where("pmod(pk, 10) = 0"), schema, MIXES[workload], operations)
    if workload == "storage":
        return storage_report(spark, store).first().asDict()
    points = spark.read.parquet(store)
    if workload == "lookup":
        return lookups(points, schema, range(operations))
    if workload == "zipf":
        return lookups(points, schema, zipf_keys(spark, operations, int(points.agg(F.max("pk")).first()[0] or 1)))
    boxes: list[BoxQuery] = read_corpus(spark, corpus, schema) if corpus else random_boxes(schema, operations)
    return searches(points, boxes[:operations], schema, serial=workload == "latency")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orthobox", description=__doc__)
    parser.add_argument("schema", choices=sorted(PRESETS))
    parser.add_argument("data")
    parser.add_argument("store")
    parser.add_argument("workload", choices=WORKLOADS)
    parser.add_argument("--operations", type=int, default=1000)
    parser.add_argument("--corpus", help="a file of query lines; random boxes if left out")
    parser.add_argument("--metrics", help="a folder that the JSON line is appended to")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("orthobox").getOrCreate()
    out = {"schema": a.schema, "workload": a.workload, **run(spark, PRESETS[a.schema], a.data, a.store, a.workload, a.operations, a.corpus)}
    print(json.dumps(out, sort_keys=True))
    if a.metrics:
        write_metrics(spark, a.metrics, out)


if __name__ == "__main__":
    main()
