"""Inserts by Structured Streaming, and workloads that mix them with queries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from orthobox.functions.morton import with_key, word_names
from orthobox.operators.layout import append, fitted, write_clustered
from orthobox.operators.lookup import lookup_many
from orthobox.operators.search import batch_counts
from orthobox.plans.box import BoxQuery, random_boxes
from orthobox.queries_util import delete, scratch
from orthobox.schema import PointSchema


def start_ingest(stream: DataFrame, encoder: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, schema: PointSchema, files: int = 8, once: bool = False) -> StreamingQuery:
    """Appends a stream of raw rows to a store. Each micro-batch is sorted by key and written to a folder of its own, batch=<id>,
    which a retry overwrites: every row is stored exactly once. layout.compact clusters the batches' files anew. seq = batch id serves lookups of the latest row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        points = with_key(encoder(batch), schema).withColumn("seq", F.lit(batch_id).cast("long"))
        names = word_names(schema)
        points.repartitionByRange(files, *names).sortWithinPartitions(*names).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


KINDS = ("insert", "lookup", "search")


def plan_mixed(schema: PointSchema, weights: tuple[int, int, int], operations: int, seed: int, rounds: int, max_pk: int) -> list[tuple[int, list[int], list[BoxQuery]]]:
    """For each round how many points are inserted, the keys that are looked up and the boxes that are searched."""
    rng, out = random.Random(seed), []
    for r in range(rounds):
        kinds = rng.choices(KINDS, weights, k=operations * (r + 1) // rounds - operations * r // rounds)
        n = {k: kinds.count(k) for k in KINDS}
        out.append((n["insert"], [rng.randint(0, max_pk) for _ in range(n["lookup"])], random_boxes(schema, n["search"], rng.randint(0, 1 << 30))))
    return out


def run_mixed(spark: SparkSession, points: DataFrame, arriving: DataFrame, schema: PointSchema, weights: tuple[int, int, int] = (5, 95, 0), operations: int = 100, seed: int = 3, rounds: int = 4, max_pk: int | None = None, path: str | None = None) -> dict:
    """A workload of inserts, lookups and searches drawn with these weights, in rounds. A store is written from points; a
    round's inserts are appended to it as files of their own, then its lookups and searches read the store as it is, each
    kind in one batch. arriving(pk, attributes) supplies the inserted points, in order of pk. The schema is that of the plan; the
    store's is wide enough for all points. Returns operations, rows and seconds by kind; rows of inserts are what the store has
    gained."""
    path, names = path or scratch(spark), ["pk", *schema.names]
    top = max_pk if max_pk is not None else points.agg(F.max("pk")).first()[0] or 0
    plan = plan_mixed(schema, weights, operations, seed, rounds, top)
    # As many arriving points as the plan inserts, numbered: no more rows than operations.
    pool = arriving.select(names).orderBy("pk").limit(sum(p[0] for p in plan))
    staged = scratch(spark)
    pool.withColumn("nth", F.row_number().over(Window.orderBy("pk"))).write.parquet(staged)
    pool = spark.read.parquet(staged)
    wide = fitted(pool, fitted(points, schema))
    write_clustered(points.select(names), path, wide, 4)
    inserted, size = 0, spark.read.parquet(path).count()
    out = {k: {"operations": 0, "rows": 0, "seconds": 0.0} for k in KINDS}
    for n, keys, boxes in plan:

        def insert() -> int:
            nonlocal size
            before = size
            append(pool.where(F.col("nth").between(inserted + 1, inserted + n)).select(names), path, wide)  # noqa: B023
            size = spark.read.parquet(path).count()
            return size - before

        store = lambda: spark.read.parquet(path).select(names)
        done = {
            "insert": (n, insert),
            "lookup": (len(keys), lambda: lookup_many(store(), spark.createDataFrame([(k,) for k in keys], "pk long"), schema).count()),  # noqa: B023
            "search": (len(boxes), lambda: batch_counts(store(), boxes, schema).agg(F.sum("found")).first()[0] or 0),  # noqa: B023
        }
        for kind, (count, run) in done.items():
            if count:
                began = time.perf_counter()
                out[kind]["rows"] += run()
                out[kind]["seconds"] += time.perf_counter() - began
                out[kind]["operations"] += count
        inserted += n
    delete(spark, staged)
    return out
