"""Timed workloads over a store: loads, lookups, searches, sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthobox.operators.layout import file_ranges, files_met, storage_report, write_clustered
from orthobox.operators.lookup import lookup_many
from orthobox.operators.search import batch_counts, range_search
from orthobox.plans.box import BoxQuery, random_boxes
from orthobox.schema import PointSchema


def timed(run: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    out = run()
    return time.perf_counter() - began, out


def load(points: DataFrame, path: str, schema: PointSchema, files: int) -> dict:
    seconds, _ = timed(lambda: write_clustered(points, path, schema, files))
    report = storage_report(points.sparkSession, path).first().asDict()
    return {"seconds": seconds, "rows_per_second": report["rows"] / max(seconds, 1e-9), **report}


def lookups(points: DataFrame, schema: PointSchema, keys: range | DataFrame) -> dict:
    """Keys, a range or a table (pk), looked up in one join."""
    frame = points.sparkSession.range(keys.start, keys.stop, keys.step).withColumnRenamed("id", "pk") if isinstance(keys, range) else keys
    seconds, n = timed(lambda: lookup_many(points, frame, schema).count())
    return {"seconds": seconds, "operations": frame.count(), "rows": n}


def searches(points: DataFrame, boxes: list[BoxQuery], schema: PointSchema, serial: bool = False) -> dict:
    """Boxes in one pass, or one after the other with each one's latency."""
    if not serial:
        seconds, rows = timed(lambda: batch_counts(points, boxes, schema).collect())
        return {"seconds": seconds, "operations": len(boxes), "rows": sum(r["found"] for r in rows)}
    each = [timed(lambda b=b: range_search(points, b).count()) for b in boxes]
    return {"seconds": sum(s for s, _ in each), "operations": len(boxes), "rows": sum(n for _, n in each), "latencies": [s for s, _ in each]}


def dimension_sweep(points: DataFrame, schema: PointSchema, n_boxes: int = 50, seed: int = 1) -> dict[int, dict]:
    """The same number of random boxes over the first 4, 5, ... attributes."""
    out = {}
    for dims in range(min(4, len(schema.attributes)), len(schema.attributes) + 1):
        part = schema.truncate(dims)
        out[dims] = searches(points.select(part.names), random_boxes(part, n_boxes, seed), part)
    return out


def file_size_sweep(spark: SparkSession, points: DataFrame, schema: PointSchema, boxes: list[BoxQuery], path: str, counts: tuple[int, ...] = (4, 16, 64)) -> dict[int, float]:
    """Files -> the mean share of them that a box's ranges meet."""
    out = {}
    for n in counts:
        write_clustered(points, f"{path}/{n}", schema, n)
        ranges = file_ranges(spark, f"{path}/{n}", schema).cache()
        total = ranges.count()
        out[n] = sum(files_met(ranges, b) for b in boxes) / max(1, len(boxes) * total)
        ranges.unpersist()
    return out
