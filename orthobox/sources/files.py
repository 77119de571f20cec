"""Files: delimited points, points split over files, synthetic points, Parquet point stores, and sinks for results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.functions.encoders import encode, tenths
from orthobox.schema import PointSchema

CELLS = 4096  # of a count of ids that reaches the driver


def read_csv(spark: SparkSession, path: str, schema: PointSchema, skip: int = 0, limit: int | None = None, on_overflow: str = "error") -> DataFrame:
    """Points of a headless comma-separated file: an id, which becomes the pk, then the raw attributes in order. Attributes
    whose query bounds are scaled are floats of which ten times is kept, the rest integers. skip and limit go by id."""
    scaled = {a.name for k, a in enumerate(schema.attributes) if k in schema.scaled}
    raw = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(a, T.FloatType() if a in scaled else T.LongType()) for a in schema.names]])
    rows = spark.read.csv(path, schema=raw, mode="FAILFAST")
    if limit is not None:
        rows = rows.orderBy("id").offset(skip).limit(limit)  # a top-k per task, not a global sort
    elif skip:
        rows = _after(rows, skip)
    return encode(rows, schema, {a: tenths(F.col(a)) if a in scaled else F.col(a) for a in schema.names}, pk=F.col("id"), on_overflow=on_overflow)


def _after(rows: DataFrame, skip: int) -> DataFrame:
    """rows without the first `skip` by id, without sorting them: the cut is an id, found by counting cells of ids that get
    smaller by CELLS each time; of the rows with that very id as many go as still have to."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    left = skip
    if low is None or left <= 0:
        return rows
    while low < high:
        width = max(1, -(-(high - low + 1) // CELLS))
        cell = F.floor((F.col("id") - low) / width)
        upto, chosen = 0, None
        for r in rows.where(F.col("id").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect():
            if upto + r["n"] > left:
                chosen = r["cell"]
                break
            upto += r["n"]
        if chosen is None:
            return rows.limit(0)
        left -= upto
        low, high = low + chosen * width, min(high, low + chosen * width + width - 1)
    at = rows.where(F.col("id") == low)
    return rows.where(F.col("id") > low).unionByName(at.offset(left))


def read_split(spark: SparkSession, path: str, schema: PointSchema, on_overflow: str = "error") -> DataFrame:
    """read_csv over a folder of parts; `part` is the file that a point came from."""
    scaled = {a.name for k, a in enumerate(schema.attributes) if k in schema.scaled}
    raw = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(a, T.FloatType() if a in scaled else T.LongType()) for a in schema.names]])
    rows = spark.read.csv(path, schema=raw, mode="FAILFAST").withColumn("part", F.col("_metadata.file_name"))
    return encode(rows, schema, {a: tenths(F.col(a)) if a in scaled else F.col(a) for a in schema.names}, pk=F.col("id"), on_overflow=on_overflow, keep=["part"])


def _uniform(*parts: Column | int | str) -> Column:
    """32 bits from the MD5 of the parts, joined by |; other engines compute the same."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def synthetic(spark: SparkSession, n: int, schema: PointSchema, low: int = 1, high: int = 65536, seed: int = 7) -> DataFrame:
    """n points: the first attribute is the pk, the others uniform in [low, high]; the same for the same seed."""
    first, *rest = schema.names
    value = lambda k: _uniform(seed, k, F.col("id")) % (high - low + 1) + low
    return spark.range(n).select(F.col("id").alias("pk"), F.col("id").alias(first), *[value(k).cast("long").alias(a) for k, a in enumerate(rest)])


def zipf_keys(spark: SparkSession, n: int, keys: int, seed: int = 7) -> DataFrame:
    """(pk): n keys from 1 to `keys`, the k-th about as often as 1 / k."""
    u = _uniform(seed, "zipf", F.col("id")) / float(1 << 32)
    return spark.range(n).select(F.floor(F.pow(F.lit(float(keys + 1)), u)).cast("long").alias("pk"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A store written by operators.layout; partition and file statistics prune what a query can't need."""
    return spark.read.parquet(path)


def write_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """One JSON line."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def write_numbers(numbers: DataFrame, path: str) -> None:
    """A column of numbers, one a line; used for latencies."""
    numbers.select(F.col(numbers.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Counts of found points by query, as CSV."""
    counts.write.mode("overwrite").csv(path, header=True)
