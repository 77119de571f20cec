"""Lookups by primary key and membership tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthobox.schema import PointSchema


def lookup(points: DataFrame, pk: int, schema: PointSchema, policy: str = "all", sequence: str | None = None, n_shards: int | None = None) -> DataFrame:
    """(pk, attributes) stored under a key; none if it is unknown. policy: "all", or "latest" by the `sequence` column. With
    n_shards the shard is tested too, which prunes the partitions of a store written by shard."""
    found = points.where(F.col("pk") == F.lit(pk).cast("long"))
    if n_shards is not None and "shard" in points.columns:
        found = found.where(F.col("shard") == pk % n_shards)
    return latest(found, sequence).select("pk", *schema.names) if policy == "latest" else found.select("pk", *schema.names)


def lookup_many(points: DataFrame, keys: DataFrame, schema: PointSchema) -> DataFrame:
    """(pk, attributes) for every row of keys(pk); the planner broadcasts keys if they are few."""
    return keys.select("pk").join(points.select("pk", *schema.names), "pk")


def latest(points: DataFrame, sequence: str) -> DataFrame:
    """Of the rows with one key the one inserted last; of equal sequence numbers the row that is greatest, column by column."""
    last = Window.partitionBy("pk").orderBy(F.desc(sequence), *[F.desc(c) for c in sorted(points.columns) if c not in ("pk", sequence)])
    return points.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def check(points: DataFrame, point: dict[str, int], schema: PointSchema) -> bool:
    """Whether a point with exactly these attributes is stored; the scan stops at the first."""
    found = points
    for a in schema.names:
        found = found.where(F.col(a) == F.lit(point[a]).cast("long"))
    return not found.select(F.lit(1)).limit(1).isEmpty()


def check_many(points: DataFrame, wanted: DataFrame, schema: PointSchema, present: bool = True) -> DataFrame:
    """Rows of wanted whose attributes are stored, or with present=False those whose attributes are not."""
    return wanted.join(points.select(schema.names), schema.names, "left_semi" if present else "left_anti")
