"""Helpers that several operators share: the cluster's shared folder, row numbering, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to workers carry their code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules["orthobox.llm"])

WORD_GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, a temporary folder of this machine in local mode (tests),
    and an error on a cluster, whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="orthobox-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orthobox-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored()."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, near the wanted one."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b) by alternating large-star and small-star steps.

    Returns (node, component) for every node that has a link, component being its smallest reachable node. A hub is never
    gathered: each step is a min per node and a join that AQE may split. Every round is written to the shared folder. It ends
    when the edges are a star forest: no node has both a larger and a smaller neighbour, or two smaller ones. Empty links give
    no rows; loops and repeated links are harmless.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"))
        if least.where("m < u and (top > u or below > m)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("component")).distinct().withColumnRenamed("v", "node"))
        large = both.where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = stored(large.join(least, "u").select(ends.alias("e")).select("e.*").where("u != v").distinct())
        discard(edges)
        edges = new


MAX_BROADCAST_KEYS = 250_000  # of some 40 bytes


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df that match no row of keys on keys' columns (null matches null). keys are broadcast if they are few enough,
    so that wide rows of df stay where they are; else both sides are shuffled."""
    k = keys.distinct().select([F.col(c).alias(f"_k{i}") for i, c in enumerate(keys.columns)])
    same = [df[c].eqNullSafe(k[f"_k{i}"]) for i, c in enumerate(keys.columns)]
    return df.join(F.broadcast(k) if keys.count() <= MAX_BROADCAST_KEYS else k, same, "left_anti")
