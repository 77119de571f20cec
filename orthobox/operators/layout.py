"""Stores of points: clustered Parquet, shards, appends, compaction, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions.encoders import checked
from orthobox.functions.morton import prefix, with_key, word_names
from orthobox.plans.box import BoxQuery
from orthobox.queries_util import delete, scratch
from orthobox.schema import PointSchema


def with_shard(points: DataFrame, n_shards: int) -> DataFrame:
    """shard = pk modulo n_shards."""
    return points.withColumn("shard", F.pmod("pk", F.lit(n_shards)).cast("int"))


def fitted(points: DataFrame, schema: PointSchema) -> PointSchema:
    """The schema, wide enough for all points: attributes whose values outgrow their bits get more. One pass over the attributes."""
    most = points.agg(*[F.max(a).alias(a) for a in schema.names]).first().asDict()
    return schema.holding({a: max(0, v) for a, v in most.items() if v is not None})


def write_clustered(points: DataFrame, path: str, schema: PointSchema, files: int, mode: str = "overwrite", rows_per_file: int = 0, by_shard: bool = False) -> None:
    """Writes points with their key, range-partitioned and sorted by it, so that the statistics of files and row groups
    bound every attribute. The pk gets a bloom filter, as the key's order says nothing about it."""
    spark, names = points.sparkSession, word_names(schema)
    # Range partitioning reads its input twice, first for a sample: the points and their keys are computed once, into a folder.
    staged = scratch(spark)
    with_key(checked(points, schema), schema).write.parquet(staged)
    keyed = spark.read.parquet(staged)
    by = (["shard"] if by_shard else []) + names
    writer = keyed.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if "pk" in points.columns:
        writer = writer.option("parquet.bloom.filter.enabled#pk", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer.partitionBy("shard") if by_shard else writer).parquet(path)
    delete(spark, staged)


def append(points: DataFrame, path: str, schema: PointSchema, files: int = 1) -> None:
    """Inserts: more files, each clustered in itself. Points already stored stay, also under an equal pk."""
    write_clustered(points, path, schema, files, mode="append")


def compact(spark: SparkSession, source: str, target: str, schema: PointSchema, files: int) -> None:
    """Clusters a store anew into another folder, undoing the overlap that appends leave."""
    store = spark.read.parquet(source)
    write_clustered(store.drop(*word_names(schema)), target, schema, files, by_shard="shard" in store.columns)


def storage_report(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, rows) of a store; file sizes come from listing, rows from footers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    sizes = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return sizes.withColumn("rows", F.lit(spark.read.parquet(path).count()).cast("long"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) of each file of a store: sizes from listing, rows from one column's scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = spark.read.parquet(path).groupBy(name(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("rows"))
    return files.select(name(F.col("path")).alias("file"), F.col("length").alias("bytes")).join(rows, "file", "left").fillna(0, ["rows"])


def shard_counts(points: DataFrame, n_shards: int) -> DataFrame:
    return with_shard(points, n_shards).groupBy("shard").agg(F.count("*").alias("n"))


def file_ranges(spark: SparkSession, path: str, schema: PointSchema) -> DataFrame:
    """(file, n, <attribute>_lo, <attribute>_hi)."""
    store = spark.read.parquet(path).select(*schema.names, F.col("_metadata.file_path").alias("file"))
    return store.groupBy("file").agg(F.count("*").alias("n"), *[f(a).alias(f"{a}_{e}") for a in schema.names for f, e in ((F.min, "lo"), (F.max, "hi"))])


def meets(box: BoxQuery) -> Column:
    """Whether a file's ranges meet the box; statistics let a scan skip it if not."""
    out = [F.lit(True)]
    for a, (lo, hi) in box.bounds.items():
        out += ([F.col(f"{a}_hi") >= lo] if lo is not None else []) + ([F.col(f"{a}_lo") <= hi] if hi is not None else [])
    return reduce(lambda x, y: x & y, out)


def files_met(ranges: DataFrame, box: BoxQuery) -> int:
    """How many files' ranges meet the box."""
    return ranges.where(meets(box)).count()


def level_nodes(points: DataFrame, schema: PointSchema, levels: list[int] | None = None) -> DataFrame:
    """(level, nodes, collapsed): non-empty cells of each level, and how many of them hold points of a single cell of the
    next level. Points that agree on all attributes count once."""
    levels = list(range(schema.depth)) if levels is None else levels
    # From the finest cells up: a level's cells are grouped from those of the level below, of which there are never more, and
    # a level without bits of its own has the same ones.
    out, cells, at = None, points.select(schema.names).distinct(), schema.depth - 1
    for level in sorted(set(levels), reverse=True):
        below = min(level + 1, schema.depth - 1)
        if below < at:
            cells, at = _coarser(cells, schema, at, below), below
        children = _coarser(cells, schema, at, level, count=True)
        one = children.agg(F.lit(level).alias("level"), F.count("*").alias("nodes"), F.count_if(F.col("children") == 1).alias("collapsed")).where("nodes > 0")
        out = one if out is None else out.unionByName(one)
    return out


def _coarser(cells: DataFrame, schema: PointSchema, of: int, to: int, count: bool = False) -> DataFrame:
    """The cells of a level from those of a finer one, whose columns hold what that level keeps of each attribute."""
    fine, kept = schema.prefix_bits(of), schema.prefix_bits(to)
    cut = [F.shiftright(F.col(a), fine[a] - kept[a]).alias(a) for a in schema.names]
    grouped = cells.select(*cut).groupBy(*schema.names)
    return grouped.agg(F.count("*").alias("children")) if count else grouped.agg(F.lit(1).alias("one")).drop("one")


def multiplicities(points: DataFrame, names: list[str]) -> DataFrame:
    """(copies, n): how many different points are stored how often."""
    return points.groupBy(*names).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n"))


def key_lists(points: DataFrame, names: list[str]) -> DataFrame:
    """The sorted keys stored under each different point. A list is as long as its point has copies; a report, not a step of
    other operators."""
    return points.groupBy(*names).agg(F.array_sort(F.collect_list("pk")).alias("pks"))


def attribute_bounds(points: DataFrame, schema: PointSchema) -> DataFrame:
    """(attribute, low, high, bits): what each attribute needs, for choosing a schema."""
    row = points.agg(*[F.struct(F.lit(a).alias("attribute"), F.min(a).alias("low"), F.max(a).alias("high")).alias(a) for a in schema.names])
    each = row.select(F.explode(F.array(*schema.names)).alias("x")).select("x.*")
    return each.withColumn("bits", F.when(F.col("high") == 0, F.lit(1)).otherwise(F.length(F.bin("high"))).cast("long"))
