"""Box search, one box at a time or thousands in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.functions.morton import word_names, words
from orthobox.plans.box import BoxQuery
from orthobox.schema import PointSchema

#: Rows of the box table (boxes times buckets that they touch) up to which it is broadcast: some 20 MB at fifteen attributes.
MAX_BROADCAST_BOXES = 100_000
BUCKETS = 64


def range_search(points: DataFrame, box: BoxQuery, open_bounds: str = "unbounded", mode: str = "attributes", order: str | None = None) -> DataFrame:
    """Points in the box, each as often as it is stored. open_bounds: "unbounded", or "profile" for the schema's own bounds.
    mode: "attributes", or "rows" for all columns. order: None, or "morton" for the order of the key.

    If points carry the key (z0, ...), ranges of it are tested too, which lets a clustered store skip files."""
    if open_bounds == "profile":
        box = box.with_profile_bounds()
    elif open_bounds != "unbounded":
        raise ValueError(f"unknown open_bounds {open_bounds}")
    found = points.where(box.predicate())
    if "z0" in points.columns and box.bounds:
        found = found.where(box.key_predicate())
    if order == "morton":
        found = found.orderBy(*words(box.schema))
    elif order is not None:
        raise ValueError(f"unknown order {order}")
    return found if mode == "rows" else found.select(box.schema.names)


def first_in_order(points: DataFrame, schema: PointSchema, k: int) -> DataFrame:
    """The first k points in the order of the key, with the key: a top-k per task and a merge of those."""
    named = points.select(*schema.names, *[w.alias(n) for n, w in zip(word_names(schema), words(schema))])
    return named.orderBy(*word_names(schema)).limit(k)


def boxes_frame(spark: SparkSession, boxes: list[BoxQuery], schema: PointSchema) -> DataFrame:
    """(qid, <attribute>_lo, <attribute>_hi); open bounds are null."""
    rows = [(qid, *[v for a in schema.names for v in box.bounds.get(a, (None, None))]) for qid, box in enumerate(boxes)]
    return spark.createDataFrame(rows, boxes_schema(schema))


def boxes_schema(schema: PointSchema) -> T.StructType:
    return T.StructType([T.StructField("qid", T.LongType(), False), *[T.StructField(f"{a}_{e}", T.LongType()) for a in schema.names for e in ("lo", "hi")]])


def boxes_of_corpus(corpus: DataFrame, schema: PointSchema) -> DataFrame:
    """The boxes table of corpus(qid, attribute, low, high), as plans.box.corpus_frame reads it: attribute numbers and raw
    units become names and stored units. A box whose attributes the schema lacks has no bounds."""
    out = []
    numbers = {a.name: [n for n in range(64) if schema.numbered(n) is a] for a in schema.attributes}
    for a in schema.attributes:
        own = F.col("attribute").isin(numbers[a.name])
        factor = F.when(F.col("attribute").isin([n for n in numbers[a.name] if n in schema.scaled] or [-1]), 10).otherwise(1)
        out += [F.max(F.when(own, F.col(c) * factor - a.offset)).cast("long").alias(f"{a.name}_{e}") for c, e in (("low", "lo"), ("high", "hi"))]
    return corpus.groupBy(F.col("qid").cast("long").alias("qid")).agg(*out)


def _bucket_attribute(table: DataFrame, schema: PointSchema) -> tuple[str, int, int, int]:
    """The attribute on which buckets tell boxes apart best, the span of its two-sided bounds, and the number of boxes."""
    both = {a: F.col(f"{a}_lo").isNotNull() & F.col(f"{a}_hi").isNotNull() for a in schema.names}
    wide = lambda a: F.greatest(F.lit(0), F.col(f"{a}_hi") - F.col(f"{a}_lo") + 1).cast("double")
    stats = [F.struct(F.count_if(both[a]).alias("n"), F.min(F.when(both[a], F.col(f"{a}_lo"))).alias("lo"), F.max(F.when(both[a], F.col(f"{a}_hi"))).alias("hi"), F.sum(F.when(both[a], wide(a))).alias("width")).alias(a) for a in schema.names]
    row = table.agg(F.count("*").alias("boxes"), *stats).first()
    n, best = row["boxes"], (2.0, schema.names[0], 0, schema.attributes[0].largest)
    for a in schema.names:
        s = row[a]
        if s["n"]:
            span = max(1, s["hi"] - s["lo"] + 1)
            best = min(best, ((s["width"] / span + n - s["n"]) / n, a, s["lo"], s["hi"]))
    return *best[1:], n


def batch_search(points: DataFrame, boxes: list[BoxQuery] | DataFrame, schema: PointSchema) -> DataFrame:
    """(qid, attributes) of every point in every box, qid being the box's place in the list. boxes: a list, or a table as
    boxes_frame makes it, of any size.

    One attribute is cut into buckets; boxes are listed once for each bucket that they touch and joined to points by an
    equi-join on the bucket, and all bounds are tested on what meets. So a point meets the boxes near it only, and the join
    is a hash join, broadcast while the list of boxes is below MAX_BROADCAST_BOXES and shuffled beyond. The first and the last
    bucket hold all values beyond the span; nulls have a bucket of their own, which boxes that are open on both sides of the
    attribute touch too. Results are those of range_search, box by box."""
    table = boxes if isinstance(boxes, DataFrame) else boxes_frame(points.sparkSession, boxes, schema)
    name, low, high, n = _bucket_attribute(table, schema)
    width = max(1, -(-(high - low + 1) // BUCKETS))
    # least and greatest pass over nulls, which have to stay null here.
    bucket = lambda c: F.when(c.isNotNull(), F.least(F.greatest(F.floor((c - low) / width), F.lit(0)), F.lit(BUCKETS - 1)).cast("int"))
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    touched = F.sequence(F.coalesce(bucket(lo), F.lit(0)), F.coalesce(bucket(hi), F.lit(BUCKETS - 1)))
    touched = F.when(lo.isNull() & hi.isNull(), F.concat(touched, F.array(F.lit(-1)))).otherwise(touched)
    listed = table.where(lo.isNull() | hi.isNull() | (lo <= hi)).withColumn("bucket", F.explode(touched))
    if n * (BUCKETS + 1) <= MAX_BROADCAST_BOXES:
        listed = F.broadcast(listed)
    met = points.select(*schema.names, F.coalesce(bucket(F.col(name)), F.lit(-1)).alias("bucket")).join(listed, "bucket")
    return met.where(reduce(lambda x, y: x & y, [_holds(a) for a in schema.names])).select("qid", *schema.names)


def _holds(a: str) -> Column:
    lo, hi = F.col(f"{a}_lo"), F.col(f"{a}_hi")
    return (lo.isNull() | F.coalesce(F.col(a) >= lo, F.lit(False))) & (hi.isNull() | F.coalesce(F.col(a) <= hi, F.lit(False)))


def batch_counts(points: DataFrame, boxes: list[BoxQuery] | DataFrame, schema: PointSchema) -> DataFrame:
    """(qid, found): how many points each box holds, zeros included."""
    table = boxes if isinstance(boxes, DataFrame) else boxes_frame(points.sparkSession, boxes, schema)
    found = batch_search(points, table, schema).groupBy("qid").agg(F.count("*").alias("found"))
    return table.select("qid").join(found, "qid", "left").select("qid", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def selective_boxes(points: DataFrame, boxes: list[BoxQuery] | DataFrame, schema: PointSchema, least: int, most: int) -> DataFrame:
    """(qid, found) of the boxes that hold between least and most points, all counted in one pass."""
    return batch_counts(points, boxes, schema).where(F.col("found").between(least, most))


def counted(points: DataFrame, box: BoxQuery, open_bounds: str = "unbounded") -> tuple[DataFrame, "Observation"]:
    """range_search, and an observation of (checked, found): points that the scan gave after skipping, and those in the box.
    Read it after an action on the result."""
    from pyspark.sql import Observation

    seen = Observation()
    inside = box.with_profile_bounds().predicate() if open_bounds == "profile" else box.predicate()
    near = points.where(box.key_predicate()) if "z0" in points.columns and box.bounds else points
    watched = near.observe(seen, F.count("*").alias("checked"), F.count_if(F.coalesce(inside, F.lit(False))).alias("found"))
    return watched.where(inside).select(box.schema.names), seen
