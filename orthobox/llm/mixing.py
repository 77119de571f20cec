"""Mixing sources to target weights by systematic sampling.

Targets: sources, ordered by code point (null last), weigh 5, 2, 1, repeating, and share `total` times the size of all
documents; no target exceeds `cap` times its source's size, the excess being shared again by weight (water filling, solved in
closed form over the sources sorted by cap per weight).

Sampling: a source's documents are put in order of size, and each expects target / source size copies. The expected copies
are prefix-summed, one offset per source (a hash of seed and source, so reruns agree) is added, and a document is emitted
once per integer boundary its interval crosses: the floor or the ceiling of its expectation. Since sizes rise along the
order, the words taken differ from the target by no more than the source's largest document.

A source is never gathered: documents are dealt by (source, size, salt), the salt being a hash of the id with as many values
as the row count asks for; prefix sums run over counts of (source, size) and of salts within them.

Cases: null source is one source of its own; null and empty texts have size 0, are ordered first and are taken zero words
(copies are still drawn); a source of size 0 has target 0; equal rows tie and are numbered in any order, which gives the
same rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthobox.llm.shared import stored, word_count

WEIGHTS, TOTAL, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
ROWS_PER_SALT, MAX_SALTS = 50_000, 4096
OFFSETS = 1 << 20


def _hash28(x: Column) -> Column:
    """The first 28 bits of the MD5 of a string: other engines can compute it too."""
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """sizes(source, docs, source_size) -> also target. One row per source: the windows here see sources, not documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(1))
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    all_size, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (all_size * total - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ratio = F.col("limit") / F.col("weight")
    ranked = ranked.withColumn("level", level)
    # The first source that its share does not fill up sets the level of all that stay below their caps.
    open_level = F.min(F.when(ratio > F.col("level"), F.struct(ratio, "rank", "level"))).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * open_level, F.col("limit")))
    return ranked.select("source", "docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """(id, size, source, source_size, target, copies, extra columns) for every row of docs."""
    base = stored(docs.select(id_col, "source", word_count(F.col("text")).alias("size"), *(extra or [])))
    salts = n_salts(base.count())
    base = base.withColumn("salt", F.pmod(_hash28(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(salts)))
    cells = base.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("source").orderBy("size")
    before_size = by_size.select("source", "size", (F.sum("n").over(ordered) - F.col("n")).alias("before_size"))
    salted = Window.partitionBy("source", "size").orderBy("salt")
    before = cells.withColumn("before_salt", F.sum("n").over(salted) - F.col("n"))
    b, s = before.alias("b"), before_size.alias("s")
    before = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.size") == F.col("s.size"))).select("b.source", "b.size", "b.salt", (F.col("before_salt") + F.col("before_size")).alias("before"))
    goals = targets(by_size.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, total, cap)
    b, g = before.alias("b"), goals.alias("g")
    # Goals have one row per source and fit a broadcast if there are few; the planner decides by their size.
    before = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "source_size", "target")
    inside = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(id_col)) - 1
    d, b = base.withColumn("inside", inside).alias("d"), before.alias("b")
    same = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.size") == F.col("b.size")) & (F.col("d.salt") == F.col("b.salt"))
    at = (F.col("before") + F.col("inside")).cast("double")
    offset = _hash28(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("d.source"), F.lit("\u0000")))) % OFFSETS / F.lit(float(OFFSETS))
    each = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    copies = (F.floor((at + 1) * each + offset) - F.floor(at * each + offset)).cast("long")
    return d.join(b, same).select(F.col(f"d.{id_col}").alias(id_col), F.col("d.source").alias("source"), F.col("d.size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), *[F.col(f"d.{c}").alias(c) for c in extra or []])


def n_salts(rows: int) -> int:
    return max(64, min(MAX_SALTS, rows // ROWS_PER_SALT))
