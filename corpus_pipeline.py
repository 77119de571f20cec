"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet to the shared folder and reads
again. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthobox.llm import decontamination, language, mixing, near_dedup, sharding
from orthobox.llm.shared import discard, spare, stored, without

LEAST_SCORE, N_SHARDS = 0.3, 16


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those with no letter, and those whose best language has a score below
    LEAST_SCORE. The model learns from the labelled documents outside the held-out quarter; if there are none, documents
    with a letter stay."""
    model = language.fit(docs.where(~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays. Rows are told apart by id and text, so different texts that share an id
    are judged apart, and of rows without an id copies go too; rows without words link with nothing and stay."""
    row = spare(docs, "row_key")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    found = stored(near_dedup.near_duplicates(keyed, n_words=2, id_col=row).where("n_shingles > 0"))
    kept = without(keyed, found.where(~F.col("kept")).select(row))
    repeated = stored(found.where("kept").groupBy(row).count().where("count > 1").select(row))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    nth = spare(keyed, "nth")
    once = kept.join(repeated, row, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy("source"))).where(F.col(nth) == 1)
    return without(kept, repeated).select(docs.columns).unionByName(once.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stored(found.where(decontamination.is_contaminated(F.col("n_words"), F.col("n_hit"))).select("doc_id", "text_hash"))
    return without(docs.withColumn("text_hash", F.xxhash64("text")), bad).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. The mix carries a hash of the text, so that rows that share an id get their own
    copies; rows alike in id, source and text are matched in any order."""
    text, n, nth = (spare(docs, c) for c in ("text_key", "copies", "nth"))
    keyed = docs.withColumn(text, F.xxhash64("text"))
    same = ["doc_id", "source", text]
    taken = mixing.mix(keyed, extra=[text]).select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(same)], F.col("copies").alias(n))
    taken = taken.withColumn("_nth", F.row_number().over(Window.partitionBy("_0", "_1", "_2").orderBy(n)))
    numbered = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy("n_chars")))
    match = [numbered[c].eqNullSafe(taken[f"_{k}"]) for k, c in enumerate(same)]
    met = numbered.join(taken, [*match, numbered[nth] == taken["_nth"]]).where(F.col(n) > 0)
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; equal texts share a shard."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("language", keep_identified),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
#: The language model and 64-bit text hashes of two stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
