"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item's windows are its runs of
`window` consecutive words; a shorter item is one window. A window is the set of its positioned shingles (SHINGLE words; all
of its words if it has fewer). Shingles are ordered by rarity, that is by their count over all documents. Since the whole
window has to be contained, the prefix that must be joined is its single rarest shingle: a document position with that
shingle is a candidate, its length and positional bounds (the window must start and end inside the document) are applied,
and the candidate is verified against every word of the window by joining its other shingles, as text, at their positions.

One pass reads the corpus. It keeps only positions whose shingle occurs in the benchmark, plus one row per document with its
word count, and writes them to the shared folder; counts, candidates and verification run on that table. The benchmark's
shingles are broadcast only up to MAX_BROADCAST of them, beyond that they are joined by a shuffle.

Cases: null or empty text has no words, in items it has no window; repeated rows each get their row; documents that share an
id but not a text are kept apart; items that share an id count once; an empty benchmark leaves every document clean; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthobox.llm.shared import stored

SHINGLE = 3
MAX_BROADCAST = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; only A-Z change. Pure ASCII text takes the faster lower()."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), GAP), lambda w: w != "")


def _shingles(list_: Column, n: int) -> Column:
    """Texts of the n-word shingles, from position 0 on."""
    last = F.size(list_) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(list_, i + k) for k in range(n)]))


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, win, len, part, shingle): win is the text of the window, part the shingle's position in it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    wins = items.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    wins = wins.select("item", F.slice("w", F.col("at") + 1, F.col("len")).alias("w"), "len").distinct()
    parts = F.when(F.col("len") >= 3, _shingles(F.col("w"), 3)).when(F.col("len") == 2, _shingles(F.col("w"), 2)).otherwise(F.col("w"))
    return wins.select("item", F.concat_ws(" ", "w").alias("win"), "len", F.posexplode(parts).alias("part", "shingle"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, text_hash, n_words, n_hit, items) for every row of docs; items: sorted ids of items with windows that occur."""
    parts = stored(item_windows(benchmark, window, item_col, "text"))
    shingles = parts.select("shingle").distinct()
    n_shingles, sizes = shingles.count(), [r[0] for r in parts.select(F.least("len", F.lit(SHINGLE))).distinct().collect()]
    if n_shingles <= MAX_BROADCAST:
        shingles = F.broadcast(shingles)
    text = F.col(text_col)
    key = [F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash")]
    worded = docs.select(*key, words(text).alias("w"))
    # Element 0 stands for the document itself; those that follow carry their position, negative sizes none.
    lists = [_shingles(F.col("w"), n) for n in sorted(sizes)]
    numbered = [F.transform(x, lambda s, i: F.struct(i.alias("pos"), s.alias("shingle"))) for x in lists]
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("shingle")))
    rows = worded.select("doc", "text_hash", F.size("w").alias("n_words"), F.explode(F.concat(own, *numbered)).alias("s"))
    rows = rows.select("doc", "text_hash", "n_words", F.col("s.pos").alias("pos"), F.col("s.shingle").alias("shingle"))
    marks = shingles.unionByName(docs.sparkSession.createDataFrame([("",)], "shingle string"))
    found = stored(rows.join(F.broadcast(marks) if n_shingles <= MAX_BROADCAST else marks, "shingle", "left_semi"))
    each, hits = found.where("pos = -1").drop("pos", "shingle"), found.where("pos >= 0").distinct()

    count = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    rarity = parts.join(count, "shingle")  # a window with a shingle that no document has cannot occur
    whole = Window.partitionBy("item", "win")
    rarity = rarity.withColumn("parts", F.count("*").over(whole)).where(F.col("parts") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
    rarest = F.row_number().over(whole.orderBy("n", "shingle", "part"))
    prefix = rarity.withColumn("rank", rarest).where("rank = 1").select("win", "len", "parts", "part", "shingle").distinct()
    starts = hits.join(prefix, "shingle").select("doc", "text_hash", (F.col("pos") - F.col("part")).alias("start"), "win", "len", "parts", "n_words")
    starts = starts.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    wanted = starts.join(parts.select("win", "part", "shingle").distinct(), "win").withColumn("pos", F.col("start") + F.col("part"))
    a, b = wanted.alias("a"), hits.alias("b")
    same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.shingle") == F.col("b.shingle"))
    kept = a.join(b, same, "left_semi").groupBy("doc", "text_hash", "start", "win", "len", "parts").agg(F.count("*").alias("n")).where("n = parts")

    in_doc = Window.partitionBy("doc", "text_hash").orderBy("start", "end")
    ends = kept.select("doc", "text_hash", "start", "win", (F.col("start") + F.col("len")).alias("end"))
    reached = F.coalesce(F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = ends.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    n_hit = covered.groupBy("doc", "text_hash").agg(F.sum("new").cast("long").alias("n_hit"))
    of_items = ends.select("doc", "text_hash", "win").distinct().join(parts.select("item", "win").distinct(), "win")
    items = of_items.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    h, i = n_hit.alias("h"), items.alias("i")
    marked = h.join(i, F.col("h.doc").eqNullSafe(F.col("i.doc")) & (F.col("h.text_hash") == F.col("i.text_hash"))).select("h.*", "items")
    e, m = each.alias("e"), marked.alias("m")
    out = e.join(m, F.col("e.doc").eqNullSafe(F.col("m.doc")) & (F.col("e.text_hash") == F.col("m.text_hash")), "left")
    return out.select(F.col("e.doc").alias(id_col), F.col("e.text_hash").alias("text_hash"), F.col("e.n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)
