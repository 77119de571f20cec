"""The registered opN_ queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return identify(docs.select("doc_id", "text", out.alias("held_out")), fit(docs.where(~out))).select("doc_id", "held_out", "lang_pred", "score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.substrings import without_repeated_words

    return without_repeated_words(table(spark, sf_dir, "documents"), 20, digest=True)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.suffix_sort import without_repeated_bytes

    return without_repeated_bytes(table(spark, sf_dir, "documents"), 50, digest=True)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.decontamination import contaminated, is_contaminated

    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthobox.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, far) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.far = l.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, comp AS component_id, v.vec_id = comp AS kept
FROM v JOIN (SELECT node, min(far) AS comp FROM r GROUP BY node) ON node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = v.vec_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
edge AS (SELECT doc_id, count(*) AS n_removed, count_if(q IS NULL OR q <> p - 1) AS n_spans FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS kept
         FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN edge USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                     ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
c AS (SELECT list_sort(s) AS k, min(doc_id) AS rep, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
e AS (SELECT rep, n, unnest(k) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, far) AS (SELECT rep, rep FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.far = l.a),
m AS (SELECT node, min(far) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id, s.doc_id = coalesce(m.comp, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.k LEFT JOIN m ON m.node = c.rep
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, hash(text) AS h, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
       FROM (SELECT *, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % (SELECT greatest(64, least(4096, count(*) // 50000)) FROM documents) AS salt FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
r AS (SELECT *, (CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
      FROM r WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level), cap)) AS target FROM l),
n AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, salt, doc_id) - 1 AS nth,
             CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS each,
             (('0x' || substr(md5('mix-1|' || coalesce(d.source, chr(0))), 1, 7))::BIGINT % 1048576) / 1048576.0::DOUBLE AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor((nth + 1) * each + off) - floor(nth * each + off))::BIGINT * size)::BIGINT AS taken FROM n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_embeddings": op2_embeddings,
    "op3_language": op3_language,
    "op4_html": op4_html,
    "op5_substrings": op5_substrings,
    "op6_suffixes": op6_suffixes,
    "op7_urls": op7_urls,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}
SQL: dict[str, str] = {"op2_embeddings": OP2_SQL, "op5_substrings": OP5_SQL, "op6_suffixes": OP6_SQL, "op8_near_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_mixing": OP10_SQL}
