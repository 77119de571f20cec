from collections import Counter

import corpus_pipeline as cp
from orthobox.llm import decontamination, near_dedup


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    from orthobox.llm.shared import stored

    seen = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, sf))
        before, after = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in out.collect())
        if name != "sharding":
            assert out.columns == docs.columns
            assert all(tuple(r) == tuple(seen[r["doc_id"]]) for r in out.collect())
        if name == "language":
            assert all(any(c.isalpha() for c in seen[k]["text"]) for k in after) and len(after) >= 0.99 * sum(any(c.isalpha() for c in r["text"]) for r in seen.values())
        elif name == "near_dedup":
            group = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, n_words=2).collect()}
            assert max(after.values()) == 1 and sorted(group[k] for k in after) == sorted(set(group.values()))
        elif name == "decontamination":
            hit = decontamination.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
            assert set(before) - set(after) == {r["doc_id"] for r in hit if r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]}
        elif name == "mixing":
            assert max(after.values()) <= 2 and set(after) <= set(before) and len(after) > 0.5 * len(before)
        else:
            assert after == before and {r["shard"] for r in out.collect()} == set(range(16))
        docs = out


def test_odd_and_empty_corpora(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(columns), none.select(columns)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = cp.run(spark, str(tmp_path)).collect()
        assert Counter(r["doc_id"] for r in out)[2] == 0 and len(out) <= 2 * 8


def test_rows_that_share_an_id(spark, tmp_path):
    """Near-dedup and mixing tell rows apart by id and text; checked against brute force."""
    texts = [" ".join(f"w{k}x{j}" for j in range(3 + 7 * k)) for k in range(31)]
    rows = [(k % 10 if k % 10 else None, texts[k], "en", "ab"[k % 2], k) for k in range(31)] + [(50, texts[5], "en", "a", 1), (None, texts[6], "en", "a", 1), (None, texts[6], "en", "a", 1), (7, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.drop_near_copies(spark, docs, "").collect()
    assert Counter(r["text"] for r in left) == Counter([*texts, ""])
    mixed, sizes = Counter(), Counter()
    from orthobox.llm.mixing import mix

    for r in mix(docs, extra=["text"]).collect():
        mixed[r["doc_id"], r["source"], r["text"]] += r["copies"]
    for r in cp.mix_sources(spark, docs, "").collect():
        sizes[r["doc_id"], r["source"], r["text"]] += 1
    assert {k: n for k, n in mixed.items() if n} == sizes
