import random
import zlib
from collections import Counter, defaultdict

from orthobox.llm import mixing, sharding


def _least_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    return min(c for c in range(1, sum(sizes) + 1) if fits(c))


def test_plan_is_minimal(spark):
    rng = random.Random(1)
    for n, shards in ((40, 4), (200, 7), (3, 5)):
        groups = [(rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(1, 30)) for _ in range(n)]
        # Groups that share their leading bits force several zooms.
        groups += [(12345 + k, rng.randint(1, 30)) for k in range(n)]
        alone, starts = sharding.plan_shards(spark.createDataFrame(groups, "h long, bytes long"), shards)
        if alone:
            continue
        loads = Counter()
        for h, b in groups:
            loads[sum(h >= s for s in starts)] += b
        assert max(loads.values()) == _least_capacity([b for _, b in sorted(groups)], shards)


def test_hot_group_gets_its_own_shard(spark):
    groups = [(k * 1000, 10) for k in range(50)] + [(77, 1000)]
    alone, starts = sharding.plan_shards(spark.createDataFrame(groups, "h long, bytes long"), 6)
    loads = Counter()
    for h, b in groups:
        loads[-1 if h in alone else sum(h >= s for s in starts)] += b
    assert alone == [77] and len(loads) == 6 and max(v for k, v in loads.items() if k >= 0) == 100


def test_shards_of_odd_rows(spark, odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count() and sharding.shard(none, 4).count() == 0
    texts = defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        texts[r["doc_id"]].add(r["text"])
    slots = defaultdict(list)
    for r in rows:
        (text,) = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    by_text = defaultdict(set)
    for r in rows:
        by_text[next(iter(texts[r["doc_id"]]))].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_targets_and_copies(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["copies"] <= 2
    total = sum(sizes.values())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    target, open_, left = {}, dict(weights), 1.5 * total
    while open_:
        full = [s for s in open_ if 2 * sizes[s] <= left * open_[s] / sum(open_.values()) + 1e-9]
        if not full:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        for s in full:
            del open_[s]
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))


def test_taken_is_near_target(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), f"s{k % 3}") for k in range(3000)]
    taken, target, largest = Counter(), {}, Counter()
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in target)
