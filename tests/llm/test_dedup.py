import hashlib
import random
import sys

import numpy as np
import pytest

from orthobox.llm import embeddings, near_dedup, repeats, substrings, suffix_sort
from orthobox.llm.shared import components
from orthobox.llm.substrings import SuffixAutomaton, without_repeated_words
from orthobox.llm.suffix_sort import without_repeated_bytes


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    for links in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        real = [x for x in links if x[0] != x[1]]
        assert got == _components({n for x in real for n in x}, real)


def _shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _near(rows, n, percent):
    sets = {i: _shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return _components(sets, links), {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_near_duplicates(spark, monkeypatch, broadcast):
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_SALT", 5)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows = []
    for k in range(12):
        base = [word() for _ in range(60)]
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(60)] = word()
            rows.append((len(rows), " ".join(t)))
    want, sizes = _near(rows, 2, 80)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = {(r["doc_id"]): (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd, n_words=2).collect()}
    assert got[1] == (29, 1, True) and got[2] == (29, 1, False) and got[3][1:] == (1, False)
    assert got[4] == got[5][:1] + (4, True) and got[6] == (0, 6, True) and got[7] == (1, 7, True)
    assert got[8][1:] == (8, True) and got[9][1:] == (8, False) and got[None][1:] == (1, True) or got[None][2]
    assert near_dedup.near_duplicates(none).count() == 0


def test_lattice_points():
    rng = np.random.RandomState(1)
    short = embeddings._shortest()
    assert len(short) == 240 and set(np.round((short**2).sum(axis=1), 9)) == {2.0}
    x = rng.normal(size=(300, 8)) * 2
    near = embeddings.nearest_e8(x)
    d = ((x - near) ** 2).sum(axis=1)
    assert all((((x - near - s) ** 2).sum(axis=1) >= d - 1e-9).all() for s in short)
    doubled = np.rint(near * 2).astype(int)
    assert ((doubled % 2).ptp(axis=1) == 0).all() if hasattr(doubled, "ptp") else (np.ptp(doubled % 2, axis=1) == 0).all()


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng, rows = np.random.RandomState(2), []
    for _ in range(15):
        v = rng.normal(size=16)
        for _ in range(rng.choice([1, 2, 30])):
            rows.append((len(rows), (v + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])).astype(np.float32).tolist(), int(rng.randint(2))))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [None] * 16, 1), (n + 5, [], 0), (n + 6, rows[0][1][:8], rows[0][2])]
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    cos = lambda a, b: np.dot(np.array(a, float), np.array(b, float)) / (np.linalg.norm(np.array(a, float)) * np.linalg.norm(np.array(b, float)))
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98]
    want = _components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_links"] for k, r in got.items()} == {r[0]: sum(r[0] in x for x in links) for r in rows}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(100):
        a, known = SuffixAutomaton(), []
        for _ in range(rng.randint(1, 4)):
            s = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
            for i, got in enumerate(a.matching_statistics(s)):
                assert got == max(n for n in range(i + 2) if not n or any(q[j : j + n] == s[i - n + 1 : i + 1] for q in known for j in range(len(q))))
            a.add(s)
            known.append(s)


def test_suffix_order():
    """Order and common prefixes against brute force: whatever the memory of the queues, with recursion and without."""
    rng = random.Random(3)
    texts = [[rng.randint(2, 3 + k % 5) for _ in range(rng.randint(0, 120))] for k in range(25)]
    texts += [[2] * 60, [2, 3] * 40, [3, 2] * 40, [2, 3, 4] * 30, [rng.choice([5, 6]) for _ in range(7)] * 40, [9, 9, 9, 2] * 20 + [9] * 30, [rng.randint(2, 200) for _ in range(60)] * 3]
    for symbols in texts:
        t = np.array([*symbols, 0], np.uint16)
        want = sorted(range(len(t)), key=lambda k: t[k:].tolist())
        shared = [0] + [next((j for j in range(12) if t[min(a + j, len(t) - 1)] != t[min(b + j, len(t) - 1)]), 12) for a, b in zip(want, want[1:])]
        for memory in (10**6, 3):
            order, common = suffix_sort.suffix_order(t, len(t), memory, cap=12)
            assert order.tolist() == want and common.tolist() == shared


def test_suffix_order_in_few_steps():
    """Queues that fit in memory give what those on disk give, for caps between two words too, with few calls a symbol."""
    rng, calls = np.random.RandomState(4), []
    for symbols in (4, 250):
        t = np.append(rng.randint(1, symbols, 3000), 0).astype(np.uint16)
        t[1500:2900] = t[:1400]
        want = sorted(range(len(t)), key=lambda k: t[k:].tolist())
        for cap in (1, 7, 50):
            shared = [0] + [next((j for j in range(cap) if t[a + j] != t[b + j]), cap) for a, b in zip(want, want[1:])]
            for memory in (10**6, 500):
                order, common = suffix_sort.suffix_order(t, len(t), memory, cap=cap)
                assert order.tolist() == want and common.tolist() == shared
    t = np.append(rng.randint(1, 250, 40000), 0).astype(np.uint16)
    sys.setprofile(lambda frame, event, of: calls.append(1) if event in ("call", "c_call") else None)
    suffix_sort.suffix_order(t, 50, cap=50)
    sys.setprofile(None)
    assert len(calls) < 400_000


def test_runs_of_masks():
    rng = np.random.RandomState(5)
    masks = [None if k % 4 == 0 else rng.randint(0, 2, rng.randint(1, 9)).astype(bool) for k in range(60)]
    names = [b"%d" % k for k in range(60)]
    want = {c: [k for k in range(len(m)) if m[k]] for c, m in zip(names, masks) if m is not None and m.any()}
    got = repeats._runs(names, masks)
    assert {c: [k for a, z in r for k in range(a, z)] for c, r in got.items()} == want
    assert all(a[1] < b[0] for r in got.values() for a, b in zip(r, r[1:])) and repeats._runs([b"x"], [None]) == {}
    for n in (0, 1, 500):
        x = rng.randint(0, 90, n).astype(np.uint64)
        assert repeats._distinct(x).tolist() == sorted(set(x.tolist()))


def test_pieces_have_equal_anchors():
    rng = np.random.RandomState(3)
    for kind, n, gram in ((np.uint8, 50, 16), (np.uint64, 20, 10)):
        docs = [rng.randint(0, 3, rng.randint(n, 200)).astype(kind) for _ in range(6)]
        s, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        h, first, last = repeats.pieces_of(s, ends, n, gram)
        seen = {}
        for x, a, z in zip(h.tolist(), first, last):
            for j in range(a, z + 1):
                assert seen.setdefault(s[j : j + n].tobytes(), x) == x
        assert (last - first + 1).sum() == sum(len(d) - n + 1 for d in docs)


def _brute(rows, split, join, n, same_document):
    first, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or ""))
    parts = {k: split(rows[k][1]) for k in order}
    for k in order:
        for i in range(len(parts[k]) - n + 1):
            first.setdefault(tuple(parts[k][i : i + n]), (k, i))
    for k in order:
        gone = set()
        for i in range(len(parts[k]) - n + 1):
            f = first[tuple(parts[k][i : i + n])]
            if f != (k, i) if same_document else rows[f[0]][0] != rows[k][0] and f != (k, i):
                gone.update(range(i, i + n))
        kept = join([x for i, x in enumerate(parts[k]) if i not in gone])
        out.setdefault(rows[k][0], []).append((len(parts[k]), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(15, 60))) for _ in range(4)]
    rows = [(k, " ".join(rng.choice([*passage, " ".join(rng.choice("xyz") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    return rows + [(60, None), (61, ""), (62, "q " * 100), (63, "é" * 60), (64, "é" * 70)]


def test_repeated_words(spark):
    rows = _texts(1)
    got = without_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 20, digest=True).collect()
    want = _brute(rows, lambda t: (t or "").encode().split(), b" ".join, 20, True)
    assert {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in got} == {k: [(a, b, d) for a, b, _, d in v] for k, v in want.items()}


def test_repeated_bytes(spark):
    rows = _texts(2)
    for memory in (1000, 10**7):
        got = without_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 50, memory=memory, digest=True).collect()
        want = _brute(rows, lambda t: (t or "").encode(), bytes, 50, False)
        assert {r["doc_id"]: [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] for r in got} == want


def test_repeats_of_odd_rows(spark, odd, none):
    words = without_repeated_words(odd, 20)
    assert words.count() == odd.count() and without_repeated_words(none).count() == 0
    kept = {r["doc_id"]: r["kept_text"] for r in words.where("doc_id is null or doc_id != 8").collect()}
    assert kept[2] == "" and kept[3] == "end" and kept[9] == "tail" and kept[None] == "" and kept[4] == kept[5] == kept[6] == ""
    raw = without_repeated_bytes(odd, 50)
    assert raw.count() == odd.count() and without_repeated_bytes(none).count() == 0
    gone = {r["doc_id"]: r["n_removed"] for r in raw.collect()}
    assert gone[8] == 0 and gone[1] == 0 and gone[2] > 100 and gone[12] == 0


def _hot_line(n, line, join):
    rng = random.Random(7)
    text = lambda: join.join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(25))
    return [(k, join.join([text(), line, text()])) for k in range(n)]


@pytest.mark.parametrize("held", [10**7, 6000])
def test_hot_line_is_sorted_in_bounded_parts(spark, monkeypatch, held):
    most, sort = 3000, suffix_sort.equal_windows

    def bounded(pieces, *rest):
        assert sum(map(len, pieces)) <= most
        return sort(pieces, *rest)

    monkeypatch.setattr(suffix_sort, "equal_windows", bounded)
    monkeypatch.setattr(suffix_sort, "MOST", most, raising=False)
    monkeypatch.setattr(repeats, "HELD_BYTES", held, raising=False)
    monkeypatch.setattr(repeats, "SPOOL_BYTES", held, raising=False)
    rows = _hot_line(300, "a line that stands in every document of the corpus, between words that are never the same", " ")
    want = _brute(rows, lambda t: t.encode(), bytes, 50, False)
    got = without_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 50, digest=True).collect()
    assert {r["doc_id"]: [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] for r in got} == want


@pytest.mark.parametrize("held", [10**7, 20000])
def test_hot_phrase_fills_bounded_automata(spark, monkeypatch, held):
    most, add = 400, SuffixAutomaton.add

    def bounded(self, sequence):
        add(self, sequence)
        assert max(self.length) and len(self.length) <= 2 * most

    monkeypatch.setattr(SuffixAutomaton, "add", bounded)
    monkeypatch.setattr(substrings, "MOST", most, raising=False)
    monkeypatch.setattr(repeats, "HELD_BYTES", held, raising=False)
    monkeypatch.setattr(repeats, "SPOOL_BYTES", held, raising=False)
    rows = _hot_line(300, " ".join(f"w{k}" for k in range(15)), " ") + _hot_line(3, "short", " ")
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = _brute(rows, lambda t: t.encode().split(), b" ".join, 20, True)
    got = without_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 20, digest=True).collect()
    assert {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in got} == {k: [(a, b, d) for a, b, _, d in v] for k, v in want.items()}
