"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

A document's set holds its distinct shingles of n_words words (64-bit hashes of them). Two small collections of SIDE bands, each band
being the hash of WIDTH minhashes, are computed; every pair of a band of the first and a band of the second collection is the
key of one table. SIDE ** 2 tables thus take 2 * SIDE * WIDTH minhashes. A pair of similarity s meets in some table with
probability (1 - (1 - s ** WIDTH) ** SIDE) ** 2: with 8 and 2 that is 0.9994 at 0.8 and 0.9999 at 0.85.

Documents with equal sets are one class from the start, represented by their smallest id, so groups of exact copies cost one
row. Pairs of a bucket are never emitted. First every member of a bucket is compared with the bucket's smallest member;
links make components, and buckets that lie within one are done. Members of the other buckets are then gathered by the band
of the first collection that the bucket's key holds (a group of more than BLOCK members or BLOCK_BYTES of sets is split into
blocks, whose pairs are compared apart), and inside a task all pairs that share a table and lie in different components are compared by their sets; a task
returns only links that join components. So no pair that met in a table goes unverified unless its ends are connected
already, and what is written is linear in the members.

Comparisons fetch the texts of the documents concerned again; the list of these is broadcast only up to BROADCAST_BYTES,
else joined by a shuffle of these documents. The rows of a hot first member are salted. Python workers hold two blocks of sets
and OUT_BYTES of rows that leave, whatever the size of a group.

Cases: null, empty and blank texts have empty sets and link with nothing; a text of fewer than n_words words is one shingle; repeated rows link
(equal sets); rows with null ids are kept and not linked; rows that share an id are one node; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthobox.llm.shared import components, discard, stored

SIDE, WIDTH = 8, 2
BROADCAST_BYTES, ID_BYTES, PLACE_BYTES = 10_000_000, 40, 400  # of all rows; of a row of ids; of a row with bands and places
MEMBERS_PER_SALT, BLOCK, BLOCK_BYTES, OUT_BYTES = 500, 512, 8_000_000, 8_000_000
CACHED_WORDS = 150_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, by: np.uint64 = _M2) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: WordHashes, n_words: int) -> np.ndarray:
    """Sorted hashes of the distinct n_words-word shingles (of the whole text if it has fewer words); bytes.lower and
    bytes.split act on ASCII only, as wanted."""
    w = hashes.of(text.lower().split()) if text else np.empty(0, np.uint64)
    n = min(n_words, len(w))
    h = w[: len(w) - n + 1] if n else w
    for k in range(1, n):
        h = h * _M1 + (w[k : len(w) - n + 1 + k] ^ (w[k : len(w) - n + 1 + k] >> np.uint64(27))) * _M2
    return np.unique(mixed(h + np.uint64(n)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20_11)
    draw = lambda: r.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def bands(set_: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 4096) -> np.ndarray:
    """2 * SIDE hashes of WIDTH minhashes each."""
    least = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(set_), block):
        least = np.minimum(least, (set_[None, k : k + block] * mul[:, None] + add[:, None]).min(axis=1))
    least = mixed(least).reshape(-1, WIDTH)
    out = least[:, 0]
    for k in range(1, WIDTH):
        out = mixed(out * _M1 + least[:, k])
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Texts go to Python in batches of few rows, since some are very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sign(batches, n_words: int):
    hashes, (mul, add) = WordHashes(), _multipliers(2 * SIDE * WIDTH)
    for batch in batches:
        n, f1, f2, a, b = [], [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), hashes, n_words)
            n.append(len(s))
            f1.append(int(np.add.reduce(mixed(s, _M1))) if len(s) else 0)
            f2.append(int(np.bitwise_xor.reduce(mixed(s, _M3))) if len(s) else 0)
            got = bands(s, mul, add).view(np.int64) if len(s) else np.empty(0, np.int64)
            a.append(got[:SIDE])
            b.append(got[SIDE:])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(f1), signed(f2), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "a", "b"])


def _to_sets(batches, n_words: int):
    hashes, last, kept = WordHashes(), None, b""
    names = ["leader", "salt", "member", "own"]
    for batch in batches:
        first, sets, held = 0, [], 0
        for k, text in enumerate(batch.column("text"), 1):
            text = text.as_py()
            if text != last:
                last, kept = text, shingle_set(text, hashes, n_words).tobytes()
            sets.append(kept)
            held += len(kept)
            if held > OUT_BYTES or k == batch.num_rows:
                part = batch.slice(first, k - first)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(sets, pa.binary())], names=[*names, "set"])
                first, sets, held = k, [], 0


def _compare(batches, percent: int):
    """Rows in order of leader and salt, a leader's own row first."""
    at, own = None, []
    for batch in batches:
        leaders, members = [], []
        for leader, salt, member, is_own, set_ in zip(*(batch.column(k).to_pylist() for k in range(5))):
            set_ = np.frombuffer(set_, np.uint64)
            if at != (leader, salt):
                at, own = (leader, salt), []
            if is_own:
                own.append(set_)
                continue
            for mine in own:
                both = len(np.intersect1d(mine, set_, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(set_) - both) and both:
                    leaders.append(leader)
                    members.append(member)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(members, pa.int64())], names=["a", "b"])


def _those(texts: DataFrame, wanted: DataFrame, key: str, few: bool) -> DataFrame:
    """texts, without those that a later shuffled join with wanted would drop, if their ids may be broadcast."""
    ids = None if few else wanted.select(F.col(key).alias("id")).distinct()
    return texts if few or ids.count() * ID_BYTES > BROADCAST_BYTES else texts.join(F.broadcast(ids), "id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Those of pairs(leader, member) whose full sets link, as (a, b). texts: (id, text)."""
    spark, n_pairs = pairs.sparkSession, pairs.count()
    per_leader = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS_PER_SALT).cast("int").alias("salts"))
    members = pairs.join(per_leader, "leader").select(F.col("member").alias("id"), "leader", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"))
    owners = per_leader.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    wanted = members.unionByName(owners)
    few = 2 * n_pairs * ID_BYTES <= BROADCAST_BYTES
    wanted = F.broadcast(wanted) if few else wanted
    fetched = _those(texts, wanted, "id", few).join(wanted, "id").select("leader", "salt", F.col("id").alias("member"), "own", F.col("text").cast("binary").alias("text"))
    sets = fetched.mapInArrow(partial(_to_sets, n_words=n_words), "leader long, salt int, member long, own boolean, set binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", F.desc("own"))
    with small_batches(spark, 200):
        return stored(dealt.mapInArrow(partial(_compare, percent=percent), "a long, b long"))


def _expand(batches, n_words: int):
    """A document's set, once for each place (group, i, j) that it goes to."""
    hashes = WordHashes()
    names = ["group", "band", "i", "j", "block", "rep", "comp", "a", "b", "set"]
    types = {"set": pa.binary(), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64())} | dict.fromkeys(("band", "i", "j", "block"), pa.int32())
    rows: list[tuple] = []
    held = 0

    def full():
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, columns)], names=names)

    for batch in batches:
        columns = [batch.column(c) for c in ("places", "rep", "comp", "a", "b", "text")]
        for k in range(batch.num_rows):
            places, rep, comp, a, b, text = (c[k].as_py() for c in columns)
            set_ = shingle_set(text, hashes, n_words).tobytes()
            for p in places:
                for other in range(p["blocks"]):
                    i, j = sorted((p["block"], other))
                    rows.append((p["group"], p["band"], i, j, p["block"], rep, comp, a, b, set_))
                    held += len(set_) + PLACE_BYTES
                    if held > OUT_BYTES:
                        yield full()
                        rows, held = [], 0
    yield full()


def _joining_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """rows (band, i, j, block, rep, comp, a, b, set) of a pair of blocks of a group: links that join components."""
    band, i, j = rows[0][:3]
    comp, block = np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
    a, b = np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
    sets = [np.frombuffer(r[8], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    wanted = (comp[:, None] != comp[None, :]) & (np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * percent)
    if i != j:
        wanted &= block[:, None] != block[None, :]
    meet = np.zeros_like(wanted)
    for k in range(SIDE):
        meet |= b[:, k][:, None] == b[:, k][None, :]
    wanted &= meet
    for k in range(band):  # compared in the group of that band
        wanted &= a[:, k][:, None] != a[:, k][None, :]
    left, right = np.nonzero(np.triu(wanted, 1))
    if not len(left):
        return []
    if len(left) > 8 * len(rows):
        both = _intersections(sets)[left, right]
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left.tolist(), right.tolist())])
    linked = 100 * both >= percent * (size[left] + size[right] - both)
    parent = {c: c for c in comp.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for x, y in zip(left[linked].tolist(), right[linked].tolist()):
        p, q = root(int(comp[x])), root(int(comp[y]))
        if p != q:
            parent[p] = q
            out.append((rows[x][4], rows[y][4]))
    return out


def _intersections(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of slices of the 0-1 matrix of members and elements that recur."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    recurs = counts[column] > 1
    owner, column = owner[recurs], number[column[recurs]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        has = np.zeros((len(sets), width), np.float32)
        has[owner[part], column[part] - at] = 1
        out += has @ has.T
    return np.rint(out).astype(np.int64)


def _compare_groups(batches, percent: int):
    at, rows = None, []

    def done():
        links = _joining_links(rows, percent) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(k) for k in range(10)]
        for k in range(batch.num_rows):
            group, *row = (c[k].as_py() for c in columns)
            if at != (group, *row[:3]):
                if rows:
                    yield done()
                at, rows = (group, *row[:3]), []
            rows.append(row)
    if rows:
        yield done()


def joining_links(open_: DataFrame, reps: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """open_(rep, band, comp): members of buckets with several components. Links (a, b) between these components."""
    spark = texts.sparkSession
    members = open_.join(reps.select("id", "n", "a", "b"), F.col("rep") == F.col("id")).drop("id")
    members = stored(members.withColumn("group", F.xxhash64("band", F.get("a", "band"))))
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    place = F.struct("group", "band", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    # A document has at most SIDE places.
    goes = stored(members.join(sizes, "group").groupBy("rep", "comp").agg(F.collect_list(place).alias("places")).join(reps.select(F.col("id").alias("rep"), "a", "b"), "rep"))
    few = goes.count() * PLACE_BYTES <= BROADCAST_BYTES
    here = _those(texts, goes, "rep", few)
    near = F.broadcast(goes) if few else goes
    fetched = here.join(near, here["id"] == near["rep"]).select("places", "rep", "comp", "a", "b", F.col("text").cast("binary").alias("text"))
    rows = fetched.mapInArrow(partial(_expand, n_words=n_words), "group long, band int, i int, j int, block int, rep long, comp long, a array<long>, b array<long>, set binary")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    with small_batches(spark, 200):
        found = stored(dealt.mapInArrow(partial(_compare_groups, percent=percent), "a long, b long"))
    discard(members)
    discard(goes)
    return found


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        signed = stored(texts.select("id", F.col("text").cast("binary")).mapInArrow(partial(_sign, n_words=n_words), "id long, n long, f1 long, f2 long, a array<long>, b array<long>"))
    copies = Window.partitionBy("n", "f1", "f2").orderBy("id")
    reps = stored(signed.where("n > 0 and id is not null").withColumn("rank", F.row_number().over(copies)).where("rank = 1").drop("rank"))
    table = F.array(*[F.xxhash64(F.lit(i * SIDE + j), F.get("a", F.lit(i)), F.get("b", F.lit(j))) for i in range(SIDE) for j in range(SIDE)])
    keyed = reps.select(F.col("id").alias("rep"), F.col("n").cast("int").alias("n"), F.posexplode(table).alias("table", "key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    # From here on only buckets of several members count.
    met = stored(keyed.join(shared, "key").select("key", F.floor(F.col("table") / SIDE).cast("int").alias("band"), "rep", "n", F.col("first.rep").alias("leader"), F.col("first.n").alias("leader_n")))
    alike = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    pairs = stored(met.where((F.col("rep") != F.col("leader")) & alike).select("leader", F.col("rep").alias("member")).distinct())
    links = confirmed(pairs, texts, n_words, percent)
    comps = stored(components(links))
    discard(pairs)
    discard(links)

    in_comp = met.select("key", "band", "rep").join(comps, met["rep"] == comps["node"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    several = in_comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low != high and members > 2").select("key")
    # In a bucket of two the one pair has been compared already.
    open_ = stored(in_comp.join(several, "key").select("rep", "band", "comp").distinct())
    if not open_.isEmpty():
        found = joining_links(open_, reps, texts, n_words, percent)
        if not found.isEmpty():
            known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = stored(components(known.unionByName(found)))
        discard(found)
    discard(open_)
    discard(met)

    classes = reps.select("n", "f1", "f2", F.col("id").alias("rep")).join(comps, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
