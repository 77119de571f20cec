"""Sharding by minimax contiguous partition over ordered atomic groups.

Rows with equal text are one atomic group; groups are ordered by a 64-bit hash of the text. The smallest shard capacity for
which a greedy left-to-right fill needs no more than n_shards is found by binary search, and the order is cut there.

The ordered sizes are never gathered. The driver holds sums over cells of the hash space (a bounded number of them). A cell
that could hold a cut is unknown inside, so the search is done twice: with such cells divisible (a lower bound of the
capacity) and with them atomic (an upper bound). Cells that a cut may fall in between those bounds are then split 2**ZOOM
ways, until only single groups are left there and both bounds meet: the result is exact.

A group above the mean shard size takes a shard of its own, and the rest is cut over the remaining shards; otherwise one hot
group would set the capacity and leave other shards empty.

Cases: null text has size 1 and is one group of its own, apart from the empty text (size 1 too); repeated rows and ties stay
together; an empty table gives no rows; fewer groups than shards leave shards empty; extra columns are not read. Two texts
whose 64-bit hashes collide share a group, which keeps the contract.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.llm.shared import stored

FIRST, ZOOM = 12, 8
ROWS_PER_SLOT_BUCKET, MAX_SLOT_BUCKETS = 100, 1024


def _unsigned(h: Column, bits: int) -> Column:
    """The leading bits of h, in the order of signed longs."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)


class _Cells:
    """Consecutive cells of the hash space: start (64 bits), bits, bytes, groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.edge = np.concatenate([[0], np.cumsum([r[2] for r in self.rows], dtype=object)]).astype(object)
        self.prefix = np.array([float(x) for x in self.edge])
        self.single = [r[3] == 1 for r in self.rows]

    def fill(self, capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int]]:
        """Greedy cuts as sums of all bytes before them; whether everything fits."""
        at, cuts, total = 0, [], self.edge[-1]
        for _ in range(shards - 1):
            to = at + capacity
            if to < total:
                k = self._cell(to)
                if not divisible or self.single[k]:
                    to = self.edge[k]
            at = max(at, min(to, total))
            cuts.append(at)
        return total - at <= capacity, cuts

    def _cell(self, at: int) -> int:
        """The cell that holds byte number at (from 0)."""
        k = int(np.searchsorted(self.prefix, float(at), "right")) - 1
        while self.edge[k] > at:
            k -= 1
        while self.edge[k + 1] <= at:
            k += 1
        return k

    def least(self, shards: int, divisible: bool, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards, divisible)[0] else (mid + 1, high)
        return low

    def unknown(self, shards: int) -> tuple[list[int], list[int]]:
        """Cells to split before the cuts are exact, and the cuts."""
        total, floor = self.edge[-1], max([r[2] for r, one in zip(self.rows, self.single) if one], default=0)
        low = self.least(shards, True, max(floor, -(-total // shards)), total)
        heavy = [k for k, r in enumerate(self.rows) if r[3] > 1 and r[2] > low // 4]
        if heavy:
            return heavy, []
        high = self.least(shards, False, low, total)
        early, late = self.fill(low, shards, False)[1], self.fill(high, shards, True)[1]
        wanted: set[int] = set()
        for a, b in zip(early, late):
            if a < total:
                wanted.update(k for k in range(self._cell(a), self._cell(min(b, total - 1)) + 1) if self.rows[k][3] > 1)
        return sorted(wanted), self.fill(high, shards, False)[1]


def plan_shards(groups: DataFrame, n_shards: int) -> tuple[list[int], list[int]]:
    """groups(h, bytes) -> hashes of groups with shards of their own, and the first hash (signed) of each later shard."""
    top = groups.orderBy(F.desc("bytes"), "h").limit(n_shards).collect()
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    for r in top:
        if len(alone) < n_shards - 1 and r["bytes"] * (n_shards - len(alone)) > total:
            alone.append(r["h"])
            total -= r["bytes"]
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups
    shards = n_shards - len(alone)

    def split(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        got = df.groupBy(_unsigned(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        return [((r["cell"] % (1 << bits)) << (64 - bits), bits, int(r["bytes"]), r["n"]) for r in got]

    rows = split(rest, FIRST)
    if not rows:
        return alone, []
    while True:
        cells = _Cells(rows)
        wanted, cuts = cells.unknown(shards)
        if not wanted:
            break
        by_bits: dict[int, list[int]] = {}
        for k in wanted:
            by_bits.setdefault(rows_bits := cells.rows[k][1], []).append(cells.rows[k][0] >> (64 - rows_bits))
        rows = [r for k, r in enumerate(cells.rows) if k not in set(wanted)]
        for bits, prefixes in by_bits.items():
            signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prefixes]
            rows += split(rest.where(_unsigned(F.col("h"), bits).isin(signed)), min(64, bits + ZOOM))
    starts = [cells.rows[cells._cell(c)][0] - (1 << 63) for c in cuts if c < cells.edge[-1]]
    return alone, starts


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; slots count from 0 in each shard without gaps."""
    text = F.col(text_col)
    base = stored(docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("h"),
        F.xxhash64(F.lit("slot"), F.col(id_col)).alias("spread"),
    ))
    groups = stored(base.groupBy("h").agg(F.sum("size").alias("bytes")))
    alone, starts = plan_shards(groups, n_shards)
    number = F.lit(len(alone))
    for s in starts:
        number = number + (F.col("h") >= F.lit(s)).cast("int")
    for k, h in enumerate(alone):
        number = F.when(F.col("h") == F.lit(h), F.lit(k)).otherwise(number)
    n_buckets = max(1, min(MAX_SLOT_BUCKETS, base.count() // (ROWS_PER_SLOT_BUCKET * n_shards)))
    placed = base.select(id_col, "size", "text_crc32", number.cast("int").alias("shard"), F.pmod("spread", F.lit(n_buckets)).cast("int").alias("bucket"))
    return number_rows(placed, "shard", "bucket", [F.col(id_col), F.col("text_crc32")]).drop("bucket")


def number_rows(df: DataFrame, key: str, bucket: str, order: list[Column]) -> DataFrame:
    """Adds slot: a gapless number from 0 within key. Rows of a key are numbered bucket by bucket, each bucket in a task of
    its own, after the buckets' counts; a hot key is thus spread over its buckets (at most MAX_SLOT_BUCKETS a key)."""
    from pyspark.sql import Window

    counts = df.groupBy(key, bucket).agg(F.count("*").alias("n"))
    before = counts.select(key, bucket, (F.sum("n").over(Window.partitionBy(key).orderBy(bucket)) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    return df.withColumn("inside", inside).join(before, [key, bucket]).withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside")
