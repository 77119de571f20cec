"""Finding and removing repeated runs of symbols over a whole corpus; shared by the word and the byte operator.

A window is `length` consecutive symbols of a document. Of the grams of `gram` symbols inside a window the one with the least
hash, the leftmost if several, is its anchor, so equal windows have equal anchors wherever they stand. A run of consecutive
windows with one anchor is a piece: at most 2 * length - gram symbols. A window repeats only if its anchor does, hence:

1. documents are dealt to groups by a hash of their id; each group sends the distinct hashes of its anchors, 32 bits of each,
   to the shard that the rest of the hash names;
2. a shard finds hashes that several groups sent, and answers each group with one bit a hash;
3. groups send the pieces of repeated anchors to their shards, equal pieces of a group once, with their places;
4. a shard thus gets every piece of its anchors. Equal pieces are merged; where an anchor has several different pieces, a
   `resolve` function (a suffix automaton, a suffix array) finds the windows that they share. The places to remove are sent
   back to the groups;
5. groups remove them from their texts.

Nothing but text moves in proportion to the text; it is shuffled once, as the three uses of it share one exchange. Copies are
collapsed within a group before they move, so an anchor that stands in a third of all documents reaches its shard at most
once a group. Groups hold GROUP_BYTES of text each, however large the corpus, and shards get as much on average.

A shard may be far larger than that, as an anchor may stand in any number of different pieces (a frequent line between texts
that vary). A shard is read as a stream and kept in a scratch file of its task beyond SPOOL_BYTES. It is read twice: once for
the different pieces and their first places, once for the places to remove. If the different pieces exceed HELD_BYTES, they are
dealt to smaller files by their anchors. An anchor whose pieces exceed Plan.most symbols is split: each piece is cut anew,
by the rarest gram of each window among all pieces of the anchor, and if that does not help, into single windows. Equal windows
meet in one file at each step, so results do not depend on any of these sizes.

Documents are ordered by id; rows without an id come last.
"""

from __future__ import annotations

import ctypes
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import orthobox.llm.shared  # noqa: F401  (sends this module's functions with their code)

GROUP_BYTES, BLOCK = 16_000_000, 1 << 19
SPOOL_BYTES, HELD_BYTES, FAN, SPANS = 32_000_000, 16_000_000, 16, 1 << 17  # bytes a spool keeps in memory; bytes of different pieces; spools of a split; spans of an answer
COUNT_BITS = 20
LAST = np.iinfo(np.int64).max
_OUT = np.zeros(1, bool)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Plan:
    """symbols: text -> array of symbols; resolve: (pieces, in order of their first places; ids of their first documents) ->
    for each piece a mask of windows that repeat earlier, or None; same_document: whether an earlier start in the same document counts;
    finish: (text, symbols, mask of removed ones) -> the columns of a result row after the id; schema: of these; most: symbols
    that resolve gets at a time, all pieces of an anchor among them."""

    length: int
    gram: int
    symbols: Callable
    resolve: Callable
    same_document: bool
    finish: Callable
    schema: str
    most: int


def gram_hashes(s: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of gram symbols."""
    n = len(s) - gram + 1
    if s.dtype == np.uint8:  # gram is 16: two unaligned words
        word = np.ndarray((len(s) - 7,), "<u8", np.ascontiguousarray(s), strides=(1,))
        h = word[:n] * _A + (word[8 : 8 + n] ^ (word[:n] >> np.uint64(29))) * _B
    else:
        h = s[:n] * _A
        for k in range(1, gram):
            h = (h ^ (h >> np.uint64(33))) * _A + s[k : k + n]
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def pieces_of(s: np.ndarray, ends: np.ndarray, length: int, gram: int, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For symbols of documents that end at `ends`: (hash of the anchor, first window, last window) of every piece. With
    `count`, the number of grams by the upper bits of their hashes, rarer grams come first as anchors."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(s) < length:
        return none
    h = gram_hashes(s, gram)
    rank = h if count is None else np.frexp(count[h >> np.uint64(64 - COUNT_BITS)])[1].astype(np.uint64) << np.uint64(58) | (h & np.uint64((1 << 44) - 1)) << np.uint64(14)
    least = (rank & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    # Windows over the end of a document are none.
    good = np.ones(len(at) + 1, np.int8)
    starts = np.maximum(np.concatenate([[0], ends[:-1]]), ends - length + 1)
    step = np.zeros(len(at) + 1, np.int64)
    np.add.at(step, np.minimum(starts, len(at)), 1)
    np.add.at(step, np.minimum(ends, len(at)), -1)
    good = np.cumsum(step[:-1]) == 0
    j = np.flatnonzero(good)
    if not len(j):
        return none
    cut = np.flatnonzero((np.diff(at[j]) != 0) | (np.diff(j) != 1)) + 1
    first, last = j[np.concatenate([[0], cut])], j[np.concatenate([cut - 1, [len(j) - 1]])]
    return h[at[first]], first, last


class Group:
    """The documents of a group, in order of id and text, in blocks of about BLOCK symbols."""

    def __init__(self, table: pa.Table, plan: Plan):
        ids, self.column, self.plan = table.column("id").to_pylist(), table.column("text"), plan
        repeated = len(set(ids)) < len(ids)
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, (self.column[k].as_py() or b"") if repeated else b""))
        self.ids = [ids[k] for k in self.order]

    def texts(self):
        """One at a time: the group's texts stay in the Arrow table only."""
        return (self.column[k].as_py() for k in self.order)

    def blocks(self):
        """(symbols, ordinals of documents, their ends) of each block."""
        parts, ordinals, size, make = [], [], 0, self.plan.symbols()
        for k, text in enumerate(self.texts()):
            s = make(text)
            if len(s) >= self.plan.length:
                parts.append(s)
                ordinals.append(k)
                size += len(s)
                if size >= BLOCK:
                    yield np.concatenate(parts), ordinals, np.cumsum([len(p) for p in parts])
                    parts, ordinals, size = [], [], 0
        if parts:
            yield np.concatenate(parts), ordinals, np.cumsum([len(p) for p in parts])

    def pieces(self):
        """(symbols, ordinals, ends, hashes, first, last) of each block; documents above 2**24 symbols in overlapping parts."""
        n = self.plan.length
        for s, ordinals, ends in self.blocks():
            if len(s) < 1 << 24:
                yield s, ordinals, ends, *pieces_of(s, ends, n, self.plan.gram)
                continue
            begin = 0
            for k, end in zip(ordinals, ends):
                for at in range(begin, max(begin + 1, end - n + 1), 1 << 23):
                    part = s[at : min(end, at + (1 << 23) + n - 1)]
                    yield part, [(k, at - begin)], np.array([len(part)]), *pieces_of(part, np.array([len(part)]), n, self.plan.gram)
                begin = end


def _give_back() -> None:
    """Returns freed memory to the system: a worker of Python waits for its next task with all that the last one had used, and
    an executor may keep more workers than it has cores."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def _lean(run: Callable) -> Callable:
    """run(key, table, ...), after which the worker gives back what it had used."""

    def of_group(*tables):
        try:
            return run(*tables)
        finally:
            _give_back()

    # Spark tells by the number of arguments whether the key is wanted.
    return (lambda key, table: of_group(key, table)) if run.__code__.co_argcount == 2 else (lambda key, table, other: of_group(key, table, other))


def keys_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard number in the upper, 32 bits of the hash in the lower half."""
    return ((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Its values once each, in order. np.unique hashes them, which takes many times as long as to sort them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _send_hashes(plan: Plan, shards: int):
    def run(key, table):
        found = [_distinct(keys_of(p[3], shards)) for p in Group(table, plan).pieces()]
        k = _distinct(np.concatenate(found)) if found else np.empty(0, np.uint64)
        shard = (k >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        low = k.astype(np.uint32)
        filled = [q for q in range(shards) if cuts[q + 1] > cuts[q]]
        return pa.table({"shard": pa.array(filled, pa.int32()), "part": pa.array([key[0].as_py()] * len(filled), pa.int32()), "hashes": pa.array([low[cuts[q] : cuts[q + 1]].tobytes() for q in filled], pa.binary())})

    return run


def _answer(key, table):
    parts = [np.frombuffer(b, np.uint32) for b in table.column("hashes").to_pylist()]
    both = np.sort(np.concatenate(parts))
    twice = _distinct(both[1:][both[1:] == both[:-1]])
    bits = []
    for p in parts:
        k = np.searchsorted(twice, p)
        bits.append(np.packbits(twice[np.minimum(k, len(twice) - 1)] == p if len(twice) else np.zeros(len(p), bool)).tobytes())
    return pa.table({"part": table.column("part"), "shard": pa.array([key[0].as_py()] * len(parts), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _content_hashes(s: np.ndarray, first: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each piece's whole content, from grams that cover it."""
    g, out = gram_hashes(s, gram), size.astype(np.uint64) * _B
    for k in range(0, int(size.max()), gram):
        out = (out ^ (out >> np.uint64(32)) ^ g[first + np.minimum(k, size - gram)]) * _C
    return out ^ (out >> np.uint64(31))


def _alike(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of `size` symbols at a and at b are equal."""
    word, step = (np.ndarray((len(s) - 7,), "<u8", s, strides=(1,)), 8) if s.dtype == np.uint8 else (s, 1)
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), step):
        live = np.flatnonzero(same & (size > k))
        at = np.minimum(k, size[live] - step)
        same[live] = word[a[live] + at] == word[b[live] + at]
    return same


def _send_pieces(plan: Plan, shards: int):
    def run(key, table, answers):
        group = Group(table, plan)
        blocks = list(group.pieces()) if table.num_rows else []
        keys = [keys_of(p[3], shards) for p in blocks]
        own, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.uint64), np.empty(0, int))
        cuts = np.searchsorted((own >> np.uint64(32)).astype(np.int64), np.arange(shards + 1))
        wanted = counts > 1
        for q, bits in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()):
            n = cuts[q + 1] - cuts[q]
            wanted[cuts[q] : cuts[q + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        repeated = own[wanted]
        del own, counts, wanted
        texts, parts, before = [], [], 0
        for j, k in enumerate(keys):
            s, ordinals, ends, h, first, last = blocks[j]
            blocks[j] = keys[j] = None
            at = np.searchsorted(repeated, k)
            pick = np.flatnonzero(repeated[np.minimum(at, len(repeated) - 1)] == k) if len(repeated) else np.empty(0, int)
            if not len(pick):
                continue
            first, size = first[pick], last[pick] - first[pick] + plan.length
            doc = np.searchsorted(ends, first, "right")
            begin = np.concatenate([[0], ends])[doc]
            ordinal, shift = np.array([o if isinstance(o, tuple) else (o, 0) for o in ordinals], np.int64).reshape(-1, 2)[doc].T
            parts.append((h[pick], _content_hashes(s, first, size, plan.gram), (first + before).astype(np.int32), size.astype(np.int32), ordinal.astype(np.int32), (first - begin + shift).astype(np.int32)))
            texts.append(s)
            before += len(s)
        del blocks, keys
        out = {name: [] for name in ("shard", "part", "hash", "size", "n", "id", "ordinal", "at", "content")}
        if parts:
            s = np.concatenate(texts)
            del texts
            h, same, first, size, ordinal, at = (np.concatenate(x) for x in zip(*parts))
            del parts
            # Pieces by shard and content, equal ones in order of their places: documents came in order.
            to = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((same, to))
            h, same, first, size, ordinal, at, to = (x[order] for x in (h, same, first, size, ordinal, at, to))
            new = np.ones(len(h), bool)
            new[1:] = (to[1:] != to[:-1]) | (same[1:] != same[:-1]) | (size[1:] != size[:-1])
            like = np.flatnonzero(~new)
            new[like] = ~_alike(s, first[like - 1], first[like], size[like])
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(h))).astype(np.int32)
            cuts = np.searchsorted(to[heads], np.arange(shards + 1))
            ids, width, raw = np.array([LAST if i is None else i for i in group.ids], np.int64), s.itemsize, memoryview(s).cast("B")
            for q in range(shards):
                rows = heads[cuts[q] : cuts[q + 1]]
                if not len(rows):
                    continue
                here = slice(rows[0], rows[-1] + n[cuts[q + 1] - 1])
                content = b"".join([raw[a * width : (a + w) * width] for a, w in zip(first[rows].tolist(), size[rows].tolist())])
                for name, value in (("shard", q), ("part", key[0].as_py()), ("hash", h[rows].tobytes()), ("size", (size[rows] * width).tobytes()), ("n", n[cuts[q] : cuts[q + 1]].tobytes()), ("id", ids[ordinal[here]].tobytes()), ("ordinal", ordinal[here].tobytes()), ("at", at[here].tobytes()), ("content", content)):
                    out[name].append(value)
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "part") else pa.binary()) for k, v in out.items()})

    return run


class Spool:
    """Rows of pieces (part, hash, size, n, id, ordinal, at, content), a scratch file of the task beyond SPOOL_BYTES."""

    def __init__(self):
        self.file, self.rows, self.hash, self.several = tempfile.SpooledTemporaryFile(SPOOL_BYTES), 0, None, False

    def add(self, part: int, h: np.ndarray, size: np.ndarray, n: np.ndarray, places: tuple, content: bytes) -> None:
        if not len(h):
            return
        self.hash = h[0] if self.hash is None else self.hash
        self.several = self.several or bool((h != self.hash).any())
        pickle.dump((part, h, size, n, *places, content), self.file, 5)
        self.rows += 1

    def __iter__(self):
        self.file.seek(0)
        for _ in range(self.rows):
            part, h, size, n, id_, ordinal, at, content = pickle.load(self.file)
            yield part, h, size, n, (id_, ordinal, at), content

    def deal(self, other: Callable, keys: int) -> list["Spool"]:
        """Pieces dealt to `keys` spools by the number that other(hashes) gives; negative ones to none."""
        out = [Spool() for _ in range(keys)]
        for part, h, size, n, places, content in self:
            to = other(h)
            ends, of_place = np.cumsum(size), np.repeat(to, n)
            for q in np.unique(to[to >= 0]).tolist():
                pick = np.flatnonzero(to == q)
                own = b"".join([content[e - w : e] for e, w in zip(ends[pick].tolist(), size[pick].tolist())])
                out[q].add(part, h[pick], size[pick], n[pick], tuple(p[of_place == q] for p in places), own)
        return out

    def close(self) -> None:
        self.file.close()


def _cut_anew(spool: Spool, plan: Plan, dtype: type, windows: bool) -> Spool:
    """The pieces of an anchor cut by the rarest gram of each window, or into single windows."""
    width, out = np.dtype(dtype).itemsize, Spool()

    def rows():
        for part, _, size, n, places, content in spool:
            ends, cuts = np.cumsum(size) // width, np.cumsum(n)
            step = max(1, (1 << 20) * width // int(size.max()))
            for k in range(0, len(size), step):
                a, e = int(ends[k] - size[k] // width), ends[k : k + step]
                own = content[a * width : int(e[-1]) * width]
                yield part, np.frombuffer(own, dtype), e - a, n[k : k + step], tuple(p[int(cuts[k] - n[k]) : int(cuts[min(k + step, len(n)) - 1])] for p in places), own

    count = None
    if not windows:
        count = np.zeros(1 << COUNT_BITS, np.int64)
        for _, s, _, _, _, _ in rows():
            np.add.at(count, gram_hashes(s, plan.gram) >> np.uint64(64 - COUNT_BITS), 1)
    for part, s, ends, n, (id_, ordinal, at), raw in rows():
        if windows:
            begin = np.concatenate([[0], ends[:-1]])
            first = np.concatenate([np.arange(b, e - plan.length + 1) for b, e in zip(begin.tolist(), ends.tolist())])
            h, last = gram_hashes(s, plan.gram), first
            h = h[first] * _A ^ (h[first + plan.length - plan.gram] >> np.uint64(7)) * _B
            for k in range(plan.gram, plan.length - plan.gram, plan.gram):
                h = (h ^ h >> np.uint64(31)) * _C + gram_hashes(s[k:], plan.gram)[first]
        else:
            h, first, last = pieces_of(s, ends, plan.length, plan.gram, count)
        piece = np.searchsorted(ends, first, "right")
        shift = first - np.concatenate([[0], ends])[piece]
        begin = (np.cumsum(n) - n)[piece]
        copies = n[piece]
        index = np.repeat(begin - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        size = ((last - first + plan.length) * width).astype(np.int32)
        own = b"".join([raw[a * width : a * width + w] for a, w in zip(first.tolist(), size.tolist())])
        out.add(part, h, size, copies, (id_[index], ordinal[index], at[index] + np.repeat(shift, copies).astype(np.int32)), own)
    return out


def _solve(spool: Spool, plan: Plan, dtype: type, depth: int = 0, cuts: int = 0):
    """(part, rows of (ordinal, first symbol, end)) of what the pieces of the spool remove. Closes the spool."""
    width = np.dtype(dtype).itemsize
    known: dict[bytes, tuple] = {}  # content -> (*first place, hash)
    own: dict[int, int] = {}  # bytes of the different pieces of each hash
    held = 0
    for part, h, size, n, (id_, ordinal, at), content in spool:
        begin, first = 0, np.cumsum(n) - n  # the places of a piece in a group are in order
        for x, w, i, o, a in zip(h.tolist(), size.tolist(), id_[first].tolist(), ordinal[first].tolist(), at[first].tolist()):
            c = content[begin : begin + w]
            begin += w
            place = (i, part, o, a, x)
            old = known.get(c)
            if old is None:
                known[c] = place
                own[x] = own.get(x, 0) + w
                held += w
            elif place < old:
                known[c] = place
        if held > HELD_BYTES and (spool.several or cuts < 2):
            break
    hot = [x for x, w in own.items() if w > plan.most * width] if cuts < 2 else []
    if held > HELD_BYTES and (spool.several or cuts < 2) or hot:
        del known, own
        if not spool.several:
            new = _cut_anew(spool, plan, dtype, cuts > 0)
            spool.close()
            yield from _solve(new, plan, dtype, depth, cuts + 1)
            return
        if held > HELD_BYTES:
            salt = np.uint64(2 * depth + 1)
            parts = spool.deal(lambda h: ((h * _B * salt ^ h >> np.uint64(29)) * _C >> np.uint64(40)).astype(np.int64) % FAN, FAN)
        else:
            hot = np.sort(np.array(hot, np.uint64))
            parts = spool.deal(lambda h: np.where(hot[(at := np.minimum(np.searchsorted(hot, h), len(hot) - 1))] == h, at, len(hot)), len(hot) + 1)
        spool.close()
        for p in parts:
            yield from _solve(p, plan, dtype, depth + 1, cuts)
        return
    del own
    by_hash: dict[int, list[bytes]] = {}
    for c, place in known.items():
        by_hash.setdefault(place[4], []).append(c)
    masks: dict[bytes, list[tuple[int, int]]] = {}  # content -> its runs of windows to remove: (first, one past the last)
    chunk, size = [], 0

    def resolve():
        chunk.sort(key=known.__getitem__)
        masks.update(_runs(chunk, plan.resolve([np.frombuffer(c, dtype) for c in chunk], [known[c][0] for c in chunk], [known[c][4] for c in chunk])))

    for cs in by_hash.values():
        if len(cs) > 1:
            more = sum(map(len, cs)) // width
            if chunk and size + more > plan.most:
                resolve()
                chunk, size = [], 0
            chunk += cs
            size += more
    if chunk:
        resolve()
    del by_hash, chunk
    for part, _, size, n, (id_, ordinal, at), content in spool:
        own = [content[e - w : e] for e, w in zip(np.cumsum(size).tolist(), size.tolist())]
        piece = np.repeat(np.arange(len(n)), n)
        if plan.same_document:
            first = np.array([known[c][:4] for c in own], np.int64)[piece]
            gone = (id_ != first[:, 0]) | (part != first[:, 1]) | (ordinal != first[:, 2]) | (at != first[:, 3])
        else:
            gone = id_ > np.array([known[c][0] for c in own], np.int64)[piece]
        spans = [np.stack([ordinal[gone], at[gone], at[gone] + size[piece[gone]] // width], axis=1)]
        some, stays = [], np.flatnonzero(~gone)
        for k, o, a in zip(piece[stays].tolist(), ordinal[stays].tolist(), at[stays].tolist()):
            for x, z in masks.get(own[k], ()):
                some += o, a + x, a + z - 1 + plan.length
        yield part, np.concatenate([*spans, np.array(some, np.int32).reshape(-1, 3)])
    spool.close()


def _runs(pieces: list[bytes], masks: list[np.ndarray | None]) -> dict[bytes, list[tuple[int, int]]]:
    """For each piece that has any, the runs of its mask."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    own = [k for k, m in enumerate(masks) if m is not None]
    if not own:
        return out
    ends = np.cumsum([len(masks[k]) + 1 for k in own])
    flat = np.zeros(ends[-1] + 1, np.int8)  # a 0 before the first and after each
    flat[1:] = np.concatenate([x for k in own for x in (masks[k], _OUT)])
    step = np.diff(flat)
    rises, falls = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    of = np.searchsorted(ends, rises, "right")
    begin = np.append(0, ends)[of]
    for k, a, z in zip(of.tolist(), (rises - begin).tolist(), (falls - begin).tolist()):
        out.setdefault(pieces[own[k]], []).append((a, z))
    return out


def _resolve(plan: Plan, dtype: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool()
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)  # noqa: B023, E731
                spool.add(batch.column("part")[row].as_py(), get("hash", np.uint64), get("size", np.int32), get("n", np.int32), (get("id", np.int64), get("ordinal", np.int32), get("at", np.int32)), batch.column("content")[row].as_py())
        removed: dict[int, list] = {}

        def batch_of():
            parts = sorted(removed)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([np.concatenate(removed[p]).astype(np.int32).tobytes() for p in parts], pa.binary())], ["part", "spans"])

        found = 0
        for part, spans in _solve(spool, plan, dtype):
            if not len(spans):
                continue
            removed.setdefault(part, []).append(spans)
            found += len(spans)
            if found >= SPANS:
                yield batch_of()
                removed, found = {}, 0
        yield batch_of()
        spool = removed = None
        _give_back()

    return run


def _finish(plan: Plan, names: list[str], types: list[pa.DataType]):
    def run(key, table, answers):
        group = Group(table, plan)
        spans = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 3) for b in answers.column("spans").to_pylist()] or [np.empty((0, 3), np.int32)])
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        cuts, make, rows = np.searchsorted(spans[:, 0], np.arange(len(group.ids) + 1)), plan.symbols(), []
        for k, (id_, text) in enumerate(zip(group.ids, group.texts())):
            own = spans[cuts[k] : cuts[k + 1]]
            mask = None
            if len(own):
                step = np.zeros(max(int(own[:, 2].max()), 1) + 1, np.int32)
                np.add.at(step, own[:, 1], 1)
                np.add.at(step, own[:, 2], -1)
                mask = np.cumsum(step[:-1]) > 0
            rows.append((id_, *plan.finish(text, make, mask)))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def remove_repeats(docs: DataFrame, plan: Plan, dtype: type, id_col: str, text_col: str) -> DataFrame:
    """(id, plan.schema) for every row of docs."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)).cast("int").alias("part"))
    hashes = texts.groupBy("part").applyInArrow(_lean(_send_hashes(plan, parts)), "shard int, part int, hashes binary")
    answers = hashes.groupBy("shard").applyInArrow(_answer, "part int, shard int, bits binary")
    sent = "shard int, part int, hash binary, size binary, n binary, id binary, ordinal binary, at binary, content binary"
    pieces = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_lean(_send_pieces(plan, parts)), sent)
    spans = pieces.groupBy("shard").applyInArrow(_resolve(plan, dtype), "part int, spans binary")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind: StructType = _parse_datatype_string(f"id long, {plan.schema}")
    arrow = to_arrow_schema(kind)
    out = texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_lean(_finish(plan, arrow.names, arrow.types)), kind)
    return out.withColumnRenamed("id", id_col)
