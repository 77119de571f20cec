"""Byte-level dedup by external induced suffix sorting.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id. The corpus is cut
into shards by content (see repeats.py); the pieces of a shard that share an anchor but differ are written one after the
other, with separators, and their suffixes are sorted by induction:

- suffixes are typed S or L; the leftmost S ones are put into their buckets, and the order of all L suffixes and then of all
  S suffixes is induced by scanning the buckets up and down, each suffix passing its predecessor to the bucket of that one's
  first symbol;
- buckets are priority queues on the first symbol that keep arrival order. What is queued are tuples of a position and of the
  prefix that its suffix shares with the one queued before it in that bucket; where only the order is asked for, positions.
  Up to `memory` tuples a scan, buckets are regions of one array, as the number of suffixes of each type and first symbol is
  known; with more, at most `memory` are held, and batches go to a scratch file of the task and are read back when their
  bucket's turn comes;
- substrings between leftmost S suffixes are named in the order that a first induction gives, and the string of names is sorted
  recursively in the same way: a name is written as two digits, so that the alphabet stays small, and the suffixes that begin
  at a first digit are in the order of the names. Beyond LEVELS, and where the digits are no shorter than the text was, ranks
  are doubled instead, until names are unique or cover `length` bytes;
- common-prefix values, capped at `length`, are measured between neighbours among the leftmost S suffixes and from there on
  carried through induction: two neighbours in a bucket share one symbol more than the least of the values between the
  suffixes that passed them on. Where the value reaches the cap, two windows are equal; a group of equal windows takes the
  smallest id of its documents.

The text that is sorted and the order that comes out are arrays in memory, of MOST bytes at a time. A shard far larger than that
is spooled to a scratch file and dealt to parts that share no window, each of which is sorted (see repeats.py).

All steps are on arrays, one bucket at a time.

Scratch files live in the task that wrote them, are read by no other and are deleted before it ends.

Cases: null and empty texts have no bytes and nothing removed; rows that share an id do not remove each other's bytes; rows
without an id count as last; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame

from orthobox.llm.repeats import Plan, remove_repeats

MOST = 1_000_000  # bytes that are sorted at a time; an anchor with more is split (see repeats.py)
MEMORY = 8_000_000  # entries that the queues of a task hold before they use the disk
END, GAP, SYMBOLS = 0, 1, 258  # bytes are shifted by 2
LEVELS = 1  # of recursion
WORD = 4  # symbols that are compared at once
_FIRST = np.array([(1 << 16 * k) - 1 for k in range(WORD + 1)], np.uint64)
SHRINKS = 0.8  # of the text's size, the most that a string of digits may have to be sorted recursively


class BucketQueues:
    """Queues of (position, common prefix), one for each first symbol, in order of arrival; on disk beyond `memory` entries.
    Symbols come in order."""

    def __init__(self, memory: int, symbols: int):
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbols: np.ndarray, positions: np.ndarray, common: np.ndarray | None) -> None:
        if not len(positions):
            return
        common = np.zeros(len(positions), np.uint16) if common is None else common
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(symbols)) + 1, [len(symbols)]]).tolist()
        for a, z in zip(cuts, cuts[1:]):
            self.chunks[symbols[a]].append((positions[a:z], common[a:z]))
        self.held += len(positions)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.chunks:
            for k, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].astype(np.int32).tobytes() + part[1].astype(np.uint16).tobytes())
                    parts[k] = (at, len(part[0]))
        self.held = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.empty(0, np.int32), np.empty(0, np.uint16))]
        for x, y in self.chunks[c]:
            if isinstance(x, np.ndarray):
                self.held -= len(x)
            else:
                self.file.seek(x)
                raw = self.file.read(6 * y)
                x, y = np.frombuffer(raw, np.int32, y), np.frombuffer(raw, np.uint16, offset=4 * y)
            parts.append((x, y))
        self.chunks[c] = []
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class HeldQueues:
    """The same where all entries fit in memory: one array, in which each symbol has a region as large as it will need."""

    def __init__(self, sizes: np.ndarray, carry: bool):
        begin = np.cumsum(sizes) - sizes
        self.begin, self.end = begin.tolist(), begin.copy()
        self.positions = np.empty(int(sizes.sum()), np.int32)
        self.common = np.empty(len(self.positions), np.uint16) if carry else None

    def push(self, symbols: np.ndarray, positions: np.ndarray, common: np.ndarray | None) -> None:
        if not len(positions):
            return
        n = np.bincount(symbols, minlength=len(self.end))
        place = (self.end - np.cumsum(n) + n)[symbols]
        place += np.arange(len(symbols))
        self.positions[place] = positions
        if self.common is not None:
            self.common[place] = common
        self.end += n

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray | None]:
        own = slice(self.begin[c], int(self.end[c]))
        return self.positions[own], None if self.common is None else self.common[own]

    def close(self) -> None:
        pass


def _queues(memory: int, sizes: np.ndarray, carry: bool) -> BucketQueues | HeldQueues:
    """sizes: the most entries that each symbol's queue will ever get."""
    return HeldQueues(sizes, carry) if sizes.sum() <= memory else BucketQueues(memory, len(sizes))


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S (less than its successor); the last one is."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    # Each run of equal symbols has the type of its last one.
    rises = np.append(t[differs] < t[differs + 1], True)
    return np.repeat(rises, np.diff(np.concatenate([[-1], differs, [n - 1]])))


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low:high] for each pair; no range is empty."""
    level, out = np.frexp(high - low)[1] - 1, np.empty(len(low), x.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            x = np.minimum(x[: -(1 << (k - 1))], x[1 << (k - 1) :])
        pick = np.flatnonzero(level == k)
        out[pick] = np.minimum(x[low[pick]], x[high[pick] - (1 << k)])
    return out


class _Carried:
    """Common prefixes of what is queued, from those of what is scanned: for each symbol the least value since its last push."""

    def __init__(self, symbols: int, cap: int):
        self.low, self.cap = np.zeros(symbols, np.uint16), cap

    def push(self, scanned: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """scanned: common prefix of each scanned suffix and the one before; i, c: which of them push, and to what symbol, in
        order of symbols."""
        if not len(i):
            np.minimum(self.low, scanned.min(), out=self.low)
            return np.empty(0, np.uint16)
        upto = np.minimum.accumulate(scanned)
        head = np.empty(len(i), bool)
        head[0] = True
        np.not_equal(c[1:], c[:-1], out=head[1:])
        value = np.empty(len(i), np.uint16)
        first = np.flatnonzero(head)
        to = c[first]
        value[first] = np.minimum(self.low[to], upto[i[first]])
        if len(first) < len(i):
            rest = np.flatnonzero(~head)
            value[rest] = _range_min(scanned, i[rest - 1] + 1, i[rest] + 1)
        after = np.empty(len(scanned) + 1, np.uint16)
        after[-1] = self.cap
        after[:-1] = np.minimum.accumulate(scanned[::-1])[::-1]
        np.minimum(self.low, upto[-1], out=self.low)
        self.low[to] = after[i[np.append(first[1:], len(i)) - 1] + 1]
        value += 1
        return np.minimum(value, self.cap, out=value)


def induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, memory: int, symbols: int, common: np.ndarray | None = None, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The order of all suffixes from that of the leftmost S suffixes (`seeds`), and, if there is a cap, each one's common
    prefix with the one before it, up to that; common: the same of the seeds."""
    order = np.argsort(t[seeds], kind="stable")
    at = t[seeds[order]]
    first = _queues(memory, np.bincount(at, minlength=symbols), cap > 0)
    first.push(at, seeds[order], common[order] if cap else None)
    none = (np.empty(0, np.int32), np.empty(0, np.uint16) if cap else None)
    larger, least, carried = [none] * symbols, [none] * symbols, _Carried(symbols, cap)
    # Symbol and type of each suffix's predecessor, whose last two bits are 1 for S and 2 for L; the first suffix has none.
    before = np.zeros(len(t), np.uint16 if 4 * symbols < 1 << 16 else np.uint32)
    before[1:] = t[:-1]
    before[1:] <<= 2
    before[1:] += 2 - s_type[:-1].view(np.uint8)

    def run(p: int) -> int:
        """How often the symbol at p is repeated."""
        k = 1
        while k < cap and t[p + k] == t[p]:
            k += 1
        return k

    def seam(of_l: np.ndarray, of_s: int | None) -> int:
        """Common prefix of an L and an S suffix with one first symbol: the shorter run of it."""
        return min(run(int(of_l)), run(int(of_s))) if cap else 0

    def pass_on(found: np.ndarray, shared: np.ndarray | None, want_s: bool, c: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Queues the predecessors of `found` that have the wanted type; returns those that stay in bucket c. The others' symbols
        are less than c if they are of type S, greater if of type L."""
        if not len(found):
            return none
        code = before[found]
        at = np.flatnonzero(code & (1 if want_s else 2))
        symbol = code[at] >> 2
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        value = carried.push(shared, at, symbol) if cap else None
        if not len(at):
            return none
        position = found[at] - 1
        cut = int(np.searchsorted(symbol, c, "left" if want_s else "right"))
        stay, go = (slice(cut, None), slice(0, cut)) if want_s else (slice(0, cut), slice(cut, None))
        queue.push(symbol[go], position[go], value[go] if cap else None)
        return position[stay], value[stay] if cap else None

    def bucket(c: int, want_s: bool) -> tuple[np.ndarray, np.ndarray | None]:
        wave, own = queue.pop(c), []
        if cap and len(wave[0]):
            wave[1][0] = 0  # the first of its bucket
        while len(wave[0]):
            own.append(wave)
            wave = pass_on(*wave, want_s, c)
        if len(own) < 2:
            return own[0] if own else none
        return np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]) if cap else None

    queue = _queues(memory, np.bincount(t[~s_type], minlength=symbols), cap > 0)
    for c in range(symbols):
        larger[c] = bucket(c, False)
        found, shared = first.pop(c)
        if cap and len(found):
            shared[0] = seam(larger[c][0][-1], found[0]) if len(larger[c][0]) else 0
        pass_on(found, shared, False, c)
    first.close()
    queue.close()
    queue = _queues(memory, np.bincount(t[s_type], minlength=symbols), cap > 0)
    carried.low[:] = 0
    for c in range(symbols - 1, -1, -1):
        down, shared = bucket(c, True)
        own, of_own = larger[c]
        joint = seam(own[-1], down[-1]) if len(own) and len(down) else 0
        if len(own):
            pass_on(own[::-1], np.concatenate([[joint], of_own[:0:-1]]).astype(np.uint16) if cap else None, True, c)
        if len(down):
            least[c] = down[::-1], np.concatenate([[joint], shared[:0:-1]]).astype(np.uint16) if cap else None
    queue.close()
    # The last suffix is no one's predecessor: it is the least of all.
    both = [x for c in range(symbols) for x in (larger[c], least[c])]
    return np.concatenate([np.array([len(t) - 1], np.int32), *[x[0] for x in both]]), np.concatenate([np.zeros(1, np.uint16), *[x[1] for x in both]]) if cap else None


def _words(t: np.ndarray) -> np.ndarray:
    """The WORD symbols from each place on as one number; END past the end."""
    padded = np.zeros(len(t) + WORD - 1, np.uint16)
    padded[: len(t)] = t
    return np.ndarray((len(t),), "<u8", padded, strides=(2,))


def _named(t: np.ndarray, starts: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Names of the substrings from one start to the next, in the order of `ranked`; equal ones share a name."""
    end = np.append(starts[1:], len(t) - 1)
    size = np.zeros(len(t), np.int32)
    size[starts] = end - starts + 1
    sizes = size[ranked]
    same, word = sizes[1:] == sizes[:-1], _words(t)
    live, k = np.flatnonzero(same), 0
    while len(live):
        a, b = ranked[live] + k, ranked[live + 1] + k
        kept = np.minimum(sizes[live] - k, WORD)
        same[live] = equal = ((word[a] ^ word[b]) & _FIRST[kept]) == 0
        k += WORD
        live = live[equal & (sizes[live] > k)]
    name = size  # no longer needed
    name[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return name[starts].astype(np.int64)


def _common(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix, up to cap, of each of these suffixes and the one before it."""
    out, live, word = np.zeros(len(order), np.uint16), np.arange(1, len(order)), _words(t)
    for k in range(0, cap, WORD):
        # Neither has come to its end: END stands only once, so up to there they would differ.
        differ = word[order[live - 1] + k] ^ word[order[live] + k]
        ended = differ != 0
        low = differ[ended]
        # The lowest bit that differs, exact as a double.
        out[live[ended]] = np.minimum(k + (np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1) // 16, cap)
        live = live[~ended]
        if not len(live):
            break
    out[live] = cap
    return out


def suffix_order(t: np.ndarray, depth: int, memory: int = MEMORY, symbols: int = SYMBOLS, cap: int = 0, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t, whose last symbol is the only END, sorted at least by their first `depth` symbols, and the common prefix
    of each and the one before it, up to cap."""
    s_type = _types(t)
    starts = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    if len(starts) <= 1:
        return induce(t, s_type, starts, memory, symbols, np.zeros(len(starts), np.uint16), cap)
    once = induce(t, s_type, starts, memory, symbols)[0]
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    rank = _named(t, starts, once[is_start[once]])
    del once, is_start
    names, span = int(rank.max()) + 1, 1
    if levels and names < len(rank) and 2 * len(rank) < SHRINKS * len(t):
        base = int(np.ceil(np.sqrt(names + 1)))
        digits = np.zeros(2 * len(rank) + 1, np.uint16)
        digits[:-1:2], digits[1::2] = rank // base + 1, rank % base + 1
        order = suffix_order(digits, depth, memory, base + 2, levels=levels - 1)[0]
        seeds = starts[order[(order % 2 == 0) & (order < 2 * len(rank))] >> 1]
    else:
        while rank.max() + 1 < len(rank) and span < depth:
            nxt = np.zeros(len(rank), np.int64)
            nxt[:-span] = rank[span:] + 1
            _, rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)
            span *= 2
        seeds = starts[np.argsort(rank, kind="stable")]
    return induce(t, s_type, seeds, memory, symbols, _common(t, seeds, cap), cap)


def equal_windows(pieces: list[np.ndarray], length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` bytes in the pieces: (piece, offset, class), equal windows having equal classes."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    t = np.full(starts[-1] + 1, GAP, np.uint16)
    place = np.arange(len(owner)) + owner
    t[place] = np.concatenate(pieces).astype(np.uint16) + 2
    t[-1] = END
    # Windows left in the piece from each place; none at separators.
    left = np.zeros(len(t), np.int32)
    left[place] = starts[owner] + sizes[owner] - place
    of = np.zeros(len(t), np.int32)
    of[place] = owner
    del owner, place
    order, common = suffix_order(t, length, memory, cap=length)
    # What stands between two equal windows is equal to them, so no value between neighbours that are kept is missed.
    kept = left[order] >= length
    order, common = order[kept], common[kept]
    piece = of[order]
    offset = order - starts[piece]
    return piece, offset, np.concatenate([[0], np.cumsum(common[1:] < length)]) if len(order) else np.empty(0, np.int64)


def _resolver(length: int, memory: int):
    def resolve(pieces: list[np.ndarray], ids: list[int], hashes: list[int]) -> list[np.ndarray | None]:
        piece, offset, kind = equal_windows(pieces, length, memory)
        ids = np.array(ids, np.int64)
        least = np.full(int(kind.max()) + 1 if len(kind) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, kind, ids[piece])
        first = np.concatenate([[0], np.cumsum([len(p) - length + 1 for p in pieces])])
        flat = np.zeros(first[-1], bool)
        hit = np.flatnonzero(least[kind] < ids[piece])
        flat[first[piece[hit]] + offset[hit]] = True
        some = np.zeros(len(pieces), bool)
        some[piece[hit]] = True
        masks = [flat[a:z] if any_ else None for a, z, any_ in zip(first[:-1].tolist(), first[1:].tolist(), some.tolist())]
        return masks

    return resolve


def _bytes():
    return lambda text: np.frombuffer(text or b"", np.uint8)


def without_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row, kept being binary; with digest, kept_sha256 instead."""
    if gram != 16 or length < gram + 1:
        raise ValueError("anchors are grams of 16 bytes, and windows must be longer")

    def finish(text, make, mask):
        raw = text or b""
        kept, spans = raw, 0
        if mask is not None:
            gone = np.zeros(len(raw), bool)
            gone[: len(mask)] = mask
            spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept

    plan = Plan(length, gram, _bytes, _resolver(length, memory), False, finish, f"n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}", MOST)
    return remove_repeats(docs, plan, np.uint8, id_col, text_col)
