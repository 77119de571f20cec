"""Word-level substring dedup by suffix automata of reference shards and matching statistics.

A word is removed if some window of `length` words that covers it also starts earlier in the corpus: in a document with a
smaller id, or before in the same one. The reference is the corpus itself, so its automata would outgrow any broadcast; the
reference is therefore cut into shards by window content (see repeats.py), and what could match a shard is routed to it
instead. In a shard the different pieces with a common anchor are taken in order of their first places. Each is streamed
through the suffix automaton of those before it: the matching statistic of a position is the length of the longest suffix
that occurs in them, and where it reaches `length` the window that ends there has occurred earlier. Then the piece is added
to the automaton. Overlapping windows make the maximal spans. An automaton is bounded by MOST words: an anchor with more is split
into parts that share no window, each with an automaton of its own, so a hot phrase in varying text does not make it grow.

Cases: null and empty texts have no words and nothing removed; rows that share an id count as one document, in order of their
texts; rows without an id come last; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from orthobox.llm.near_dedup import WordHashes
from orthobox.llm.repeats import Plan, remove_repeats


MOST = 1 << 18  # words of an automaton, about 100 MB; an anchor with more is split (see repeats.py)


class SuffixAutomaton:
    """Of several sequences of hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the strings of q of at most length[p] + 1 symbols; q itself if that is all."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def matching_statistics(self, sequence) -> list[int]:
        state, size, out = 0, 0, []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            out.append(size)
        return out


def _resolver(length: int):
    def resolve(pieces: list[np.ndarray], ids: list[int], hashes: list[int]) -> list[np.ndarray]:
        automata: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            automata.setdefault(h, []).append(k)
        masks: list = [None] * len(pieces)
        for members in automata.values():
            known = SuffixAutomaton()
            for k in members:  # in order of first places
                words = pieces[k].tolist()
                masks[k] = np.array(known.matching_statistics(words)[length - 1 :]) >= length
                known.add(words)
        return masks

    return resolve


def _words():
    hashes = WordHashes()
    return lambda text: hashes.of(text.split()) if text else np.empty(0, np.uint64)


def _result(text: bytes | None, make, mask: np.ndarray | None) -> tuple:
    words = text.split() if text else []
    kept = words
    if mask is not None:
        kept = [w for w, gone in zip(words, mask.tolist()) if not gone] + words[len(mask) :]
    return len(words), len(words) - len(kept), b" ".join(kept)


def without_repeated_words(docs: DataFrame, length: int = 20, gram: int = 10, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row; with digest, kept_sha256 instead of kept_text."""

    def finish(text, make, mask):
        n, gone, kept = _result(text, make, mask)
        return n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()

    plan = Plan(length, gram, _words, _resolver(length), True, finish, f"n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string", MOST)
    return remove_repeats(docs, plan, np.uint64, id_col, text_col)
