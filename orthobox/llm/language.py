"""Language identification by word-first backoff.

Fitting counts words and the character n-grams of words (2 to MAX_GRAM, with word ends marked) per language over labelled
texts. From each language at most MAX_TEXTS texts, those whose hash comes first, and of each the whole text, are used; the
VOCABULARY most frequent words and GRAMS n-grams are kept, so the model has a bound that no input exceeds; it is
broadcast as sorted 64-bit hashes with a row of scores each.

A word of a text that the vocabulary knows is scored by its log frequency in each language; a language that lacks it counts
it as half an occurrence in the language with most words, so that little data is no advantage. Any other word is scored
by its n-grams of the longest length of which it has a known one: it backs off to progressively shorter n-grams. The score
of a word from n-grams is the mean of theirs. A text's score for a language is the mean over its words; the best language
is predicted, ties going to the first by name. `score` is the best language's share among exp(mean * SHARPNESS).

Words are maximal runs of letters, lower-cased. Cases: null text and text without a letter give 'und' with score 0, as does
every text if there are no labelled texts; repeated rows get the same result; empty tables give no rows; extra columns are
kept, but for lang_pred and score, which are replaced. Prediction uses the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.llm.shared import spare

MAX_TEXTS, VOCABULARY, GRAMS, MAX_GRAM, SHARPNESS = 1000, 60_000, 60_000, 4, 1.0
KNOWN_WORDS, AT_ONCE = 250_000, 500  # words that a task keeps the scores of; texts that it looks at at a time
CELL_BITS = 12
_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict:
    """labelled(lang, text, id) -> the model, a dictionary of plain and NumPy values."""
    from pyspark.sql import Window

    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    hashed = known.select("lang", "id", F.xxhash64("id", F.lit("fit")).alias("h")).withColumn("cell", F.shiftright("h", 64 - CELL_BITS))
    # The first of a language by hash. Counts of 2 ** CELL_BITS cells a language tell where to stop, so that little beyond
    # the first MAX_TEXTS is ever ranked.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("cell"))
    cells = hashed.groupBy("lang", "cell").agg(F.count("*").alias("n")).withColumn("upto", upto)
    last = cells.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= MAX_TEXTS, F.col("cell"))), F.max("cell")).alias("last"))
    near = hashed.join(F.broadcast(last), "lang").where("cell <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    keys = near.withColumn("rank", rank).where(F.col("rank") <= MAX_TEXTS).select("lang", "id").distinct()
    sample = known.join(F.broadcast(keys), ["lang", "id"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(text_words(text)).items():
                    counts[lang, 0, word] += n
                    for size in range(2, MAX_GRAM + 1):
                        for gram in word_grams(word, size):
                            counts[lang, size, gram] += n
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "size": pa.array([k[1] for k in counts], pa.int32()), "token": [k[2] for k in counts], "n": pa.array(counts.values(), pa.int64())}, schema=pa.schema([("lang", pa.string()), ("size", pa.int32()), ("token", pa.string()), ("n", pa.int64())]))

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    total = Window.partitionBy("lang", "size")
    best = F.row_number().over(total.orderBy(F.desc("n"), "token"))
    ranked = counted.withColumn("all", F.sum("n").over(total)).withColumn("rank", best)
    # A token that is kept for one language keeps its counts in all.
    kept = ranked.withColumn("rank", F.min("rank").over(Window.partitionBy("size", "token"))).where(F.col("rank") <= F.when(F.col("size") == 0, VOCABULARY).otherwise(GRAMS))
    # At most languages * (VOCABULARY + GRAMS * (MAX_GRAM - 1)) different tokens; their hashes come, not their texts.
    rows = kept.select("lang", "size", F.xxhash64("token").alias("token"), "n", "all").toArrow()
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    tables: dict[int, tuple] = {}
    for s in (0, *range(2, MAX_GRAM + 1)):
        own = rows.filter(pc.equal(rows.column("size"), s))
        tokens, at = np.unique(own.column("token").to_numpy().view(np.uint64), return_inverse=True)
        lang = pc.index_in(own.column("lang"), pa.array(langs, pa.string())).to_numpy()
        n, totals = np.zeros((len(tokens), len(langs))), np.ones(len(langs))
        n[at, lang] = own.column("n").to_numpy()
        totals[lang] = own.column("all").to_numpy()
        tables[s] = tokens, np.log(np.where(n > 0, n / totals, 0.5 / max(totals, default=1.0))).astype(np.float32)
    return {"langs": langs, "tables": tables}


def _hashes(tokens: list[str]) -> np.ndarray:
    """What F.xxhash64 gives: XXH64 of UTF-8 with seed 42."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in tokens], np.uint64)


class Scorer(dict):
    """Word -> number of its row of scores, for the words met so far; lives as long as the task that made it."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        self.rows = np.empty((0, len(self.langs)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """The log scores of words, a row each: words first, then n-grams, longest first."""
        out = np.full((len(words), len(self.langs)), np.log(1e-7), np.float32)
        todo = np.arange(len(words))
        for n in (0, *range(MAX_GRAM, 1, -1)):
            tokens, logs = self.tables[n]
            if not len(todo) or not len(tokens):
                continue
            grams = [[words[k]] if n == 0 else word_grams(words[k], n) for k in todo.tolist()]
            owner = np.repeat(np.arange(len(todo)), [len(g) for g in grams])
            h = _hashes([g for own in grams for g in own])
            at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
            known = tokens[at] == h
            owner, at = owner[known], at[known]
            count = np.bincount(owner, minlength=len(todo))
            met = count > 0
            for k in range(len(self.langs)):
                out[todo[met], k] = np.bincount(owner, logs[at, k], len(todo))[met] / count[met]
            todo = todo[~met]
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Scores the words of texts that are new."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.rows = np.concatenate([self.rows, self.score(new)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [text_words(t) for t in texts] if self.langs else []
        self.learn(words)
        return [self._best(w) for w in words] if self.langs else [("und", 0.0)] * len(texts)

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        mean = self.rows[np.fromiter(map(self.__getitem__, words), np.intp, len(words))].mean(axis=0, dtype=float)
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp((mean - mean[best]) * SHARPNESS).sum())


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = [p for k in range(0, len(texts), AT_ONCE) for p in scorer.predict(texts[k : k + AT_ONCE].tolist())]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    p = spare(docs, "predicted")
    return docs.withColumn(p, predict(F.col(text_col))).withColumns({"lang_pred": F.col(f"{p}.lang_pred"), "score": F.col(f"{p}.score")}).drop(p)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2
