"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word is read as
character n-grams of the word between boundary marks: at each place the longest
known n-gram counts, from ``NGRAM`` characters down to one.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches

#: At about this many documents of each language the model is fitted; they are
#: those with the smallest hashes of their ids.
TRAIN_DOCS = 300
#: A word is known if the sample holds it this often.
MIN_COUNT = 3
NGRAM = 5
#: Added to each count.
SMOOTH = 0.5
#: Words scored once per worker are kept until there are so many.
CACHE = 400_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """Log frequencies by language for words and for n-grams."""

    langs: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]

    def score_word(self, word: str) -> tuple[float, ...]:
        """Log likelihoods by language; only their differences carry meaning."""
        return tuple(Scorer(self).rows([word])[0].tolist())


def fit_counts(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, word, count) rows."""
    langs = tuple(sorted({lang for lang, _, _ in counts}))
    at = {lang: i for i, lang in enumerate(langs)}
    rows: dict[str, int] = {}
    for _, word, _ in counts:
        rows.setdefault(word, len(rows))
    table = np.zeros((len(rows), len(langs)))
    for lang, word, n in counts:
        table[rows[word], at[lang]] += n

    def logs(keys: dict[str, int], sums: np.ndarray, least: float) -> dict:
        parts = np.log((sums + SMOOTH) / (sums.sum(axis=0) + SMOOTH * len(sums)))
        known = sums.sum(axis=1) >= least
        return {key: tuple(parts[i].tolist()) for key, i in keys.items() if known[i]}

    # a word type counts by the log of its tokens, so frequent words don't own their n-grams
    weights = np.log1p(table)
    grams: dict = {}
    for n in range(1, NGRAM + 1):
        keys: dict[str, int] = {}
        places, owners = [], []
        for word, i in rows.items():
            text = f"<{word}>"
            here = [keys.setdefault(text[k : k + n], len(keys)) for k in range(len(text) - n + 1)]
            places += here
            owners += [i] * len(here)
        sums = np.zeros((len(keys), len(langs)))
        np.add.at(sums, places, weights[owners])
        grams |= logs(keys, sums, math.log1p(MIN_COUNT))
    return Model(langs, logs(rows, table, MIN_COUNT), grams)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``TRAIN_DOCS`` labelled documents of each language.

    Rows with null text or null language are left out. Two passes: sizes of the
    languages, then the words of rows whose id hash is small enough.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("draw"),
    )
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        most = (1 << 30) if n <= TRAIN_DOCS else (1 << 30) * TRAIN_DOCS // n
        chosen = chosen | ((F.col("lang") == lang) & (F.col("draw") < most))

    def count(batches):
        for batch in batches:
            table: dict = defaultdict(int)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in words_of(text):
                    table[lang, word] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in table], pa.string()),
                    pa.array([k[1] for k in table], pa.string()),
                    pa.array(list(table.values()), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )

    counts = (
        rows.where(chosen)
        .select("lang", "text")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    # all words of the sample, whose bound is that of its documents; in one order, so that sums are the same
    return fit_counts(sorted(tuple(r) for r in counts.collect()))


class Scorer:
    """Scores texts with a model, remembering words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.gram_at = {gram: i for i, gram in enumerate(model.grams)}
        self.gram_rows = np.array([*model.grams.values()]).reshape(len(model.grams), len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs) + 1))

    def _places(self, word: str) -> list[int]:
        """At each place of the marked word, the longest known n-gram."""
        text, get, out = f"<{word}>", self.gram_at.get, []
        for i in range(len(text)):
            for n in range(min(NGRAM, len(text) - i), 0, -1):
                got = get(text[i : i + n])
                if got is not None:
                    out.append(got)
                    break
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of each word by language."""
        out = np.zeros((len(words), len(self.model.langs)))
        unseen, flat, counts = [], [], []
        for k, word in enumerate(words):
            known = self.model.words.get(word)
            if known is not None:
                out[k] = known
            elif places := self._places(word):
                unseen.append(k)
                flat += places
                counts.append(len(places))
        if unseen:
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            # an unseen word weighs as much as one place: its n-grams overlap
            out[unseen] = np.add.reduceat(self.gram_rows[flat], starts) / np.array(counts)[:, None]
        return out

    def learn(self, words: set[str]) -> None:
        """Score and remember words not met so far."""
        new = [w for w in words if w not in self.at]
        size = len(self.at) + len(new)
        if size > len(self.table):
            grown = np.zeros((2 * size, self.table.shape[1]))
            grown[: len(self.table)] = self.table
            self.table = grown
        letters = [w for w in new if any(map(str.isalpha, w))]
        for w in letters + [w for w in new if not any(map(str.isalpha, w))]:
            self.at[w] = len(self.at)
        at = slice(size - len(new), size - len(new) + len(letters))
        self.table[at, :-1], self.table[at, -1] = self.rows(letters), 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.at) > CACHE:
            self.clear()
        distinct = set(words)
        if not distinct <= self.at.keys():
            self.learn(distinct)
        sums = self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
        if not sums[-1]:
            return UNKNOWN, 0.0
        logs = sums[:-1]
        best = int(np.argmax(logs))
        return self.model.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but those named so, then ``lang_pred, score``.

    Null text, empty text and text without letters give ``und`` and score 0;
    ties go to the language that sorts first; so do all texts if the model has
    no language. Texts of any length are read whole. Repeated rows stay.
    """
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.drop("lang_pred", "score")
    at = [c.lower() for c in keep.columns].index(text_col.lower())

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            got = [scorer(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return keep.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` with a model fitted on the rows not held out."""
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
