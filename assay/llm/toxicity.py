"""Toxicity categories by a classifier chain over hashed word and character features.

Categories are predicted one after the other. The model of a category sees the
features of a document and the probabilities of the categories before it; in
training those are out-of-fold predictions, so a later model meets the same
kind of errors that it will meet in use.

A document's features are its words and their character n-grams, hashed into a
fixed number of buckets. No feature is chosen beforehand: an L1 penalty leaves
most weights at zero, whatever a feature's share of the documents, so words of
rare languages, inflected and re-spelt ones count as those of common ones.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches
from assay.llm.simhash import shingle_hashes

#: At most about so many labelled documents are fitted on: those with the
#: smallest hashes of their ids.
TRAIN_DOCS = 4_000
#: Buckets that features are hashed into.
BUCKETS = 1 << 20
#: Blocks of 2^16 buckets.
BLOCKS = -(-BUCKETS >> 16)
#: Lengths of character n-grams, marks of the word's ends included.
GRAMS = (4, 5, 6)
FOLDS = 5
#: What a weight costs by its absolute value, against losses summed over documents.
PENALTY = 1.0
#: Reported probabilities are shifted so that this one divides best.
THRESHOLD = 0.5
#: Features that join the active ones at once, and gradient steps on those before more join.
JOINING, STEPS = 300, 150
#: The least share of its loss by which a model's next features must lower it.
GAIN = 0.02
#: Entries of a sparse matrix that are worked on at once.
CHUNK = 1 << 20
#: Words whose features a worker remembers.
CACHE = 400_000

_WORD = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1+")
#: Signs that are written for letters they look like.
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words that hold a letter."""
    return set(filter(_LETTER.search, set(_WORD.findall(text.lower()))))


def folded(word: str) -> str:
    """A word as it would be spelt plainly: look-alike signs as letters, runs of a letter as one."""
    return _RUN.sub(r"\1", word.translate(_LOOKS))


def buckets_of(word: str) -> list[int]:
    """Buckets of a word: the folded word itself and its n-grams between marks."""
    text = f"<{folded(word)}>"
    parts = [text, *(text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


# ---- fitting ------------------------------------------------------------------


class Design:
    """A sparse matrix of zeros and ones: the distinct feature numbers of each row, row after row."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, n_features: int):
        self.features, self.counts, self.n_features = features.astype(np.int32, copy=False), counts.astype(np.int64), n_features
        ends = np.cumsum(self.counts)
        # rows are dealt into chunks, so that no temporary is as long as the matrix
        cuts = np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK))
        rows = np.unique([0, *cuts.tolist(), len(counts)])
        begins = np.concatenate(([0], ends))
        self.chunks = [(a, b, int(begins[a]), int(begins[b])) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        self.full, self.begins = self.counts > 0, begins[:-1]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.counts))
        for a, b, lo, hi in self.chunks:
            if hi > lo:
                full = np.flatnonzero(self.full[a:b]) + a
                out[full] = np.add.reduceat(w[self.features[lo:hi]], self.begins[full] - lo)
        return out

    def sums(self, r: np.ndarray) -> np.ndarray:
        """For each feature, the sum of ``r`` over the rows that have it."""
        out = np.zeros(self.n_features)
        for a, b, lo, hi in self.chunks:
            out += np.bincount(self.features[lo:hi], np.repeat(r[a:b], self.counts[a:b]), self.n_features)
        return out

    def only(self, chosen: np.ndarray) -> Design:
        """The chosen features, numbered anew in their order."""
        number = np.full(self.n_features, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        parts, counts = [np.empty(0, np.int32)], np.zeros(len(self.counts), np.int64)
        for a, b, lo, hi in self.chunks:
            to = number[self.features[lo:hi]]
            own = to >= 0
            parts.append(to[own])
            counts[a:b] = np.bincount(np.repeat(np.arange(b - a), self.counts[a:b])[own], minlength=b - a)
        return Design(np.concatenate(parts), counts, len(chosen))


def fit_linear(
    x: Design, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, at_first: np.ndarray | None = None
) -> np.ndarray:
    """Weights of ``x``'s features, then of the ``dense`` columns, then the intercept, of an L1-penalised logistic regression.

    Rows of weight zero take no part. The features that the gradient pulls at
    most join the active ones in turn, until it pulls at none of the others
    more than the penalty holds, or until more features lower the penalised
    loss by less than ``GAIN`` of it. ``at_first`` are active from the start.
    """
    extra = np.column_stack([dense, np.ones(len(y))])
    w, v = np.zeros(x.n_features), np.zeros(extra.shape[1])
    mean = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6))
    v[-1] = np.log(mean / (1 - mean))
    active, score, loss = np.empty(0, np.int64), extra @ v, np.inf
    while True:
        pull = np.abs(x.sums(weight * (_sigmoid(score) - y)))
        pull[active] = 0
        # what is within the solver's precision counts as held
        over = np.flatnonzero(pull > penalty * 1.05 + 1e-9)
        if not len(over) and at_first is None:
            return np.concatenate([w, v])
        joining = over[np.argsort(-pull[over], kind="stable")[:JOINING]]
        active = np.unique(np.concatenate([active, joining, at_first if at_first is not None else joining]))
        at_first = None
        own = x.only(active)
        w[active], v = _proximal(own, extra, y, weight, penalty, w[active], v)
        score = own.times(w[active]) + extra @ v
        before, loss = loss, float(weight @ (np.logaddexp(0, score) - y * score) + penalty * (np.abs(w).sum() + np.abs(v[:-1]).sum()))
        if before - loss < GAIN * loss:
            return np.concatenate([w, v])


def _proximal(x: Design, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, w: np.ndarray, v: np.ndarray):
    """Accelerated proximal gradient steps; each weight's step is bounded by the curvature of the rows that have it."""
    load = weight * (x.counts + extra.shape[1]) / 4
    step_w = 1 / np.maximum(x.sums(load), 1e-9)
    step_v = 1 / np.maximum(load @ extra**2, 1e-9)
    # the intercept costs nothing
    cost_v = np.append(np.full(len(v) - 1, penalty), 0.0)
    zw, zv, t = w, v, 1.0
    for _ in range(STEPS):
        r = weight * (_sigmoid(x.times(zw) + extra @ zv) - y)
        aw, av = zw - step_w * x.sums(r), zv - step_v * (r @ extra)
        nw = np.sign(aw) * np.maximum(np.abs(aw) - step_w * penalty, 0)
        nv = np.sign(av) * np.maximum(np.abs(av) - step_v * cost_v, 0)
        # momentum starts anew where it points uphill
        uphill = ((zw - nw) / step_w) @ (nw - w) + ((zv - nv) / step_v) @ (nv - v) > 0
        following = 1.0 if uphill else (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = 0.0 if uphill else (t - 1) / following
        moved = max(np.abs(nw - w).max(initial=0), np.abs(nv - v).max())
        zw, zv, t, w, v = nw + ahead * (nw - w), nv + ahead * (nv - v), following, nw, nv
        if moved < 1e-3:
            break
    return w, v


@dataclass(frozen=True)
class Chain:
    """Numbers of the buckets that any model weighs, categories in order, and the weights of each category's model.

    A model's weights are those of the numbered buckets, of the earlier
    categories' probabilities, and the intercept. ``dividing`` are the log-odds
    that are reported as ``THRESHOLD``.
    """

    numbers: dict[int, int]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    dividing: tuple[float, ...]

    def predict(self, x: Design) -> np.ndarray:
        """Reported probabilities (rows x categories)."""
        n, earlier, out = len(self.numbers), np.zeros((len(x.counts), 0)), np.zeros((len(x.counts), len(self.categories)))
        for k, (w, middle) in enumerate(zip(self.weights, self.dividing, strict=True)):
            score = x.times(w[:n]) + earlier @ w[n:-1] + w[-1]
            earlier = np.column_stack([earlier, _sigmoid(score)])
            out[:, k] = _sigmoid(score - middle)
        return out


def best_division(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds that divide the rows with the best F1, between the two rows they part."""
    by = np.argsort(-score, kind="stable")
    score, hit, all_ = score[by], np.cumsum((weight * y)[by]), np.cumsum(weight[by])
    if not len(score) or not hit[-1]:
        return 0.0
    last = np.append(score[1:] != score[:-1], True)
    f1 = np.where(last, 2 * hit / (all_ + hit[-1]), 0)
    k = int(np.argmax(f1))
    return float((score[k] + score[k + 1]) / 2) if k + 1 < len(score) else float(score[k]) - 1.0


def fit_chain(x: Design, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, names: np.ndarray, categories: list[str]) -> Chain:
    """Fit the chain; ``fold`` numbers the rows' folds from 0, ``names`` has the bucket of each feature of ``x``."""
    earlier, fitted, dividing = np.zeros((len(y), 0)), [], []
    for k in range(len(categories)):
        whole = fit_linear(x, earlier, y[:, k], weight)
        used = np.flatnonzero(whole[: x.n_features])
        score = np.empty(len(y))
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                # models of the folds start at zero; which features they look at first doesn't change where they end
                part = whole if own.all() else fit_linear(x, earlier, y[:, k], weight * ~own, at_first=used)
                n = x.n_features
                score[own] = (x.times(part[:n]) + earlier @ part[n:-1] + part[-1])[own]
        fitted.append(whole)
        dividing.append(best_division(score, y[:, k], weight))
        earlier = np.column_stack([earlier, _sigmoid(score)])
    kept = np.flatnonzero(np.any([w[: x.n_features] != 0 for w in fitted], axis=0))
    weights = tuple(np.concatenate([w[kept], w[x.n_features :]]) for w in fitted)
    return Chain({int(b): i for i, b in enumerate(names[kept])}, tuple(categories), weights, tuple(dividing))


def _likeness(text: str) -> int:
    """The least hash of the five-word shingles: copies and near copies mostly share it."""
    least = min((int(h.min()) for h in shingle_hashes(text.encode().lower().split(), 5)), default=0)
    return least >> 1


def _packed(found: np.ndarray) -> bytes:
    """Bucket numbers in ascending order: how many each block has, then their places in it in two bytes each."""
    return np.bincount(found >> 16, minlength=BLOCKS).astype("<u4").tobytes() + (found & 0xFFFF).astype("<u2").tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    sizes = np.frombuffer(data, "<u4", BLOCKS)
    return np.repeat(np.arange(BLOCKS, dtype=np.int32) << 16, sizes) + np.frombuffer(data, "<u2", int(sizes.sum()), 4 * BLOCKS)


def _sample(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str) -> pa.Table:
    """``copy, buckets`` (``_packed``) and the categories of the documents fitted on."""
    marks = labels.select(id_col, *categories).dropna().groupBy(id_col).agg(*(F.max(c).cast("int").alias(c) for c in categories))
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    most = (1 << 30) if n <= TRAIN_DOCS else (1 << 30) * TRAIN_DOCS // n
    marks = marks.where(draw < most)
    # the sampled labels are bounded, the documents are not
    rows = (
        docs.where(draw < most)
        .select(id_col, F.col(text_col).alias("text"))
        .where("text is not null")
        .join(F.broadcast(marks), id_col)
        .select("text", *categories)
    )
    names = ["copy", "buckets", *categories]

    def read(batches):
        met: dict[str, list[int]] = {}
        for batch in batches:
            copies, found = [], []
            for text in batch.column(0).to_pylist():
                own: set[int] = set()
                for word in words_of(text):
                    if word not in met:
                        met[word] = buckets_of(word)
                    own.update(met[word])
                if len(met) > CACHE // 10:
                    met.clear()
                copies.append(_likeness(text))
                found.append(_packed(np.sort(np.fromiter(own, np.int32, len(own)))))
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(found, pa.binary()), *batch.columns[1:]], names=names)

    kinds = ", ".join(f"`{c}` int" for c in categories)
    return rows.mapInArrow(read, f"copy long, buckets binary, {kinds}").toArrow()


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on about ``TRAIN_DOCS`` labelled documents.

    Rows of ``labels`` with a null id or category are left out; of several rows
    for an id, the greatest labels count. Documents whose least shingle hashes
    agree share the weight of one and a fold, so a group of copies isn't learnt
    by heart. Without labelled documents every probability is 0.
    """
    arrow_batches(docs.sparkSession)
    table = _sample(docs, labels, categories, id_col, text_col)
    if not table.num_rows:
        return Chain({}, tuple(categories), tuple(np.array([0.0] * k + [-50.0]) for k in range(len(categories))), (0.0,) * len(categories))
    y = np.column_stack([table.column(c).to_numpy() for c in categories]).astype(float)
    copy = table.column("copy").to_numpy()
    x, names, by = _design(table.column("buckets"), copy, y)
    del table
    y, copy = y[by], copy[by]
    _, group, size = np.unique(copy, return_inverse=True, return_counts=True)
    return fit_chain(x, y, 1 / size[group], copy % FOLDS, names, categories)


def _design(found: pa.ChunkedArray, copy: np.ndarray, y: np.ndarray) -> tuple[Design, np.ndarray, list[int]]:
    """The matrix of packed rows, the bucket of each of its features, and the order its rows are in.

    The order is the same however tasks dealt the rows. Rows are unpacked one by
    one, so besides the packed rows only the matrix itself, four bytes an entry,
    is in memory.
    """
    ties = groupby(np.argsort(copy, kind="stable").tolist(), key=lambda i: copy[i])
    by = [i for _, tied in ties for i in sorted(tied, key=lambda i: (_unpacked(found[i].as_buffer()).tobytes(), y[i].tolist()))]
    seen, counts = np.zeros(BUCKETS, bool), np.zeros(len(by), np.int64)
    for k, i in enumerate(by):
        own = _unpacked(found[i].as_buffer())
        seen[own], counts[k] = True, len(own)
    number = np.cumsum(seen, dtype=np.int32) - 1
    features, ends = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
    for k, i in enumerate(by):
        features[ends[k] - counts[k] : ends[k]] = number[_unpacked(found[i].as_buffer())]
    names = np.flatnonzero(seen)
    return Design(features, counts, len(names)), names, by


# ---- scoring ------------------------------------------------------------------


class Reader:
    """Reads texts for a chain, remembering which features each word has."""

    def __init__(self, chain: Chain):
        self.numbers = chain.numbers
        self.met: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.met) >= CACHE:
            self.met.clear()
        get = self.numbers.get
        found = tuple({i for b in buckets_of(word) if (i := get(b)) is not None})
        self.met[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> Design:
        flat: list[int] = []
        counts = []
        for text in texts:
            own: set[int] = set()
            for word in words_of(text) if text else ():
                found = self.met.get(word)
                if found is None:
                    found = self._learn(word)
                if found:
                    own.update(found)
            flat += sorted(own)
            counts.append(len(own))
        return Design(np.array(flat, np.int32), np.array(counts), len(self.numbers))


def predict(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``p_<category>`` for each category, replacing columns named so.

    Null and empty texts have no words and get the probabilities of a text
    without known features. Texts are read whole; repeated rows stay.
    """
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.categories]
    keep = docs.drop(*added)
    at = [c.lower() for c in keep.columns].index(text_col.lower())

    def run(batches):
        reader = Reader(held.value)
        for batch in batches:
            p = held.value.predict(reader(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*batch.schema.names, *added]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return keep.mapInArrow(run, ", ".join([schema, *(f"`{c}` double" for c in added)]))


def fit_labelled(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of low quality (``quality`` = 0) and then toxic, from ``labels(doc_id, quality, toxic)``."""
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit(docs.select("doc_id", "text"), marks, ["low_quality", "toxic"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_low_quality, p_toxic, toxic``, one row per input row; other columns are ignored."""
    rows = predict(docs.select("doc_id", "text"), fit_labelled(docs, labels))
    return rows.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
