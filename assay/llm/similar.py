"""Near copies by the exact Jaccard similarity of their five-word shingles.

MinHash bands only propose pairs; what links is the similarity of the whole
shingle sets. A pair at ``LEAST`` is in no common band with a probability of
``(1 - LEAST ** ROWS) ** BANDS``, three in a million; more similar pairs are
missed more rarely.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches, identified, small, stored, texts_as_bytes
from assay.llm.simhash import SEED, shingle_hashes

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: All pairs of a band's bucket are compared if it has at most so many rows.
#: Rows of larger ones are first compared with so many rows each, in so many rounds,
#: which takes large groups of near copies away in linear time; what is left is joined by rare shingles.
SMALL, CENTRES, ROUNDS = 8, 3, 3
#: Shingles hashed at once.
CHUNK = 4096


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 2**64 - 1, (2, BANDS * ROWS), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def shingle_set(text: bytes) -> np.ndarray:
    parts = list(shingle_hashes(text.lower().split(), WIDTH))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """Signed keys of the buckets of a shingle set; an empty set is in none."""
    if not len(shingles):
        return []
    times, flip = _CONSTANTS
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[at : at + CHUNK, None] ^ flip) * times).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


_CONSTANTS = _constants()


def _banded(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = [band_keys(shingle_set(t)) for t in texts_as_bytes(batch.column(1))]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([k for x in keys for k in x], pa.int64())], names=["id", "key"]
            )

    return docs.mapInArrow(run, "id long, key long")


def _sets(docs: DataFrame) -> DataFrame:
    """``(id, shingles)``: the sorted hashes of each text's shingles as bytes."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t).tobytes() for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def _links(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets in ``known`` are similar enough."""

    def compare(batches):
        for batch in batches:
            out, met = [], {}
            for b, text, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(text, np.uint64)
                for other in others:
                    a = other["a"]
                    if a not in met:
                        met[a] = np.frombuffer(other["shingles"], np.uint64)
                    both = len(np.intersect1d(own, met[a], assume_unique=True))
                    if both >= LEAST * (len(own) + len(met[a]) - both) - 1e-9:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = pairs.join(known.select(F.col("id").alias("a"), "shingles"), "a")
    met = met.join(known.select(F.col("id").alias("b"), F.col("shingles").alias("own")), "b")
    return met.select("b", "own", F.array(F.struct("a", "shingles")).alias("others")).mapInArrow(compare, "a long, b long")


def _rare_pairs(known: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``known(id, shingles)``, among them all whose similarity is ``LEAST`` or more.

    Shingles are ordered by the number of texts that have them, rarest first. A
    similar pair's first common shingle stands early in both texts: the longer
    text may have ``1 - LEAST`` of its shingles before it, the shorter one half
    of that, about. Texts that only share frequent passages never meet.
    """

    def shingles(batches):
        for batch in batches:
            for id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(own, np.int64)
                for at in range(0, len(own), CHUNK):
                    part = own[at : at + CHUNK]
                    columns = [np.full(len(part), id, np.int64), part, np.full(len(part), len(own), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "shingle", "n"])

    rows = stored(known.mapInArrow(shingles, "id long, shingle long, n long"))
    # written before the join, so that Spark may split a shingle with many texts
    counts = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")))
    order = Window.partitionBy("id").orderBy("texts", "shingle")
    ranked = rows.join(counts, "shingle").withColumn("at", F.row_number().over(order))
    common = LEAST / (1 + LEAST)
    long = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST - 1e-9) + 1)
    # a shingle of one text joins nothing
    long = stored(long.where("texts > 1").select("id", "shingle", "n", "at"))
    short = long.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * common - 1e-9) + 1)
    x, y = short.alias("x"), long.alias("y")
    met = x.join(y, F.expr("x.shingle = y.shingle AND (x.n < y.n OR x.n = y.n AND x.id < y.id)"))
    # no more than what follows in both can be common
    most = 1 + F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at"))
    return met.where(most >= common * (F.col("x.n") + F.col("y.n")) - 1e-9).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")
    ).distinct()


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: no two texts that stay have a similarity of ``LEAST`` or more.

    A text that goes is joined by a chain of such similarities to one that
    stays; which of two goes is drawn by a hash of their ids, at last by the
    ids. Null and empty texts have no shingles and stay; a text of fewer words
    than ``WIDTH`` is one shingle. Where ids are null or repeated, rows are told
    apart by numbers of their own. Other columns may have any name.
    """
    arrow_batches(docs.sparkSession)
    whole = identified(docs, id_col, text_col)
    texts = whole.select("id", "text")
    rows, gone, known = stored(_banded(texts)), [], None
    for turn in range(ROUNDS):
        draw = F.xxhash64("id", F.lit(turn))
        # other rows of a large bucket are the centres in each round
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct(draw, "id")).alias("centre"))
        # written before the join, so that Spark may split a bucket with many rows
        shared = stored(rows.join(stored(buckets.where("n > 1")), "key"))
        if known is None:
            # what later rounds compare is among these rows, so texts are read no more
            ids = small(stored(shared.select("id").distinct()))
            known = stored(_sets(texts.join(ids, "id", "left_semi")))
        few = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(draw, "id")))["id"].alias("ids"))
        # a bucket's pairs come from its own few ids; equal lists of several bands give them once
        few = few.select("ids").distinct().select(F.posexplode("ids").alias("at", "a"), "ids")
        pairs = few.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
        large = shared.where(F.col("n") > SMALL)
        # a row is compared with the centres of its largest buckets
        centres = F.sort_array(F.collect_set(F.struct("n", "centre")), asc=False)["centre"]
        star = large.groupBy("id").agg(F.slice(F.array_distinct(centres), 1, CENTRES).alias("centres"))
        star = star.select(F.explode("centres").alias("a"), F.col("id").alias("b")).where("a <> b")
        pairs = stored(pairs.unionByName(star).distinct())
        if pairs.isEmpty():
            break
        # of two the one drawn later goes, so some text of each chain is left to be compared with others
        gone.append(stored(_links(known, pairs).select(F.col("b").alias("gone")).distinct()))
        # only what was in a large bucket has pairs that weren't compared
        rows = stored(large.join(gone[-1], F.col("id") == F.col("gone"), "left_anti").select("id", "key"))
        if rows.isEmpty():
            break
    else:
        rest = small(stored(rows.select("id").distinct()))
        pairs = stored(_rare_pairs(known.join(rest, "id", "left_semi")))
        gone.append(stored(_links(known, pairs).select(F.greatest("a", "b").alias("gone")).distinct()))
    gone = small(stored(reduce(DataFrame.unionByName, gone).distinct())) if gone else None
    kept = whole if gone is None else whole.join(gone, F.col("id") == F.col("gone"), "left_anti")
    return kept.select("row.*")
