"""Exact top-k by integer inner product: columnar branch and bound.

Vectors are stored in blocks with one row per dimension (vertical layout). A
block's scores grow by groups of dimensions. After each group, the mass that
remains (the product of the norms of the remaining dimensions) bounds every
score, and candidates that can't reach any query's k-th best score are
compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches

SCALE = 1024
#: Vectors in a stored block, queries in a block, and queries scored at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 2048, 256
#: Dimensions added between two bounds.
GROUP = 16
#: Query blocks of at most so many bytes together are broadcast.
BROADCAST_BYTES = 8 << 20
#: Copies of each query block beyond that: the candidate blocks are dealt over them.
SALTS = 16
_EXACT = float(1 << 53)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``ids, data, dims, n`` of blocks; data is dims x n doubles, a dimension after the other."""

    def run(batches):
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def block():
            d = max(len(v) for v in vectors)
            matrix = np.zeros((d, len(vectors)))
            for i, v in enumerate(vectors):
                matrix[: len(v), i] = v
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([matrix.tobytes()], pa.binary()),
                    pa.array([d], pa.int32()),
                    pa.array([len(ids)], pa.int32()),
                ],
                names=["ids", "data", "dims", "n"],
            )

        for batch in batches:
            column = batch.column(1)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            for i, v in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, "ids binary, data binary, dims int, n int")


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products too large for doubles, by Python integers, held to the range of a long."""
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1)


def block_scores(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of queries ``q`` (n x d) with the candidates of ``x`` (d x m) that may matter.

    ``least`` is each query's k-th best score so far. Returns the scores and the
    columns they belong to; a column left out has no score at or above any
    query's ``least``.
    """
    d = max(q.shape[1], x.shape[0])
    q = np.pad(q, ((0, 0), (0, d - q.shape[1])))
    x = np.pad(x, ((0, d - x.shape[0]), (0, 0)))
    columns = np.arange(x.shape[1])
    if d == 0 or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d >= _EXACT:
        return (_exact_scores(q, x) if d else np.zeros((len(q), len(columns)))), columns
    rest_q = np.sqrt(np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1])
    rest_x = np.sqrt(np.cumsum((x * x)[::-1], axis=0)[::-1])
    scores = np.zeros((len(q), len(columns)))
    for at in range(0, d, GROUP):
        scores += q[:, at : at + GROUP] @ x[at : at + GROUP]
        after = at + GROUP
        if after < d and np.isfinite(least).any():
            # rounding of the norms is far below one
            reach = scores + rest_q[:, after, None] * rest_x[None, after] + 1
            keep = (reach >= least[:, None]).any(axis=0)
            if not keep.all():
                scores, x, rest_x, columns = scores[:, keep], x[:, keep], rest_x[:, keep], columns[keep]
            if not len(columns):
                break
    return scores, columns


class _Best:
    """The k best (score, id) of each query of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rows = np.empty(0, np.int64)
        self.scores = np.empty(0, object)
        self.found = np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for lo in range(0, len(self.ids), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            scores, columns = block_scores(self.vectors[part], x, self.least[part])
            if not len(columns):
                continue
            own = self.ids[part, None] == ids[None, columns]
            if scores.dtype == object:
                rows, at = np.nonzero(~own)
            else:
                scores[own] = -np.inf
                top = np.partition(scores, -self.k, axis=1)[:, -self.k] if len(columns) > self.k else np.full(len(scores), -np.inf)
                rows, at = np.nonzero((scores >= np.maximum(top, self.least[part])[:, None]) & (scores > -np.inf))
            self._keep(rows + lo, scores[rows, at], ids[columns[at]])

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.zeros(len(self.ids), bool)
        touched[rows] = True
        old = touched[self.rows]
        r = np.concatenate([self.rows[old], rows])
        s = np.concatenate([self.scores[old], np.array([int(v) for v in scores], object)]).astype(np.int64)
        i = np.concatenate([self.found[old], ids])
        by = np.lexsort((i, -s.astype(object) if (s == -(1 << 63)).any() else -s, r))
        r, s, i = r[by], s[by], i[by]
        first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        keep = place < self.k
        last = place == self.k - 1
        self.least[r[last]] = s[last]
        self.rows = np.concatenate([self.rows[~old], r[keep]])
        self.scores = np.concatenate([self.scores[~old], s[keep]])
        self.found = np.concatenate([self.found[~old], i[keep]])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.rows]), pa.array(self.found), pa.array(self.scores.astype(np.int64))],
            names=["query_id", "vec_id", "score"],
        )


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those with the query's own id. Components count as
    ``floor(1024 * x)``; shorter vectors count as padded with zeros. Vectors
    that are null, or hold null or non-finite components, and rows with a null
    id take no part. Ties go to the smaller id. Repeated rows are candidates as
    often as they come and one query. Scores beyond a long are held to its
    range. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
    )
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    n, dims = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-n // QUERY_BLOCK)
    # each task's share of the queries is one block, or a few where it has more
    queries = _blocks(asked.repartition(n_blocks), QUERY_BLOCK).select(
        F.xxhash64("ids").alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("n").alias("q_n")
    )
    stored = _blocks(rows, BLOCK)
    sent = n * max(1, dims) * 8 <= BROADCAST_BYTES
    if sent:
        # a bounded set of queries in blocks against all rows; candidates stay where they are
        met = stored.join(F.broadcast(queries))
    else:
        salted = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = stored.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
        met = spread.join(salted, "salt").repartition("block", "salt").sortWithinPartitions("block")
    met = met.select("block", "q_ids", "q_data", "q_n", "ids", "data", "n")

    def run(batches):
        states: dict[int, _Best] = {}
        for batch in batches:
            for b, qi, qd, qn, ci, cd, cn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b not in states:
                    if not sent:  # blocks come one after the other
                        yield from (x.batch() for x in states.values())
                        states.clear()
                    states[b] = _Best(np.frombuffer(qi, np.int64), np.frombuffer(qd).reshape(-1, qn).T.copy(), k)
                states[b].add(np.frombuffer(ci, np.int64), np.frombuffer(cd).reshape(-1, cn))
        yield from (x.batch() for x in states.values())

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
