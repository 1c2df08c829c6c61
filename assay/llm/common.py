"""Pieces the training-data operators share: lineage cuts, Arrow settings and
connected components over distributed edges."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch holds whole texts, so its size is bounded in bytes, not in rows.
BATCH_BYTES = 4 << 20
#: Ids are broadcast up to this number, some 16 MB.
BROADCAST_IDS = 1 << 20
#: Edges are joined in one task up to this number, also some 16 MB.
LOCAL_EDGES = 1 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound every Arrow batch sent to a Python worker by ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder, which all executors share.

    The folder is the one in ``spark.checkpoint.dir``. Only a local session
    without one (a test) gets a temporary folder; on a cluster it is an error,
    as executors can't read each other's disks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints, and read again.

    Unlike a checkpoint, empty partitions leave no file and small files are read
    together, so a small table stays cheap however many partitions made it.
    """
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        cut(df.sparkSession.range(0))
    path = f"{context.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(ids: DataFrame) -> DataFrame:
    """``ids`` (a materialised column of longs), to be broadcast if there are at most ``BROADCAST_IDS`` of them.

    More of them meet the other side in a shuffle.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def texts_as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id long, text, row``: unique ids, the text, and all columns in one struct, so that no name clashes.

    Ids are the given ones unless some are null or repeated; then rows get numbers of their own.
    """
    own = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")]
    rows = docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    n, known, apart = rows.agg(F.count(F.lit(1)), F.count("id"), F.countDistinct("id")).first()
    return rows if n == known == apart else cut(rows.withColumn("id", F.monotonically_increasing_id()))


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; every leaf ends up pointing at its root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _joined(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of a bounded number of edges, by one task."""

    def run(batches):
        ends = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches]
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            parent = np.arange(len(nodes))
            union(parent, at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    ``root`` is the smallest node of the component; every node that has an edge
    to another node gets a row, self-loops and null ends are ignored. Large-star
    and small-star steps alternate until nothing changes, so a star with a
    third of all nodes is only ever reduced by pre-aggregated minima. Each round
    is written, and the one before it deleted. Once at most ``local_edges`` are
    left, one task joins them; the result is the same.
    """
    spark = edges.sparkSession
    swap = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = _stored(edges.where("a <> b").select(swap.alias("e")).select("e.a", "e.b").distinct())
    before = _fingerprint(now)
    while before[0] > local_edges:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, between = _stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, (now, path) = path, _stored(small)
        _delete(spark, old)
        _delete(spark, between)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        return _joined(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
