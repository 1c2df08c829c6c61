"""Bottom-k sketches of word shingles.

A sketch holds the ``K`` smallest distinct 48-bit hashes of a text's shingles.
Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles. A sketch with
fewer than ``K`` hashes holds them all, and is exact.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches
from assay.llm.simhash import shingle_hashes

K = 256
WIDTH = 5
_SPACE = 1 << 48


def sketch(text: bytes, width: int = WIDTH, k: int = K) -> np.ndarray:
    """Sorted hashes of the lower-cased (A-Z) text; fewer words count as one shingle, no words as none."""
    least = np.empty(0, np.uint64)
    for hashes in shingle_hashes(text.lower().split(), width):
        hashes = hashes >> np.uint64(16)
        least = np.unique(np.concatenate([least, hashes]))[:k]
    return least


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.unique(np.concatenate([a, b]))[:k]


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Hashes that both, a, and either have, as far as both sketches are complete."""
    limit = min([s[-1] for s in (a, b) if len(s) == k], default=np.uint64(_SPACE))
    a, b = a[a <= limit], b[b <= limit]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a), len(a) + len(b) - both


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; 1 for two texts without shingles."""
    both, _, either = _common(a, b, k)
    return both / either if either else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    both, own, _ = _common(a, b, k)
    return both / own if own else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _SPACE)


def encode(a: np.ndarray) -> str:
    """Base64 of six big-endian bytes a hash; empty for no shingles."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def sketches(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``key, fingerprint`` of each row; null text counts as empty. Rows of a key may be parts of one text set."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = [encode(sketch((t or "").encode(), width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "fingerprint"])

    kind = docs.schema[key_col].dataType.simpleString()
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fingerprint string")


#: Parts merged by one task before the groups meet.
MERGE_SALTS = 32


def merged(parts: DataFrame) -> DataFrame:
    """One ``key, fingerprint`` per key from sketches of its parts.

    Parts of a key meet in two rounds, so a key with most of the rows isn't
    gathered into one task. A null fingerprint counts as empty.
    """

    def join(table: pa.Table) -> pa.Table:
        out = np.empty(0, np.uint64)
        for text in table.column("fingerprint").to_pylist():
            out = merge(out, decode(text or ""))
        return table.slice(0, 1).select(["key"]).append_column("fingerprint", pa.array([encode(out)]))

    kind = parts.schema["key"].dataType.simpleString()
    first = parts.select("key", "fingerprint", F.pmod(F.xxhash64("fingerprint"), F.lit(MERGE_SALTS)).alias("salt"))
    first = first.groupBy("key", "salt").applyInArrow(join, f"key {kind}, fingerprint string")
    return first.groupBy("key").applyInArrow(join, f"key {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the first as many characters of the next, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row per input row. The next document is the
    one with the next smaller id; after the last comes the first. Null ids come
    last; rows of equal id follow their texts' order; a single document is its
    own next. Null text counts as empty. Other columns are ignored.

    Texts are dealt once, into id ranges. The first rows of a range also go to
    the range above it, whose last row they follow; the very first to the last
    range.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = [float(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)]
    bounds = sorted(set(bounds))
    fence = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    # a range's number is that of the bounds below it
    number = F.size(F.filter(fence, lambda b: b < F.col("doc_id").cast("double")))
    heads = rows.select("doc_id", number.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted(heads, key=lambda r: r["range"])
    # by range number: its largest id, and the range above it; the topmost wraps to the lowest
    head, above = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for below, upper in zip(heads, heads[1:] + heads[:1], strict=True):
        head[below["range"]], above[below["range"]] = below["head"], upper["range"]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), number + 1)

    own = F.struct(number.alias("range"), F.lit(False).alias("halo"))
    ahead = F.struct(of(above, "int").alias("range"), F.lit(True).alias("halo"))
    targets = [own, F.when(F.col("doc_id").eqNullSafe(of(head, "long")), ahead)]
    dealt = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(*targets))).alias("t")).select(
        "doc_id", "text", "t.range", "t.halo"
    )
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "halo", F.desc_nulls_last("doc_id"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # range, id, text, sketch of the row that waits for its next
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, at, halo in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if halo and (last is None or last[0] != at):
                    continue  # a further head of the same id
                own = sketch(text.encode(), width)
                if last is not None and last[0] == at:
                    _, before, was, sketched = last
                    new = edited(was, text).encode()
                    changed = sketch(new, width)
                    row = (
                        before,
                        len(was),
                        hashlib.sha256(new).hexdigest(),
                        encode(sketched),
                        encode(changed),
                        resemblance(sketched, changed),
                        resemblance(sketched, own),
                    )
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                last = None if halo else (at, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return dealt.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
