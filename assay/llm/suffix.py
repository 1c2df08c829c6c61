"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Every window of ``length`` bytes that starts earlier elsewhere is a repeat, and
the bytes it covers go. The steps:

1. Each window has a minimizer: the least hash of its ``GRAM``-byte strings.
   Runs of windows with one minimizer are cut into fragments. Equal windows
   have equal minimizers, so a window can only repeat in fragments that share
   it. Equal fragments are reduced to their first place before the shuffle;
   all windows at their other places are repeats.
2. Where different fragments share a minimizer, their texts are gathered into
   collections. A collection is split into shards, each with its own suffix
   order, Burrows-Wheeler transform and LF mapping.
3. The transforms are merged by iterative interleave refinement: the order of
   all suffixes by their first h bytes gives that by h + 1 bytes by one stable
   distribution over the byte before. Boundaries that appear in round h mark
   common prefixes of h - 1 bytes; suffixes alone in their interval drop out.
   After ``length`` rounds the intervals left are the repeated windows.
4. The marked spans meet their documents again, in the same shuffle of the
   texts that step 2 takes its fragments from.

A minimizer met in very many documents is split by the whole window's hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches, cut, texts_as_bytes

LENGTH = 100
GRAM = 40
#: Fragments reduced together before the shuffle.
BUFFER = 250_000
#: Bytes of a collection and of a shard. A group of fragments with one minimizer is never split.
COLLECTION, SHARD = 512 << 10, 64 << 10
#: A minimizer with about this many places is split by window, as one in HOT_SAMPLE documents shows.
#: This bounds a group of fragments to about a megabyte, and its merge to about a hundred.
HOT_PLACES, HOT_SAMPLE = 8_000, 64
#: Marks a number of windows whose minimizer recurs.
RECURS = 1 << 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- minimizers ---------------------------------------------------------------


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def runs_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, first window, number of windows, whether it recurs) of each run of windows with one minimizer.

    It recurs if it stands at two places of the run; only then can two windows of a run be equal.
    """
    n = len(text)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    up, down = _POWERS(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    wide, m = length - gram + 1, n - gram + 1
    rows = np.full(-(-m // wide) * wide, _TOP)
    rows[:m] = h
    rows = rows.reshape(-1, wide)
    # the least of any stretch: a block's end and the next block's start
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - wide + 1], ahead[wide - 1 : m])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    key, count = least[first], np.diff(np.append(first, len(least)))
    each = count + wide - 1
    begins = np.cumsum(each) - each
    at = np.arange(each.sum()) + np.repeat(first - begins, each)
    recurs = np.add.reduceat(h[at] == np.repeat(key, each), begins, dtype=np.int64) > 1
    return key, first, count, recurs


def fragments_of(text: bytes, hot: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(key, digest, first window, windows) of a text's fragments; ``RECURS`` is added where a minimizer recurs.

    A fragment is the bytes that a run's windows cover. Runs of a hot minimizer
    become a fragment per window, keyed by the window's hash.
    """
    key, start, count, recurs = runs_of(text, length, gram)
    if len(hot) and len(key) and (split := np.isin(key, hot)).any():
        each = np.where(split, count, 1)
        base = np.repeat(start, each)
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        own = np.repeat(split, each)
        key, count = np.repeat(key, each), np.where(own, 1, np.repeat(count, each))
        recurs = np.repeat(recurs, each) & ~own
        start = base + np.where(own, step, 0)
        for i in np.flatnonzero(own):
            key[i] = xxhash.xxh64_intdigest(text[start[i] : start[i] + length], 1)
    digest = xxhash.xxh64_intdigest
    ends = start + count + length - 1
    digests = np.fromiter((digest(text[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(key))
    return key, digests, start, count + RECURS * recurs


# ---- merging ------------------------------------------------------------------


def _shard_order(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix order of a shard: ``at`` are the suffixes' places, ``left`` their lengths."""
    padded = np.concatenate([text, np.zeros(len(text) and int(left.max(initial=0)) + 8, np.uint8)])
    words = np.ndarray((max(0, len(padded) - 7),), ">u8", padded, strides=(1,))
    order, block, places = np.arange(len(at)), np.zeros(len(at), np.int64), np.arange(len(at))
    for lo in range(0, int(left.max(initial=0)), 8):
        own = order[places]
        beyond = np.clip(8 - (left[own] - lo), 0, 8).astype(np.uint64) * np.uint64(8)
        word = words[at[own] + lo].astype(np.uint64)
        word = np.where(beyond >= 64, np.uint64(0), word >> np.minimum(beyond, np.uint64(63)))
        by = np.lexsort((word, block[places]))
        order[places], word, was = own[by], word[by], block[places]
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (was[1:] != was[:-1])))
        block[places] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        places = places[~(new & np.append(new[1:], True))]
        if not len(places):
            break
    return order


def repeated_windows(fragments: list[bytes], windows: list[int], length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """Groups of equal windows, each an array of (fragment, window) rows.

    ``windows`` says how many windows of ``length`` bytes start in each fragment.
    """
    sizes = np.array([w + length - 1 for w in windows], np.int64)
    text = np.frombuffer(b"".join(f[:n] for f, n in zip(fragments, sizes.tolist(), strict=True)), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = np.arange(len(text), dtype=np.int32) - starts.astype(np.int32)[owner]
    left = np.minimum(sizes.astype(np.int32)[owner] - place, length)
    # shards of whole fragments, dealt in turn so that likes meet in the merge
    n_shards = max(1, min(len(sizes), -(-len(text) // shard)))
    member = (np.arange(len(sizes)) % n_shards).astype(np.int16 if n_shards < 1 << 15 else np.int32)[owner]
    suffixes, transforms, links = [], [], []
    rank, base = np.empty(len(text), np.int32), 0
    for s in range(n_shards):
        own = np.flatnonzero(member == s).astype(np.int32)
        order = own[_shard_order(text, own, left[own])]
        rank[order] = np.arange(base, base + len(order), dtype=np.int32)
        begins = place[order] == 0
        suffixes.append(order)
        transforms.append(np.where(begins, 0, text[order - 1]))
        # LF: where the suffix longer by one byte stands in its shard's order
        links.append(np.where(begins, np.int32(-1), rank[order - 1]))
        base += len(order)
    suffix, transform, lf = (np.concatenate(x) for x in (suffixes, transforms, links))
    # The interleave points into the shards' orders. It starts shard after shard.
    now = np.arange(len(suffix), dtype=np.int32)
    byte, block = text[suffix], np.zeros(len(suffix), np.int32)
    for depth in range(1, length + 1):
        if depth > 1:
            longer = lf[now] >= 0
            now, block = now[longer], block[longer]
            byte = transform[now]
        by = np.argsort(byte, kind="stable")
        now, byte, block = now[by], byte[by], block[by]
        if depth > 1:
            now = lf[now]
        if not len(now):
            return []
        # a boundary that is new here parts suffixes with depth - 1 bytes in common
        new = np.concatenate(([True], (byte[1:] != byte[:-1]) | (block[1:] != block[:-1])))
        alone = new & np.append(new[1:], True)
        now, block = now[~alone], (np.cumsum(new, dtype=np.int32) - 1)[~alone]
    if not len(now):
        return []
    found = suffix[now]
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    return np.split(np.column_stack([owner[found], place[found]]), cuts)


def later_windows(ids: list[int], firsts: list[int], fragments: list[bytes], windows: list[int], length: int = LENGTH):
    """(id, first window, windows) runs of windows that start earlier in another place."""
    groups = repeated_windows(fragments, windows, length)
    if not groups:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.concatenate(groups)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    doc, at = np.array(ids, np.int64)[rows[:, 0]], np.array(firsts, np.int64)[rows[:, 0]] + rows[:, 1]
    by = np.lexsort((at, doc, group))
    doc, at, group = doc[by], at[by], group[by]
    again = np.concatenate(([False], group[1:] == group[:-1]))
    return _joined(doc[again], at[again], np.ones(again.sum(), np.int64))


def _joined(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with touching ones of a document joined."""
    if not len(doc):
        return doc, start, count
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], (start + count)[by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first) - start[first]


# ---- steps over DataFrames ------------------------------------------------------


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc_id, id, text, row`` with unique ids in document order, and whether they are the given ones.

    ``row`` holds all columns but the text. Null or repeated ids are replaced:
    rows are numbered by (id, nulls last, text digest); rows that agree in both
    get one number.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != text_col.lower()]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*others).alias("row"),
    )
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    n, known, apart = ids.agg(F.count(F.lit(1)), F.count("i"), F.countDistinct("i")).first()
    if n == known == apart:
        return rows.select("doc_id", F.col("doc_id").alias("id"), "text", "row"), True
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    keys = rows.select("doc_id", "digest").distinct().orderBy(F.asc_nulls_last("doc_id"), "digest")
    numbers = cut(keys.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), F.monotonically_increasing_id().alias("id")))
    met = rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
    return met.select("doc_id", "id", "text", "row"), False


_PLACES = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_PLACES_SQL = "key long, digest long, id long, start long, n long"


def _batch(columns, schema: pa.Schema = _PLACES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], schema=schema
    )


def _reduced(parts: list[tuple]) -> pa.RecordBatch:
    """First places of the buffered fragments, and joined runs of the others.

    Runs have the digest 0, n below zero and a key that only spreads them.
    """
    key, digest, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((start, doc, digest, key))
    key, digest, doc, start, count = key[by], digest[by], doc[by], start[by], count[by]
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])))
    d, s, c = _joined(doc[again], start[again], count[again] % RECURS)
    spread = (d.astype(np.uint64) * _BASE) ^ s.astype(np.uint64)
    return _batch(
        np.concatenate([x, y])
        for x, y in (
            (key[~again], spread),
            (digest[~again], np.zeros(len(d), np.uint64)),
            (doc[~again], d),
            (start[~again], s),
            (count[~again], -c),
        )
    )


def _hot_minimizers(rows: DataFrame, places: int, length: int, gram: int) -> np.ndarray:
    """Minimizers that a sample of documents shows to have very many places."""

    def run(batches):
        for batch in batches:
            keys = [np.unique(runs_of(t, length, gram)[0]) for t in texts_as_bytes(batch.column(0))]
            keys = np.concatenate([np.empty(0, np.uint64), *keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") * HOT_SAMPLE >= places)
    # at most one in (places / HOT_SAMPLE) sampled fragments
    return np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(np.uint64)


def _places(rows: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """Step 1: fragments' first places in each buffer, and repeats found there."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, texts_as_bytes(batch.column(1)), strict=True):
                key, digest, start, count = fragments_of(text, hot, length, gram)
                if len(key):
                    parts.append((key, digest, np.full(len(key), doc, np.int64), start, count))
                    held += len(key)
                if held >= BUFFER:
                    yield _reduced(parts)
                    parts, held = [], 0
        if parts:
            yield _reduced(parts)

    return rows.select("id", "text").mapInArrow(run, _PLACES_SQL)


def _settled(places: DataFrame) -> DataFrame:
    """Repeats (n below zero) and first places of fragments that need a merge.

    Rows of a key stand together, equal digests in document order. A fragment
    without others of its key needs a merge only if its minimizer recurs.
    """

    def decide(columns: list[np.ndarray]):
        key, digest, doc, start, n = columns
        runs = n < 0
        yield _batch([x[runs] for x in columns])
        key, digest, doc, start, n = (x[~runs] for x in columns)
        if not len(key):
            return
        by = np.lexsort((start, doc, digest, key))
        key, digest, doc, start, n = key[by], digest[by], doc[by], start[by], n[by]
        other_key = np.concatenate(([True], key[1:] != key[:-1]))
        first = other_key | np.concatenate(([True], digest[1:] != digest[:-1]))
        yield _batch([key[~first], digest[~first], doc[~first], start[~first], -(n[~first] % RECURS)])
        group = np.cumsum(other_key) - 1
        kinds = np.bincount(group, first)
        merge = first & ((kinds[group] > 1) | (n >= RECURS))
        yield _batch([x[merge] for x in (key, digest, doc, start, n % RECURS)])

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 200_000:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                # the last key may go on in the next batch
                done = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if (columns[0] != columns[0][-1]).any() else 0
                if done:
                    yield from decide([c[:done] for c in columns])
                held, size = [[c[done:] for c in columns]], len(columns[0]) - done
        if held:
            yield from decide([np.concatenate(x) for x in zip(*held, strict=True)])

    return places.repartition("key").sortWithinPartitions("key").mapInArrow(run, _PLACES_SQL)


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_places: int = HOT_PLACES) -> DataFrame:
    """``id, start, n``: runs of windows that start earlier elsewhere, from ``id, text`` with unique ids.

    Other columns of ``rows`` have no part in it, but are shuffled with the
    texts: a caller that joins the result to these very rows by id then shares
    that shuffle (Spark reuses an exchange of equal columns).
    """
    hot = _hot_minimizers(rows, hot_places, length, gram)
    found = cut(_settled(_places(rows, hot, length, gram)))
    marked = found.where("n < 0").select("id", "start", (-F.col("n")).alias("n"))
    needed = found.where("n > 0").groupBy("id").agg(F.collect_list(F.struct("key", "start", "n")).alias("cuts"))

    def take(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            ids, texts, needs = (batch.column(c) for c in ("id", "text", "cuts"))
            for doc, text, cuts in zip(ids.to_pylist(), texts_as_bytes(texts), needs.to_pylist(), strict=True):
                for c in cuts:
                    for column, x in zip(out, (c["key"], doc, c["start"], c["n"], text[c["start"] : c["start"] + c["n"] + length - 1]), strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "id", "start", "n", "part"])

    def merge(batches):
        held, key, size = [], None, 0

        def done():
            doc, start, n = later_windows([h[1] for h in held], [h[2] for h in held], [h[4] for h in held], [h[3] for h in held], length)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(n)], names=["id", "start", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= COLLECTION and row[0] != key:
                    yield done()
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield done()

    parts = rows.join(needed, "id").mapInArrow(take, "key long, id long, start long, n long, part binary")
    parts = parts.repartition("key").sortWithinPartitions("key")
    merged = parts.mapInArrow(merge, "id long, start long, n long")
    return marked.unionByName(merged)


def spans_of(n_bytes: int, starts: list[int], counts: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from runs of repeated windows."""
    out: list[list[int]] = []
    for a, b in sorted((s, s + c + length - 1) for s, c in zip(starts, counts, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n_bytes)) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[e:a] for e, (a, _) in zip(ends, [*spans, (len(text), 0)], strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which they hold a part only."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_runs(
    docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, hot_places: int, columns: list[str]
) -> tuple[DataFrame, bool]:
    """``columns`` of ``_numbered`` with ``runs``, null without repeats, and whether ids are the given ones.

    Given ids are without nulls; saying so here lets both joins of the texts
    read one shuffle, as the one in ``repeats`` is inner and says so by itself.
    The caller has to use all of ``columns``, or one of the two would be narrower.
    """
    arrow_batches(docs.sparkSession)
    rows, given = _numbered(docs, id_col, text_col)
    rows = rows.select(*columns)
    if given:
        rows = rows.where(F.col("id").isNotNull())
    texts = rows if given else rows.select("id", "text").dropDuplicates(["id"])
    found = repeats(texts, length, gram, hot_places)
    lists = found.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(lists, "id", "left"), given


def _copies(df: DataFrame) -> DataFrame:
    """``later``: whether a row comes after another one with its number."""
    return df.withColumn("later", F.row_number().over(Window.partitionBy("id").orderBy("doc_id")) > 1)


def _spans_in(batch: pa.RecordBatch, text_at: int, runs_at: int, length: int):
    for text, runs in zip(texts_as_bytes(batch.column(text_at)), batch.column(runs_at).to_pylist(), strict=True):
        yield text, spans_of(len(text), [r["start"] for r in runs or []], [r["n"] for r in runs or []], length)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_places: int = HOT_PLACES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a row of smaller id, or earlier in the same row. Strings are
    judged on the input. Null text counts as empty; texts under ``length``
    bytes stay whole. Null ids come last; rows of equal id come in the order of
    their texts' SHA-256, and of equal rows all but one count as later. Other
    columns are ignored.
    """
    columns = ["doc_id", "id", "text"]
    rows, given = _with_runs(docs.select(id_col, text_col), id_col, text_col, length, gram, hot_places, columns)
    names = ["doc_id", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in batches:
            out = [
                (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest())
                for text, spans in _spans_in(batch, 2, 3, length)
            ]
            made = [pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    done = rows.select(*columns, "runs").mapInArrow(
        run, "doc_id long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    if not given:
        gone = F.col("later") & (F.col("n_bytes") >= length)
        done = _copies(done).select(
            "doc_id",
            "id",
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
    return done.drop("id")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_places: int = HOT_PLACES
) -> DataFrame:
    """``docs`` with repeated strings gone from its texts; all rows and other columns stay.

    The bytes that go are those of ``remove_repeats``, but for characters of
    which only a part would go; these stay whole. Null text becomes empty.
    """
    columns = ["doc_id", "id", "text", "row"]
    rows, given = _with_runs(docs, id_col, text_col, length, gram, hot_places, columns)
    row = docs.drop(text_col).schema.simpleString()

    def run(batches):
        for batch in batches:
            texts = [
                kept_bytes(text, whole_characters(text, spans)).decode() for text, spans in _spans_in(batch, 2, 3, length)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)],
                names=["doc_id", "id", "text", "row"],
            )

    done = rows.select("doc_id", "id", "text", "runs", "row").mapInArrow(run, f"doc_id long, id long, text string, row {row}")
    if not given:
        # what is left of equal rows is equal, and only the first one's is wanted
        long = F.octet_length("before") >= length
        before = rows.select("id", F.col("text").alias("before")).dropDuplicates(["id"])
        done = _copies(done).join(before, "id").withColumn("text", F.when(F.col("later") & long, "").otherwise(F.col("text")))
    return done.select(*(F.col("text").alias(c) if c.lower() == text_col.lower() else F.col("row")[c].alias(c) for c in docs.columns))
