"""Bounded-space best-fit packing of tokenised documents into fixed-length sequences.

A fixed number of bins is open at a time. A bitset has a bit for each free
space that some open bin has, so the best fit is the lowest set bit at or above
a piece's length. When a piece fits no open bin and all are open, the fullest
one closes. Tasks pack their own pieces; the bins still open at a task's end
are packed once more as pieces of a second round.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches, cut, texts_as_bytes

CAPACITY = 2048
#: Open bins of one packer.
OPEN_BINS = 1024
#: Rows of the second round that one task packs, about.
ROUND_TWO_ROWS = 50_000
#: The id that ends each document.
END_ID = 0
#: Distinct words kept per worker.
CACHE = 300_000


class Packer:
    """Online best fit over at most ``open_bins`` bins; bins are numbered from 0."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it for a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins that are open."""
        return [(b, self.capacity - free) for free, bins in enumerate(self.by_free) for b in bins]


# ---- token ids ----------------------------------------------------------------

#: Characters that normalising only lower-cases, one by one: ASCII without
#: controls, Latin-1 and Latin Extended A without the dotted capital I.
_PLAIN = re.compile("[\t-\r -~¡-įı-ſ]*")
_LETTER = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: The vocabulary's own splitting pattern, written out for those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")

#: The letters by which byte-level vocabularies write bytes: those that print stand for themselves,
#: the others follow from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers, remembering words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # texts that may hold a token which is found before words are split are the library's alone
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.met: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _add(self, word: str) -> bytes:
        # a word of the pattern is already normalised and split: only its bytes' letters are left to map
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        raw = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(word) <= 64:
            if len(self.met) >= CACHE:
                self.met.clear()
            self.met[word] = raw
        return raw

    def __call__(self, text: str) -> bytes:
        lower = text.lower()
        if not _PLAIN.fullmatch(text) or self.added and self.added.search(lower):
            return self._encode(text)
        get = self.met.get
        return b"".join([get(w) or self._add(w) for w in _SPLIT.findall(lower)])


@lru_cache(maxsize=2)
def word_tokenizer(name: str) -> WordTokenizer:
    """The tokenizer of a vocabulary file that is installed wherever tasks run."""
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path(name))


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: ids of each text and ``END_ID``, cut where longer than a sequence."""
    arrow_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        tokens = word_tokenizer(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                raw = tokens(text.decode()) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        tokens.met.clear()  # the worker lives on, and others need its memory

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- packing ------------------------------------------------------------------


def best_fit(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """All columns of ``items`` and ``sequence_id, offset``.

    ``items`` has lengths from 1 to ``capacity``; others fail the task. Rows
    are dealt by all their columns, so no document or length owns a task;
    within a task they come in the order of those columns. Equal rows are
    packed once each. No items give no rows. Columns of any name are kept apart
    from what packing adds; those named ``sequence_id`` or ``offset`` are replaced.
    """
    items = items.drop("sequence_id", "offset")
    names = [f"`{c}`" for c in items.columns]
    kind = items.schema.simpleString()
    made = ["item", "bin", "place", "fill"]

    def run(batches):
        from pyspark import TaskContext

        packer = Packer(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            got = []
            for n in batch.column(1).to_pylist():
                if n is None or not 0 < n <= capacity:
                    raise ValueError(f"a piece has {n} tokens; 1 to {capacity} can be packed")
                got.append(packer.place(n))
            bins = pa.array([base + g[0] for g in got], pa.int64())
            places = pa.array([g[1] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), bins, places, pa.nulls(len(got), pa.int64())], names=made)
        rest = packer.still_open()
        if rest:
            bins = pa.array([base + b for b, _ in rest], pa.int64())
            none, fills = pa.nulls(len(rest), batch.schema.types[0]), pa.array([f for _, f in rest], pa.int64())
            yield pa.RecordBatch.from_arrays([none, bins, pa.nulls(len(rest), pa.int64()), fills], names=made)

    dealt = items.repartition(*names).sortWithinPartitions(*names)
    dealt = dealt.select(F.struct(*names).alias("item"), F.col(f"`{length_col}`").cast("long").alias("length"))
    packed = cut(dealt.mapInArrow(run, f"item {kind}, bin long, place long, fill long"))
    rest = packed.where("fill is not null").select("bin", "fill")
    groups = max(1, -(-rest.count() // ROUND_TWO_ROWS))

    def again(table: pa.Table) -> pa.Table:
        packer, first = Packer(capacity, open_bins), {}
        bins, fills = table.column("bin").to_pylist(), table.column("fill").to_pylist()
        where = [(b, *packer.place(f)) for b, f in sorted(zip(bins, fills, strict=True))]
        # a second-round bin takes the number of the first bin that it holds
        new = [(b, first.setdefault(number, b), place) for b, number, place in where]
        return pa.table({k: pa.array([x[i] for x in new], pa.int64()) for i, k in enumerate(("bin", "to", "shift"))})

    moved = (
        rest.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        .groupBy("g")
        .applyInArrow(again, "bin long, to long, shift long")
    )
    return (
        packed.where("fill is null")
        .join(moved, "bin", "left")
        .select(
            "item.*",
            F.coalesce("to", "bin").alias("sequence_id"),
            (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Null text counts as empty, which is one piece of the end id alone. Only
    documents of over 2048 tokens are cut; their last piece may be shorter.
    Repeated rows are packed as often as they come, null ids stay null, other
    columns are ignored, and no documents give no rows.
    """
    return best_fit(pieces(docs, vocabulary, id_col, text_col))
