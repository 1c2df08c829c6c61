"""Byte-level BPE with a segment tree.

The tree's leaves are byte positions. A leaf holds the rank of the pair that
starts there, if that pair is a token. Each inner node holds the least rank
below it and, of equals, the leftmost place. A merge takes the root's pair and
updates the leaves of the two live neighbours it touches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assay.llm.common import arrow_batches, texts_as_bytes

#: Distinct matches kept per worker before all are forgotten.
CACHE = 300_000
#: Bytes of the longest piece that is merged together with others.
WIDEST = 64
_NONE = 1 << 60
#: Characters whose classes are written out below: ASCII without rare controls, Latin-1 and Latin Extended A.
_PLAIN = re.compile("[\t\n\r -~¡-ſ]*")
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match by repeated merging of the leftmost pair of least rank."""
    n = len(piece)
    if n == 0:
        return []
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            # rank and place in one number: the least is the leftmost of the least rank
            tree[size + i] = (rank << 32) | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    # live parts: where each ends, and where the part before it starts
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        at = size + i
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            value = value if value < other else other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    def pair(i: int) -> int:
        mid = ends[i]
        rank = get(piece[i : ends[mid]]) if mid < n else None
        return _NONE if rank is None else (rank << 32) | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        mid = ends[i]
        ends[i] = ends[mid]
        if ends[i] < n:
            before[ends[i]] = i
        put(mid, _NONE)  # the right half is no longer a start
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Merger:
    """Merges many short pieces at once: the same trees, a row per piece.

    Every round takes each row's root, merges that pair, writes the three
    leaves it touches and renews their paths to the root.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        keys = [
            (ranks[token[:k]] * self.base + ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(sorted(keys) or [(-1, 0)], np.int64)
        self.keys, self.ranks = table[:, 0].copy(), table[:, 1].copy()

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of ids; an id of -1 is no part."""
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(found, (self.ranks[at] << 32) | place, _NONE)

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; all have at most ``WIDEST`` bytes."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.array([len(p) for p in pieces], np.int64)
        size = 1
        while len(pieces):
            rows = np.flatnonzero((lengths <= size) & (lengths > size // 2 if size > 1 else lengths > 0))
            for lo in range(0, len(rows), 8192):
                part = rows[lo : lo + 8192]
                for k, ids in zip(part.tolist(), self._merged([pieces[k] for k in part.tolist()], size), strict=True):
                    out[k] = ids
            if size >= lengths.max():
                return out
            size *= 2
        return out

    def _merged(self, pieces: list[bytes], size: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        alive = np.arange(size) < np.array([len(p) for p in pieces])[:, None]
        ids = np.full((n, size + 1), -1, np.int64)
        ids[:, :size] = np.where(alive, self.byte_ids[raw], -1)
        ends = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        places = np.arange(size)
        tree = np.full((n, 2 * size), _NONE, np.int64)
        tree[:, size:] = self._leaf(ids[:, :-1], ids[:, 1:], places)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.arange(n)
        while True:
            live = live[tree[live, 1] != _NONE]
            if not len(live) or size == 1:
                break
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            mid = ends[live, i]
            end = ends[live, mid]
            ids[live, i] = root >> 32
            ids[live, mid] = -1
            alive[live, mid] = False
            ends[live, i] = end
            inside = end <= size
            before[live[inside], end[inside]] = i[inside]
            prior = before[live, i]
            first = prior < 0
            prior = np.where(first, i, prior)
            following = ids[live, np.minimum(end, size)]
            value = self._leaf(ids[live, i], following, i)
            tree[live, size + mid] = _NONE
            tree[live, size + i] = value
            left = np.where(first, -1, ids[live, prior])
            tree[live, size + prior] = np.where(first, value, self._leaf(left, ids[live, i], prior))
            row = np.concatenate([live, live, live])
            at = size + np.concatenate([mid, i, prior])
            step = size
            while step > 1:
                at >>= 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
                step >>= 1
        flat = ids[:, :size][alive].tolist()
        cuts = np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Codec:
    """Encodes and decodes texts by a table of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.decimal = {i: b"%d" % i for i in self.tokens}
        self.merger = Merger(ranks)
        # white space by the Unicode property: Python's \s also takes U+001C to U+001F
        wide = pattern.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}")
        self.find_any = regex.compile(wide.replace("\\S", "\\P{White_Space}")).findall
        plain = pattern.replace("\\p{L}\\p{N}]", f"{_LETTER}{_NUMBER}]").replace("\\p{L}", f"[{_LETTER}]").replace("\\p{N}", f"[{_NUMBER}]")
        self.find_plain = None if "\\p" in plain else re.compile(plain).findall
        self.met: dict[str, tuple[int, bytes, bytes]] = {}

    def find(self, text: str) -> list[str]:
        """The matches of the pattern, which partition the text."""
        if self.find_plain and _PLAIN.fullmatch(text):
            return self.find_plain(text)
        return self.find_any(text)

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of each match of the pattern: its own id if it is a token, else by merging."""
        raw = [t.encode() for t in texts]
        out: list = [None] * len(raw)
        short = []
        for k, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) <= WIDEST:
                short.append(k)
            else:
                out[k] = merge(piece, self.ranks)
        for k, ids in zip(short, self.merger([raw[k] for k in short]), strict=True):
            out[k] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(self.find(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the matches not met so far, all at once."""
        if len(self.met) > CACHE:
            self.met.clear()
        new = list(set().union(*texts) - self.met.keys())
        decimal = self.decimal.__getitem__
        for text, ids in zip(new, self.pieces(new), strict=True):
            self.met[text] = len(ids), b",".join(map(decimal, ids)), self.decode(ids)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal, SHA-256 of what they decode to."""
        matches = list(map(self.find, texts))
        self.learn(matches)
        out = []
        for parts in matches:
            got = list(map(self.met.__getitem__, parts))
            ids, decoded = hashlib.sha256(), hashlib.sha256()
            for lo in range(0, len(got), 1 << 16):
                some = got[lo : lo + (1 << 16)]
                ids.update((b"," if lo else b"") + b",".join([g[1] for g in some]))
                decoded.update(b"".join([g[2] for g in some]))
            out.append((sum([g[0] for g in got]), ids.hexdigest(), decoded.hexdigest()))
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of base64 tokens and ranks, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    """The codec of a vocabulary file that is installed wherever tasks run."""
    import public_tokenizers

    return Codec(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    Null text counts as empty: no ids, and the digests of nothing. Texts are
    read whole, repeated rows stay, other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            got = own.digests([t.decode() for t in texts_as_bytes(batch.column(1))])
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64())]
            columns += [pa.array([g[k] for g in got], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.met.clear()  # the worker lives on, and others need its memory

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``; null text gives an empty list."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(t.decode()) for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids give empty bytes, an unknown id fails the task."""
    arrow_batches(tokens.sparkSession)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            raw = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
