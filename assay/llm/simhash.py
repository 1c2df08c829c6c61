"""SimHash near-duplicate detection by a binary trie self-join.

Fingerprints are 64-bit. Two of them link when at most ``BUDGET`` bits differ.
The bits are read in two orders: even bits first and odd bits first. A pair
within four bits differs in at most two even bits or in at most one odd bit, so
the first trie may prune at two differences in its leading half and the second
at one; together they find every pair. The upper trie levels are walked on the
driver over a histogram of at most ``2 ** TOP_BITS`` counts per order; the
surviving node pairs become cells that executors join independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import arrow_batches, components, identified, small, stored, texts_as_bytes, union

BUDGET = 4
#: Differences allowed in the leading half of either bit order.
LEADING = (2, 1)
WIDTH = 4
SEED = 42
TOP_BITS = 12
#: Nodes are split to this depth at least, so that cells are many at any size,
#: and further while they hold more fingerprints than this.
LEAST_BITS, NODE_LIMIT = 4, 65_536
#: Hashes held at once while the bits of one long text are counted.
CHUNK = 1 << 16
#: Node pairs expanded at once.
FRONTIER = 1 << 20


# ---- fingerprints ---------------------------------------------------------


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` words, repeats included, in chunks.

    Fewer words count as one shingle; no words give nothing.
    """
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        text = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pairs = zip(starts[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        yield np.fromiter((digest(text[a:b], SEED) for a, b in pairs), np.uint64, len(part) - width + 1)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    # sums of 255 rows fit one byte, which keeps the reduction narrow
    parts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return parts.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text; no words give zero."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text.lower().split(), width):
        counts += _bit_counts(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, one row per input row."""
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts_as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


# ---- the trie over one cell -------------------------------------------------


def _compact(x: np.ndarray) -> np.ndarray:
    """Gather the even bits of each 64-bit value into its low half."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x


def ordered(fps: np.ndarray, order: int) -> np.ndarray:
    """The bits with even ones first (order 0) or odd ones first (order 1)."""
    even, odd = _compact(fps), _compact(fps >> np.uint64(1))
    lead, trail = (even, odd) if order == 0 else (odd, even)
    return (lead << np.uint64(32)) | trail


class _Trie:
    """Levels of a binary trie over sorted distinct keys, built when first needed."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        gap = keys[1:] ^ keys[:-1]
        # the first differing bit between neighbours, counted from the top
        high = (gap >> np.uint64(32)).astype(np.float64)
        low = (gap & np.uint64(0xFFFFFFFF)).astype(np.float64)
        lead = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        self.lcp = np.concatenate(([-1], lead)).astype(np.int16)
        self.levels: dict[int, tuple] = {}

    def starts(self, depth: int) -> np.ndarray:
        return np.flatnonzero(self.lcp < depth)

    def level(self, depth: int) -> tuple:
        """(first leaf of each node, size, zero child or -1, one child or -1)."""
        if depth not in self.levels:
            starts = self.starts(depth)
            sizes = np.diff(np.append(starts, len(self.keys)))
            if depth == 64:
                self.levels[depth] = (starts, sizes, None, None)
            else:
                ids = np.cumsum(self.lcp < depth + 1) - 1
                first = ids[starts]
                two = np.diff(np.append(first, ids[-1] + 1)) == 2
                one_first = (self.keys[starts] >> np.uint64(63 - depth)) & np.uint64(1) == 1
                zero = np.where(one_first, -1, first).astype(np.int32)
                one = np.where(one_first, first, np.where(two, first + 1, -1)).astype(np.int32)
                self.levels[depth] = (starts, sizes, zero, one)
        return self.levels[depth]


def _walk(trie: _Trie, parent: np.ndarray, lead: int, total: int, split: tuple[int, int] | None) -> None:
    """Traverse node pairs together and link the leaves within the budget.

    ``split`` (depth, prefix): at that depth only pairs with exactly one node
    under the prefix go on.
    """
    keys = trie.keys
    uniform: dict[int, tuple] = {}
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while stack:
        depth, u, v, diff = stack.pop()
        if len(u) > FRONTIER:
            half = len(u) // 2
            stack += [(depth, u[half:], v[half:], diff[half:]), (depth, u[:half], v[:half], diff[:half])]
            continue
        starts, sizes, zero, one = trie.level(depth)
        if split and depth == split[0]:
            under = (keys[starts] >> np.uint64(64 - depth)) == np.uint64(split[1]) if depth else np.ones(len(starts), bool)
            keep = under[u] != under[v]
            u, v, diff = u[keep], v[keep], diff[keep]
        past = not split or depth >= split[0]
        if past:
            if depth not in uniform:
                uniform[depth] = np.minimum.reduceat(parent, starts), np.maximum.reduceat(parent, starts)
            low, high = uniform[depth]
            # nodes whose leaves are linked already have nothing to add
            keep = (low[u] != high[u]) | (low[v] != high[v]) | (low[u] != low[v])
            u, v, diff = u[keep], v[keep], diff[keep]
            single = (sizes[u] == 1) & (sizes[v] == 1)
            if single.any():
                a, b = starts[u[single]], starts[v[single]]
                bits = keys[a] ^ keys[b]
                near = (np.bitwise_count(bits) <= total) & (np.bitwise_count(bits >> np.uint64(32)) <= lead) & (a != b)
                if near.any():
                    union(parent, a[near], b[near])
                    uniform.clear()
                u, v, diff = u[~single], v[~single], diff[~single]
        if not len(u) or depth == 64:
            continue
        most = min(lead, total) if depth < 32 else total
        same = u == v
        spare = diff < most
        apart = ~same & spare
        parts = [
            (zero[u], zero[v], diff),
            (one[u], one[v], diff),
            (zero[u[spare]], one[v[spare]], diff[spare] + np.int8(1)),
            (one[u[apart]], zero[v[apart]], diff[apart] + np.int8(1)),
        ]
        u, v, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (u >= 0) & (v >= 0)
        if keep.any():
            stack.append((depth + 1, u[keep], v[keep], diff[keep]))


def links_of(fps: np.ndarray, order: int, split: tuple[int, int] | None = None, budget: int = BUDGET) -> np.ndarray:
    """A representative for each of the distinct unsigned ``fps`` of one cell.

    Two fingerprints get the same representative if a chain of links found in
    this cell joins them. A first walk with a budget of one joins dense groups,
    which the full walk then need not take apart pair by pair.
    """
    key = ordered(fps, order)
    by = np.argsort(key)
    trie, parent = _Trie(key[by]), np.arange(len(fps))
    lead = min(LEADING[order], budget)
    for total in dict.fromkeys((min(1, budget), budget)):
        _walk(trie, parent, min(lead, total), total, split)
    out = np.empty(len(fps), np.uint64)
    out[by] = fps[by][parent]
    return out


# ---- cells ------------------------------------------------------------------


def plan_cells(counts: np.ndarray, lead: int, limit: int = NODE_LIMIT, bits: int = TOP_BITS) -> list[tuple]:
    """Node pairs of the upper trie that the leading budget leaves, from a histogram.

    Returns ``((depth, prefix), (depth, prefix))`` of prefix-free nodes. A node
    is split to depth ``LEAST_BITS``, and while it holds more than ``limit``
    fingerprints.
    """
    sums = [counts]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    sums.reverse()

    def leaf(d: int, p: int) -> bool:
        return d == bits or d >= LEAST_BITS and sums[d][p] <= limit

    out, stack = [], [((0, 0), (0, 0), 0)]
    while stack:
        (du, pu), (dv, pv), diff = stack.pop()
        if not sums[du][pu] or not sums[dv][pv]:
            continue
        if (du, pu) == (dv, pv):
            if leaf(du, pu):
                out.append(((du, pu), (du, pu)))
                continue
            zero, one = (du + 1, 2 * pu), (du + 1, 2 * pu + 1)
            stack += [(zero, zero, diff), (one, one, diff)]
            if diff < lead:
                stack.append((zero, one, diff + 1))
            continue
        lu, lv = leaf(du, pu), leaf(dv, pv)
        if lu and lv:
            out.append(((du, pu), (dv, pv)))
            continue
        us = [(du, pu)] if lu else [(du + 1, 2 * pu), (du + 1, 2 * pu + 1)]
        vs = [(dv, pv)] if lv else [(dv + 1, 2 * pv), (dv + 1, 2 * pv + 1)]
        for x in us:
            for y in vs:
                more = diff + (not lu and not lv and x[1] % 2 != y[1] % 2)
                if more <= lead:
                    stack.append((x, y, more))
    return out


def _split_of(u: tuple, v: tuple) -> tuple[int, int] | None:
    if u == v:
        return None
    depth = min(u[0], v[0])
    return depth, u[1] >> (u[0] - depth)


def fingerprint_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps(fp)`` that span its link graph."""
    top = 1 << TOP_BITS

    def histogram(batches):
        counts = np.zeros(2 * top, np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for order in (0, 1):
                at = (ordered(x, order) >> np.uint64(64 - TOP_BITS)).astype(np.int64)
                counts += np.bincount(at + order * top, minlength=2 * top)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["node", "n"])

    counts = np.zeros(2 * top, np.int64)
    for node, n in fps.mapInArrow(histogram, "node long, n long").groupBy("node").agg(F.sum("n")).collect():
        counts[node] = n
    cells, routes = [], [[[] for _ in range(top)] for _ in (0, 1)]
    for order in (0, 1):
        for u, v in plan_cells(counts[order * top : (order + 1) * top], min(LEADING[order], budget)):
            for d, p in {u, v}:
                width = TOP_BITS - d
                for x in range(p << width, (p + 1) << width):
                    routes[order][x].append(len(cells))
            cells.append((order, _split_of(u, v)))
    flat = [np.fromiter((c for r in by for c in r), np.int32) for by in routes]
    ends = [np.cumsum([0, *map(len, by)]) for by in routes]

    def spread(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for order in (0, 1):
                at = (ordered(x.view(np.uint64), order) >> np.uint64(64 - TOP_BITS)).astype(np.int64)
                first, n = ends[order][at], ends[order][at + 1] - ends[order][at]
                skip = np.repeat(np.cumsum(n) - n, n)
                cell = flat[order][np.repeat(first, n) + np.arange(n.sum()) - skip] if n.sum() else np.empty(0, np.int32)
                for lo in range(0, len(cell), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[part]), pa.array(np.repeat(x, n)[part])], names=["cell", "fp"]
                    )

    def join(table: pa.Table) -> pa.Table:
        order, split = cells[table.column("cell")[0].as_py()]
        x = table.column("fp").to_numpy().view(np.uint64)
        root = links_of(x, order, split, budget)
        linked = root != x
        return pa.table({"a": x[linked].view(np.int64), "b": root[linked].view(np.int64)})

    return fps.mapInArrow(spread, "cell int, fp long").groupBy("cell").applyInArrow(join, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable through fingerprints that
    differ in at most ``budget`` bits. Null text counts as empty and an empty
    text has fingerprint zero, which links like any other. A null id stays null
    and never names a component unless all ids of the component are null.
    Repeated rows stay repeated. Other columns are ignored. Equal fingerprints
    are reduced to one node before any join. ``budget`` is at most 4.
    """
    if not 0 <= budget <= BUDGET:
        raise ValueError(f"budget must be between 0 and {BUDGET}")
    rows = stored(fingerprints(docs, id_col, text_col, width))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = components(fingerprint_links(nodes.select("fp"), budget))
    named = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = stored(named)
    # written before the join, so that Spark may split a root with many nodes
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = named.join(names, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays.

    It is the one with the smallest id. Where ids are null or repeated, rows
    are told apart by numbers of their own and any one row stays.
    """
    rows = identified(docs, id_col, text_col)
    found = near_duplicates(rows, "id", "text", width, budget)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))
    return rows.join(small(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")
