import numpy as np
import pytest
import xxhash

from assay.llm import simhash
from assay.llm.common import LOCAL_EDGES, components, union
from tests.llm.conftest import ODD


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, budget=4):
    fps = [brute_fingerprint(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(pairs):
        ids = [p for k, (p, _) in enumerate(pairs) if find(k) == find(i) and p is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return out


def test_odd_rows_match_brute_force(docs):
    got = simhash.near_duplicates(docs(ODD)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(ODD), key=str)


def test_near_copies_match_brute_force(docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    pairs = []
    for i in range(90):
        text = base[i % 6].split()
        for _ in range(i % 4):
            text[rng.integers(len(text))] = "new"
        pairs.append((int(rng.integers(10_000)), " ".join(text)))
    got = simhash.near_duplicates(docs(pairs)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(pairs))


def test_no_rows(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_one(docs([(1, "a b c d e"), (2, "a b c d e"), (3, "q r s t u v")])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and kept[0].__fields__ == docs([]).columns
    odd = simhash.keep_one(docs(ODD)).collect()
    fps = [brute_fingerprint(r.text) for r in odd]
    assert len(fps) == len(set(fps)) == len({brute_fingerprint(t) for _, t in ODD})


@pytest.mark.parametrize("order", [0, 1])
def test_cells_cover_all_pairs(order):
    rng = np.random.default_rng(order)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = base[rng.integers(0, 20, 800)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    fps = np.unique(fps)
    keys = simhash.ordered(fps, order)
    counts = np.bincount((keys >> np.uint64(52)).astype(int), minlength=4096)
    got = np.arange(len(fps))
    at = {int(v): i for i, v in enumerate(fps)}
    for u, v in simhash.plan_cells(counts, simhash.LEADING[order], limit=60):
        own = np.zeros(len(fps), bool)
        for depth, prefix in (u, v):
            own |= (keys >> np.uint64(64 - depth)) == np.uint64(prefix)
        root = simhash.links_of(fps[own], order, simhash._split_of(u, v))
        union(got, np.flatnonzero(own), np.array([at[int(r)] for r in root]))
    bits = keys[:, None] ^ keys[None]
    near = (np.bitwise_count(bits) <= 4) & (np.bitwise_count(bits >> np.uint64(32)) <= simhash.LEADING[order])
    want = np.arange(len(fps))
    union(want, *np.nonzero(near))
    assert (got == want).all()


@pytest.mark.parametrize("local_edges", [0, 20, LOCAL_EDGES])
def test_components_of_chains_stars_and_loops(spark, local_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301), (None, 1)]
    found = components(spark.createDataFrame(edges, "a long, b long"), local_edges)
    got = {r.node: r.root for r in found.collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 300: 300, 301: 300}


@pytest.mark.parametrize("local_edges", [0, LOCAL_EDGES])
def test_no_edges_give_no_components(spark, local_edges):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), local_edges).count() == 0
