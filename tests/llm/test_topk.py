import math

import numpy as np

from assay.llm import topk


def brute(rows, k=10):
    good = {}
    cand = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * x) for x in v]
        cand.append((i, q))
        if i % 100 == 0:
            good.setdefault(i, q)
    out = []
    for i, q in good.items():
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in cand if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")


def floats(rng, n):
    return [float(x) for x in rng.normal(size=n).astype(np.float32)]


def test_matches_brute_force_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, floats(rng, 24)) for i in range(450)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, rows[3][1]), (1002, rows[3][1]), (1100, None), (1200, [1.0, None]), (1300, [float("nan")] * 24)]
    rows += [(1400, [float("inf")] * 24), (None, rows[0][1]), (1500, []), (1600, floats(rng, 7)), (1601, floats(rng, 40))]
    assert sorted(map(tuple, topk.top_k(table(spark, rows)).collect())) == brute(rows)


def test_blocks_in_a_shuffle_match_brute_force(spark, monkeypatch):
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 3), ("BLOCK", 40), ("SALTS", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i * 20, floats(rng, 33)) for i in range(200)]
    assert sorted(map(tuple, topk.top_k(table(spark, rows)).collect())) == brute(rows)


def test_few_rows(spark):
    assert topk.top_k(table(spark, [])).collect() == []
    assert topk.top_k(table(spark, [(100, [1.0])])).collect() == []
    got = topk.top_k(table(spark, [(100, [1.0]), (7, [-2.0])])).collect()
    assert list(map(tuple, got)) == [(100, 1, 7, -2048 * 1024)]


def test_large_products_are_exact(spark):
    big = 2.0e6  # products beyond 2 ** 53
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(table(spark, rows)).orderBy("rank").collect()]
    assert got == [(i, s) for _, _, i, s in sorted(brute(rows))]


def test_scores_beyond_a_long_are_held_to_its_range(spark):
    got = topk.top_k(table(spark, [(0, [3.0e8]), (1, [3.0e8]), (2, [-3.0e8])])).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]


def test_bounds_leave_out_nothing():
    rng = np.random.default_rng(2)
    q, x = np.floor(rng.normal(size=(5, 64)) * 50), np.floor(rng.normal(size=(64, 500)) * 50)
    whole = q @ x
    least = np.sort(whole, axis=1)[:, -10]
    scores, columns = topk.block_scores(q, x, least)
    assert len(columns) < 500
    for i in range(5):
        assert set(np.flatnonzero(whole[i] >= least[i])) <= set(columns)
    assert (scores == whole[:, columns]).all()
