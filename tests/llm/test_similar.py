from itertools import combinations

import numpy as np

import corpus_pipeline
from assay.llm import similar, simhash
from tests.llm.conftest import ODD


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def near_copies(groups=8, copies=5):
    rng = np.random.default_rng(5)
    out = []
    for _ in range(groups):
        base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
        for c in range(copies):
            words = list(base)
            for _ in range(c % 3):
                words[rng.integers(120)] = f"new{rng.integers(10**6)}"
            out.append((len(out), " ".join(words)))
    return out


def test_no_two_kept_texts_are_similar(spark, docs):
    pairs = near_copies()
    text = dict(pairs)
    far = [(a, b) for a, b in combinations(text, 2) if similarity(text[a], text[b]) >= 0.8]
    bits = [simhash.fingerprint(text[a].encode()) ^ simhash.fingerprint(text[b].encode()) for a, b in far]
    assert sum(b.bit_count() > simhash.BUDGET for b in bits) > 10
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(pairs), "").collect()]
    assert not [(a, b) for a, b in combinations(kept, 2) if similarity(text[a], text[b]) >= 0.8]
    assert len(kept) >= 8


def test_large_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", 2)
    pairs = near_copies(3, 40)
    text = dict(pairs)
    kept = [r.doc_id for r in similar.keep_dissimilar(docs(pairs)).collect()]
    assert kept and not [(a, b) for a, b in combinations(kept, 2) if similarity(text[a], text[b]) >= 0.8]


def test_rare_shingles_lose_no_similar_pair(spark, docs):
    rng = np.random.default_rng(9)
    pairs = near_copies(6, 6)
    shared = [f"p{i}" for i in range(100)]
    for own in (2, 10, 20, 30, 60):  # one frequent passage with more and more words of their own
        for _ in range(8):
            pairs.append((len(pairs), " ".join(shared + [f"q{i}" for i in rng.integers(0, 10**9, own)])))
    text = dict(pairs)
    far = {(a, b) for a, b in combinations(text, 2) if similarity(text[a], text[b]) >= similar.LEAST}
    rows = similar._sets(docs(pairs).selectExpr("doc_id AS id", "text"))
    met = {tuple(sorted((r.a, r.b))) for r in similar._rare_pairs(rows).collect()}
    assert far <= met and len(met) < 1.5 * len(far)
    assert similar._rare_pairs(rows.where("id < 0")).collect() == []


def test_large_buckets_of_dissimilar_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", 2)
    shared = " ".join(f"p{i}" for i in range(100))
    pairs = [(k, shared + "".join(f" own{k}x{i}" for i in range(40))) for k in range(30)]
    assert len(similar.keep_dissimilar(docs(pairs)).collect()) == len(pairs)


def test_odd_rows(docs):
    got = [str(r.doc_id) for r in similar.keep_dissimilar(docs(ODD)).collect()]
    assert {"2", "3", "4"} <= set(got) and len(got) == len(ODD) - 2
    assert similar.keep_dissimilar(docs([])).collect() == []
