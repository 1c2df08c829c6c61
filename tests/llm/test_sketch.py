import hashlib

import numpy as np
import pytest

from assay.llm import sketch
from tests.llm.conftest import ODD


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(pairs):
    rows = sorted(((i, t or "") for i, t in pairs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        new = sketch.edited(t, rows[(k + 1) % len(rows)][1])
        out.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), likeness(t, new), likeness(t, rows[(k + 1) % len(rows)][1])))
    return sorted(out)


@pytest.mark.parametrize("pairs", [ODD, [(9, "one two three four five six seven")], [(i * 7 % 50, f"w{i} " * (i % 9) + "a b c d e f") for i in range(50)]])
def test_rows_match_brute_force(docs, pairs):
    got = sketch.fingerprint_documents(docs(pairs)).collect()
    want = expected(pairs)
    rows = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got)
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    # few shingles: sketches hold them all
    assert np.allclose([r[3:] for r in rows], [w[3:] for w in want])
    by_text: dict = {}
    texts = {str(i): t or "" for i, t in pairs}
    for r in got:
        if sum(1 for i, _ in pairs if str(i) == str(r.doc_id)) == 1:
            assert by_text.setdefault(texts[str(r.doc_id)], r.fingerprint) == r.fingerprint


def test_no_rows(docs):
    assert sketch.fingerprint_documents(docs([])).collect() == []


def test_estimates_are_near():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(100_000)]
    a, b = rng.choice(words, 6000), rng.choice(words, 6000)
    one, two = " ".join(a), " ".join([*a[:4000], *b[:2000]])
    s, t = sketch.sketch(one.encode()), sketch.sketch(two.encode())
    assert abs(sketch.resemblance(s, t) - likeness(one, two)) < 0.12
    assert abs(sketch.containment(s, t) - 4000 / 6000) < 0.12
    assert abs(sketch.distinct(s) / 5996 - 1) < 0.25
    assert (sketch.decode(sketch.encode(s)) == s).all() and len(sketch.decode("")) == 0


def test_parts_merge_to_the_whole(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(5000)], 400)) for _ in range(12)]
    parts = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)] + [(3, None)], "doc_id int, text string")
    got = {r.key: r.fingerprint for r in sketch.merged(sketch.sketches(parts)).collect()}
    for k in (0, 1):
        want = np.empty(0, np.uint64)
        for t in texts[k::2]:
            want = sketch.merge(want, sketch.sketch(t.encode()))
        assert got[k] == sketch.encode(want)
    assert got[3] == ""
