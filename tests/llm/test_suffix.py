import hashlib
import random

import numpy as np
import pytest

from assay.llm import suffix
from tests.llm.conftest import ODD


def brute(pairs, length):
    """Rows by (id, nulls last, digest): removed bytes of each."""
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0, hashlib.sha256((pairs[k][1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for k in order:
        raw = (pairs[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[k] = (str(pairs[k][0]), len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize(("hot", "seed"), [(suffix.HOT_PLACES, 0), (1, 1)])
def test_matches_brute_force(docs, monkeypatch, hot, seed):
    monkeypatch.setattr(suffix, "HOT_SAMPLE", 1)
    random.seed(seed)
    base = ["".join(random.choice("abé 🎉\n") for _ in range(80)) for _ in range(5)] + ["ab" * 60, "z" * 90]
    pairs = []
    for i in range(40):
        text = ""
        for _ in range(random.randint(0, 4)):
            x = random.choice(base)
            a = random.randint(0, len(x))
            text += x[a : a + random.randint(0, 70)] + random.choice("abq")
        pairs.append((i * 3 % 41, text))
    got = suffix.remove_repeats(docs(pairs), length=12, gram=5, hot_places=hot)
    assert found(got) == brute(pairs, 12)


def test_odd_rows(docs):
    pairs = [*ODD, (0, "a" * 99), (10, "a" * 99), (11, "b" * 101)]
    assert found(suffix.remove_repeats(docs(pairs))) == brute(pairs, 100)
    assert suffix.remove_repeats(docs([])).collect() == []
    left = suffix.deduplicate(docs(pairs))
    assert left.count() == len(pairs) and left.columns == docs([]).columns
    assert suffix.deduplicate(docs([])).collect() == []


@pytest.mark.parametrize("operator", [suffix.remove_repeats, suffix.deduplicate])
def test_texts_are_shuffled_once(spark, docs, tmp_path, operator):
    random.seed(3)
    base = "".join(random.choice("abcdefgh ") for _ in range(400))
    pairs = [(i, base[i : i + 200] + str(i) + base[: 90 + i]) for i in range(30)]
    docs(pairs).write.parquet(str(tmp_path / "documents"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = operator(spark.read.parquet(str(tmp_path / "documents")))
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute(pairs, 100)
    if operator is suffix.remove_repeats:
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    else:
        kept = sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)
        assert kept == sorted((w[0], w[4]) for w in want)
    # both joins of the texts, the one before the merge and the last one, read one exchange
    assert plan.count("FileScan parquet") == 1
    assert sum("ReusedExchange" in line and "text#" in line for line in plan.splitlines()) == 1


def test_texts_keep_whole_characters(docs):
    text = "é" * 100
    got = {r.doc_id: r.text for r in suffix.deduplicate(docs([(1, text), (2, text + "y"), (3, "ab" + text)])).collect()}
    # within the first text all but the first character's bytes repeat
    assert got == {1: "é", 2: "y", 3: "ab"}
    assert suffix.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]
    assert suffix.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


def test_shards_merge_to_the_same_windows():
    random.seed(7)
    parts = ["".join(random.choice("ab") for _ in range(random.randint(12, 60))).encode() for _ in range(60)]
    windows = [len(p) - 11 for p in parts]
    want: dict = {}
    for f, p in enumerate(parts):
        for w in range(windows[f]):
            want.setdefault(p[w : w + 12], []).append((f, w))
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    for shard in (50, 300, 1 << 20):
        groups = suffix.repeated_windows(parts, windows, 12, shard)
        assert sorted(sorted(map(tuple, g.tolist())) for g in groups) == want
