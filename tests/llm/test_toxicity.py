import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assay.llm import queries, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_every_document_is_judged(spark):
    got = queries.op10_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    assert all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic >= toxicity.THRESHOLD) for r in got)


def design(rows, n):
    return toxicity.Design(np.concatenate([np.flatnonzero(r) for r in rows]), np.array([int(r.sum()) for r in rows]), n)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3)) < 0.3
    y = np.column_stack([x[:, 0], (x[:, 0].astype(int) + x[:, 1]) > 1]).astype(float)
    chain = toxicity.fit_chain(design(x, 3), y, np.ones(400), np.arange(400) % 5, np.arange(3), ["one", "two"])
    n = len(chain.numbers)
    assert len(chain.weights[0]) == n + 1 and len(chain.weights[1]) == n + 2
    p = chain.predict(design(x[:, sorted(chain.numbers)], n))
    assert ((p[:, 0] > 0.5) == y[:, 0]).all() and ((p[:, 1] > 0.5) == y[:, 1]).mean() > 0.97


def test_the_solver_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 40)) < 0.2
    y = (x[:, :3].sum(axis=1) + rng.random(300) > 1).astype(float)
    w = toxicity.fit_linear(design(x, 40), np.zeros((300, 0)), y, np.ones(300), 2.0)
    grad = x.T.astype(float) @ (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
    assert (np.abs(grad[w[:-1] == 0]) <= 2.0 * 1.06).all()
    used = w[:-1] != 0
    assert used[:3].all() and np.allclose(grad[used], -2.0 * np.sign(w[:-1][used]), atol=0.15)


def test_matrix_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random((50, 9)) < 0.4
    x[7] = False
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    own = design(x, 9)
    assert len(own.chunks) > 5
    w, r = rng.random(9), rng.random(50)
    assert np.allclose(own.times(w), x @ w) and np.allclose(own.sums(r), r @ x)
    assert np.allclose(own.only(np.array([1, 4])).times(w[[1, 4]]), x[:, [1, 4]] @ w[[1, 4]])


def test_packed_buckets_come_back():
    rng = np.random.default_rng(4)
    top = toxicity.BUCKETS
    for found in ([], [0], [top - 1], [0, 65535, 65536, top - 1], range(65536), np.unique(rng.integers(0, top, 5000))):
        found = np.array(found, np.int32)
        back = toxicity._unpacked(pa.py_buffer(toxicity._packed(found)))
        assert back.dtype == np.int32 and np.array_equal(back, found)


def test_the_fit_holds_little_besides_its_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghinorstu"), 8)) for _ in range(3000)]
    texts = [(i, " ".join(rng.choice(words, 800))) for i in range(300)] + [(300, ""), (301, "one two"), (302, "one two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 3 // 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    entries = sum(len({b for w in set(t.split()) for b in toxicity.buckets_of(w)}) for _, t in texts)
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 14)
    monkeypatch.setattr(toxicity, "STEPS", 2)
    tracemalloc.start()
    try:
        toxicity.fit_labelled(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(f"{entries} entries, peak {peak / entries:.1f} bytes an entry")
    assert entries > 2_000_000 and peak < 12 * entries


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (99, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(ODD), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.p_toxic <= 1 for r in got)
    none = toxicity.classify(docs(ODD), labels.limit(0)).collect()
    assert not any(r.toxic for r in none)
    assert toxicity.classify(docs([]), labels).collect() == []


def test_recall_on_held_out_labels_in_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").dropna()
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.fit_labelled(docs, labels.where(~part))
    rows = toxicity.predict(docs.join(labels.where(part), "doc_id"), chain).select("lang", "toxic", "p_toxic").collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, ([], []))[r.toxic].append(r.p_toxic >= toxicity.THRESHOLD)
    print({lang: (sum(c), len(c), sum(t), len(t)) for lang, (c, t) in by.items()})
    assert set(by) == {"en", "fr", "de", "es"}
    clean = [x for c, _ in by.values() for x in c]
    assert np.mean(clean) <= 0.02 and all(np.mean(c) <= 0.1 for c, _ in by.values())
    toxic = [x for _, t in by.values() for x in t]
    assert np.mean(toxic) >= 0.9 and all(np.mean(t) >= 0.75 for _, t in by.values())


def test_rare_and_respelt_words(spark):
    rng = np.random.default_rng(3)
    stems = ["grablok", "vintrom", "zuspeth"]
    made = []
    for i in range(1200):
        words = ["".join(rng.choice(list("abcdefghinorstu"), rng.integers(3, 9))) for _ in range(30)]
        bad = i % 10 == 0
        if bad:
            words[rng.integers(30)] = stems[i // 10 % 3] + str(rng.choice(["", "s", "ed", "ing"]))
        made.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in made], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_labelled(docs, labels)
    new = [(k, f"some plain words and {w} beside them") for k, w in enumerate(["GRABLOK", "gr4blok", "grablooook", "v1ntrom!!", "vintromish", "zu$peth", "zuspethed", "(vintroms)"])]
    plain = [(100 + k, " ".join("".join(rng.choice(list("abcdefghinorstu"), 6)) for _ in range(20))) for k in range(50)]
    got = {r.doc_id: r.p_toxic for r in toxicity.predict(spark.createDataFrame(new + plain, "doc_id long, text string"), chain).collect()}
    assert all(got[i] >= toxicity.THRESHOLD for i, _ in new), got
    assert sum(got[i] >= toxicity.THRESHOLD for i, _ in plain) <= 1
