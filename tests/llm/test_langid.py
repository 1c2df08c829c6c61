import zlib

from pyspark.sql import functions as F

from assay.llm import langid, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_on_the_table(spark):
    got = queries.op2_language_id(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_words_first_then_shorter_ngrams():
    model = langid.fit_counts([("en", "the", 9), ("en", "thing", 4), ("de", "der", 9), ("de", "dinge", 4)])
    assert model.langs == ("de", "en")
    assert model.score_word("the") == model.words["the"]
    english, german = model.score_word("thin"), model.score_word("din")
    assert english[1] > english[0] and german[0] > german[1]
    assert model.score_word("ωω")[0] == model.score_word("ωωω")[0]


def test_odd_rows(spark, docs):
    model = langid.fit_counts([("en", "a", 5), ("de", "b", 5)])
    got = langid.predict(docs([*ODD, (7, "123 ²½ !?"), (8, "A")]), model).collect()
    assert len(got) == len(ODD) + 2
    by = [(r.doc_id, r.lang_pred, r.score) for r in got]
    assert [x[1:] for x in by if x[0] in (2, 3, 4, 7)] == [("und", 0.0)] * 4
    assert [x[1] for x in by if x[0] == 8] == ["en"]
    assert got[0].row == "r"


def test_without_labels_all_is_unknown(docs):
    model = langid.fit(docs([(1, "abc")]).withColumn("lang", F.lit(None).cast("string")))
    assert model.langs == ()
    assert langid.predict(docs([(1, "abc")]), model).first().lang_pred == "und"
    assert langid.identify(docs([])).collect() == []
