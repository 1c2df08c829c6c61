import corpus_pipeline
from assay.llm import langid, packing, queries, simhash, suffix
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    spoken = corpus_pipeline.language(spark, docs, SF)
    assert spoken.columns == columns
    assert {r.doc_id for r in spoken.collect()} == {i for i, r in before.items() if langid.words_of(r.text)}
    calm = corpus_pipeline.not_toxic(spark, spoken, SF)
    assert calm.columns == columns
    kept = corpus_pipeline.near_dedup(spark, calm, SF)
    pairs = [(r.doc_id, r.text) for r in calm.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(pairs)})
    left = corpus_pipeline.repeats_removed(spark, kept, SF)
    assert left.columns == columns and left.count() == kept.count()
    assert left.where("n_chars <> char_length(text)").isEmpty()
    packed = corpus_pipeline.packed(spark, left, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in left.collect()}


def test_the_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_queries_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)}
    assert packing.CAPACITY == 2048 and suffix.LENGTH == 100 and simhash.BUDGET == 4
