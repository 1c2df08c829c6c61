"""A corpus pipeline: language, toxicity, near-duplicates, repeated strings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import langid, packing, similar, simhash, suffix, toxicity
from assay.llm.common import stored
from assay.llm.queries import WORD_VOCABULARY


def _apart(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns in ``row``, so that no name clashes with what a stage adds."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _whole(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null texts and texts without letters go.

    The model is fitted on a bounded sample of the stage's own input. Repeated
    rows and rows with a null id stay as often as they come; no rows give none.
    """
    found = langid.predict(_apart(docs), langid.fit(docs))
    return _whole(found.where(F.col("lang_pred") != langid.UNKNOWN), docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't call toxic.

    The chain is fitted on a bounded sample of the stage's own input with
    labels. Empty texts are judged as texts without known words; repeated rows
    and rows with a null id stay as often as they come; no rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.predict(_apart(docs), toxicity.fit_labelled(docs, labels))
    return _whole(found.where(F.col("p_toxic") < toxicity.THRESHOLD), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with close fingerprints."""
    return simhash.keep_one(docs).select(*docs.columns)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Close fingerprints take most copies away; of what they leave, no two texts
    stay whose five-word shingles have a similarity of 0.8 or more. Null and
    empty texts are copies of each other. Where ids are null or repeated, rows
    are told apart by numbers of their own; no rows give none.
    """
    return similar.keep_dissimilar(stored(near_dedup(spark, docs, sf_dir))).select(*docs.columns)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that came earlier, and their new lengths.

    All rows stay; of equal rows all but one lose their text, if it has 100
    bytes. Null text becomes empty; no rows give none.
    """
    left = suffix.deduplicate(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("language_id", language),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", dissimilar),
    ("suffix_array_dedup", repeats_removed),
    ("best_fit_packing", packed),
]

#: Trained models, tokenizers and byte strings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
