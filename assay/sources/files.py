"""Bounded file scans, manifests that share one budget, and guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one check's documents together, and documents of one check.
MAX_BYTES, MAX_RESOURCES = 8 << 20, 64


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str = "*") -> DataFrame:
    """``path, length, content, code``: files up to a size; longer ones have no content and ``input.budget``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    fits = F.col("length") <= max_bytes
    return files.select(
        "path", "length", F.when(fits, F.col("content")).alias("content"), F.when(~fits, "input.budget").alias("code")
    )


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """``uri, file, kind, code`` from a JSON array; ``cli.resources`` marks entries without uri or file, or with an unknown kind."""
    rows = spark.read.schema("uri string, file string, kind string").option("multiLine", True).json(manifest)
    kind = F.coalesce("kind", F.lit("document"))
    bad = F.col("uri").isNull() | F.col("file").isNull() | ~kind.isin("document", "example")
    return rows.select("uri", "file", kind.alias("kind"), F.when(bad, "cli.resources").alias("code"))


def resources(manifest: DataFrame, files: DataFrame, max_bytes: int = MAX_BYTES, max_count: int = MAX_RESOURCES) -> DataFrame:
    """Manifest entries with contents; entries past the shared byte or count budget have a code and no content.

    The entries of a manifest are summed in one window by name and length alone;
    contents meet the entries afterwards and never stand in one task.
    """
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    met = manifest.join(named.select("file", "path", "length"), "file", "left")
    order = Window.partitionBy(F.lit(0)).orderBy("uri").rowsBetween(Window.unboundedPreceding, 0)
    used, ordinal = F.sum(F.coalesce("length", F.lit(0))).over(order), F.count(F.lit(1)).over(order)
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("path").isNull(), "input.file")
        .when((used > max_bytes) | (ordinal > max_count), "cli.budget")
    )
    judged = met.select("uri", "file", "kind", "path", used.alias("used"), code.alias("code"))
    out = judged.join(named.select("path", "content"), "path", "left")
    return out.select("uri", "file", "kind", F.when(F.col("code").isNull(), F.col("content")).alias("content"), "used", "code")


def bundles(df: DataFrame, json_col: str, keep: list[str], fields: list[str], max_bytes: int = 16 << 20) -> DataFrame:
    """``keep, code``: problems of bundle texts; unknown fields, trailing text and size are errors."""
    keys = F.json_object_keys(json_col)
    code = (
        F.when(F.octet_length(json_col) > max_bytes, "bundle.budget")
        .when(F.try_parse_json(json_col).isNull(), "bundle.invalid")
        .when(~F.rtrim(F.col(json_col), F.lit(" \t\r\n")).endswith("}"), "bundle.trailing")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0, "bundle.invalid")
    )
    return df.select(*keep, code.alias("code"))


def write_text(df: DataFrame, path: str, owned: bool = False) -> None:
    """Write one text column; the commit protocol makes the folder whole or absent. Unless owned, existing output is an error."""
    df.write.mode("overwrite" if owned else "errorifexists").text(path)
