"""DataFrame schemas as JSON Schema, and small document projections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import FIXED_METHODS, path_parameters


def _nullable(schema: dict | bool, nullable: bool):
    if not nullable or schema is True:
        return schema
    if isinstance(schema.get("type"), str):
        return {**schema, "type": [schema["type"], "null"]}
    return {"anyOf": [schema, {"type": "null"}]}


def project_type(kind: T.DataType) -> dict | bool:
    """The JSON Schema of a Spark type."""
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.LongType):
        return {"type": "integer", "format": "int64"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, T.DecimalType):
        return {"type": "integer", "minimum": 0, "format": "uint64"} if (kind.precision, kind.scale) == (20, 0) else {"type": "number"}
    if isinstance(kind, T.FractionalType):
        return {"type": "number"}
    if isinstance(kind, T.StringType):
        return {"type": "string"}
    if isinstance(kind, T.BinaryType):
        return {"type": "string", "contentEncoding": "base64"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    if isinstance(kind, T.NullType):
        return {"type": "null"}
    if isinstance(kind, T.VariantType):
        return True
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _nullable(project_type(kind.elementType), kind.containsNull)}
    if isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": _nullable(project_type(kind.valueType), kind.valueContainsNull)}
        if isinstance(kind.keyType, T.IntegralType):
            out["propertyNames"] = {"pattern": "^-?[0-9]+$"}
        elif not isinstance(kind.keyType, T.StringType):
            raise ValueError("codec.mapkey: keys must be strings or integers")
        return out
    if isinstance(kind, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: _nullable(project_type(f.dataType), f.nullable) for f in kind},
            "required": sorted(f.name for f in kind),
        }
    raise ValueError(f"schema.unsupported: {kind.simpleString()}")


def projected_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``ordinal, name, nullable, schema``: each column's JSON Schema, one row per column."""
    rows = [
        (i, f.name, f.nullable, json.dumps(_nullable(project_type(f.dataType), f.nullable), sort_keys=True))
        for i, f in enumerate(df.schema)
    ]
    return spark.createDataFrame(rows, "ordinal int, name string, nullable boolean, schema string")


def head_projection(responses: DataFrame) -> DataFrame:
    """Responses to HEAD: no content, everything else kept."""
    return responses.drop("content")


def derived_parameters(routes: DataFrame, path: str = "path") -> DataFrame:
    """Route columns and ``position, name`` of each path parameter."""
    return routes.select("*", F.posexplode(path_parameters(F.col(path))).alias("position", "name"))


def method_pivot(operations: DataFrame, path: str, method: str, value: Column) -> DataFrame:
    """One row per path: a column for each fixed method, and a map of the others."""
    fixed = operations.groupBy(path).pivot(method, FIXED_METHODS).agg(F.min(value))
    extra = operations.where(~F.col(method).isin(FIXED_METHODS)).groupBy(path, method).agg(F.min(value).alias("v"))
    maps = extra.groupBy(path).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(method, "v")))).alias("additional"))
    return fixed.join(maps, path, "left")


def expanded_parameters(objects: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, name, schema, required`` from ``properties map<string,string>`` and ``required array<string>``."""
    rows = objects.select(*keys, F.col("required").alias("needs"), F.explode("properties").alias("name", "schema"))
    return rows.select(*keys, "name", "schema", F.coalesce(F.array_contains("needs", F.col("name")), F.lit(False)).alias("required"))


def wire_fields(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The field of each name: least ``depth``, then tagged ones; a tie drops the name."""
    order = Window.partitionBy(*keys, "name").orderBy("depth", F.desc("tagged"))
    best = candidates.withColumn("place", F.rank().over(order)).where("place = 1")
    alone = best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "name")))
    return alone.where("n = 1").drop("place", "n")


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, digest``: SHA-256 of each row as JSON with sorted columns."""
    named = F.struct(*(F.col(c) for c in sorted(df.columns)))
    return df.select(*keys, F.sha2(F.to_json(named), 256).alias("digest"))
