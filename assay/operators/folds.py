"""Folds of alternatives, agreements and bounds over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alternatives(df: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """``keys, alternatives, folded``: distinct values of a group, one alone or in ``anyOf``.

    Values keep the order in which they are first seen by ``order``; without it
    they are sorted. Nulls are ignored. Values are grouped before they are
    gathered, so a list is as long as a group's distinct values.
    """
    first = F.min(order) if order else F.min(value)
    kinds = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(first.alias("first_seen"))
    pairs = F.array_sort(F.collect_list(F.struct("first_seen", F.col(value).alias("v"))))
    out = kinds.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("alternatives"))
    folded = F.when(F.size("alternatives") == 1, F.element_at("alternatives", 1)).otherwise(
        F.concat(F.lit("anyOf("), F.array_join("alternatives", ","), F.lit(")"))
    )
    return out.withColumn("folded", folded)


def conjunction(schemas: Column) -> Column:
    """An ordered array without repeats; one alone, several in ``allOf``, none null."""
    kinds = F.array_distinct(schemas)
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(
        F.size(kinds) > 1, F.concat(F.lit('{"allOf":['), F.array_join(kinds, ","), F.lit("]}"))
    )


def binary_union(schemas: Column) -> Column:
    """Ordered fold of variants: null on either side is unconstrained; equal sides collapse; nothing is flattened."""
    free = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        x = F.coalesce(x, free)
        return (
            F.when((acc == free) | (x == free), free)
            .when(acc == x, acc)
            .otherwise(F.concat(F.lit('{"anyOf":['), acc, F.lit(","), x, F.lit("]}")))
        )

    rest = F.slice(schemas, 2, F.greatest(F.size(schemas) - 1, F.lit(0)))
    start = F.coalesce(F.element_at(schemas, 1), free)
    return F.when(F.size(schemas) > 0, F.nullif(F.aggregate(rest, start, step), free))


def required_by_all(df: DataFrame, keys: list[str], condition: Column, name: str = "required") -> DataFrame:
    """Whether every row of a group meets a condition; unknown counts as not met."""
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias(name))


def body_required(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, body_required`` inferred from ``status`` and ``reads_body`` of each path.

    The body is required if all accepted paths (status below 400) read it;
    not if a status is unknown, nor if no path is accepted.
    """
    status = F.col("status").try_cast("int")
    accepted = status < 400
    return paths.groupBy(*keys).agg(
        F.coalesce(
            F.bool_and(status.isNotNull()) & F.bool_and(F.when(accepted, F.col("reads_body"))), F.lit(False)
        ).alias("body_required")
    )


def rejected_only(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rejected``: whether all statuses of a group are from 400 to 599."""
    status = F.col("status").try_cast("int")
    return paths.groupBy(*keys).agg(F.bool_and(F.coalesce(status.between(400, 599), F.lit(False))).alias("rejected"))


def agreement(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each group's common values, and the names on which its rows disagree.

    Null agrees with anything. ``ambiguous`` is sorted; a disagreed value is null.
    """
    out = df.groupBy(*keys).agg(
        *(F.min(v).alias(v) for v in values), *((F.min(v) != F.max(v)).alias(f"{v}__differs") for v in values)
    )
    names = F.array_compact(F.array(*(F.when(F.col(f"{v}__differs"), F.lit(v)) for v in sorted(values))))
    return out.select(
        *keys, *(F.when(~F.coalesce(F.col(f"{v}__differs"), F.lit(False)), F.col(v)).alias(v) for v in values), names.alias("ambiguous")
    )


def bounds(facts: DataFrame, keys: list[str], kind: str = "decimal(38,10)") -> DataFrame:
    """``keys, lower, upper, conflict``: the tightest bounds, and whether they cross."""
    out = facts.groupBy(*keys).agg(
        F.max(F.col("lower").cast(kind)).alias("lower"), F.min(F.col("upper").cast(kind)).alias("upper")
    )
    return out.withColumn("conflict", F.coalesce(F.col("lower") > F.col("upper"), F.lit(False)))


def described(df: DataFrame, keys: list[str], value: str, separator: str = " / ") -> DataFrame:
    """``keys, values``: sorted distinct values in one text."""
    kinds = df.select(*keys, value).distinct()
    return kinds.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias("values"))
