"""Budgets and identities that depend on order. Nothing is cut off: what is over a budget gets a row that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_budget(df: DataFrame, keys: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """``df`` with ``used`` (bytes so far in the group) and ``over`` (whether that is beyond the limit)."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.coalesce(size.cast("long"), F.lit(0))).over(window)
    return df.withColumn("used", used).withColumn("over", F.col("used") > limit)


def item_limit(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """``df`` with ``ordinal`` in the group and ``over``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("ordinal", F.row_number().over(window)).withColumn("over", F.col("ordinal") > limit)


def over_limit(df: DataFrame, keys: list[str], order: list[str], limit: int, code: str) -> DataFrame:
    """One diagnostic per group that has more rows than the limit, at the first row beyond it."""
    found = item_limit(df, keys, order, limit).where(F.col("ordinal") == limit + 1)
    return found.select(*keys, F.lit(code).alias("code"), *order)


def duplicates(df: DataFrame, keys: list[str], holder: str) -> DataFrame:
    """Rows after the first of their identity, with ``first_holder``. Null keys are no identity.

    The first holders come from a pre-aggregated minimum and meet the rows in a
    join that Spark may split, so one identity may have any share of the rows.
    """
    firsts = df.dropna(subset=keys).groupBy(*keys).agg(F.min(holder).alias("first_holder"), F.count(F.lit(1)).alias("holders"))
    firsts = firsts.where("holders > 1").drop("holders")
    return df.join(firsts, keys).where(F.col(holder) > F.col("first_holder"))


def overridden(inherited: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Own rows, and inherited rows whose key no own row has; ``origin`` says which."""
    kept = inherited.join(own.select(*keys).distinct(), keys, "left_anti")
    return own.withColumn("origin", F.lit("own")).unionByName(kept.withColumn("origin", F.lit("inherited")))


def missing(uses: DataFrame, targets: DataFrame, keys: list[str], code: str = "ref.missing") -> DataFrame:
    """Uses without a target, with a code."""
    return uses.join(targets.select(*keys).distinct(), keys, "left_anti").withColumn("code", F.lit(code))


def one_sided(declared: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem``: declared but not named (``unused``), named but not declared (``missing``)."""
    left = declared.select(*keys).distinct().withColumn("d", F.lit(True))
    right = named.select(*keys).distinct().withColumn("n", F.lit(True))
    met = left.join(right, keys, "full_outer").where("d is null or n is null")
    return met.select(*keys, F.when(F.col("n").isNull(), "unused").otherwise("missing").alias("problem"))


def best_candidates(df: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The best row of each group by ``rank``; groups whose best rank is shared give none."""
    order = Window.partitionBy(*keys).orderBy(*rank)
    ranked = df.withColumn("place", F.rank().over(order)).where("place = 1")
    ties = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ties.where("n = 1").drop("place", "n")


def as_of(events: DataFrame, commits: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """For each commit, the last value of each name that was set before it.

    ``events`` has ``keys, name, seq, value``; ``commits`` has ``keys`` and
    ``seq``; the first commit of a group counts.
    """
    first = commits.groupBy(*keys).agg(F.min(seq).alias("commit"))
    before = events.join(first, keys).where(F.col(seq) < F.col("commit"))
    return before.groupBy(*keys, "name").agg(F.max_by(value, seq).alias(value))


def selectors(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """``key, expected, actual, status`` of build selectors: ``match``, ``mismatch`` or ``unknown``."""
    met = expected.select(key, F.col("value").alias("expected")).join(
        actual.select(key, F.col("value").alias("actual")), key, "left"
    )
    status = F.when(F.col("actual").isNull(), "unknown").when(F.col("actual") == F.col("expected"), "match").otherwise("mismatch")
    return met.withColumn("status", status)


def ordered_issues(*issues: DataFrame) -> DataFrame:
    """All issues by path, code and message, in byte order."""
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    return out.orderBy("path", "code", "message")


def stale(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``; none if both are equal as multisets."""
    return (
        expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))
    )
