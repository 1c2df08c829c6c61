"""Sets of methods and media types given by what they include and exclude.

A domain is two array columns. An empty include list means everything; what is
excluded never belongs. A condition is a domain of methods and one of media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text

#: Values that one set may list.
SET_LIMIT = 256


def allows(included: Column, excluded: Column, value: Column) -> Column:
    """Whether a value belongs to a domain; null lists count as empty."""
    included, excluded = (F.coalesce(x, F.array().cast("array<string>")) for x in (included, excluded))
    return ((F.size(included) == 0) | F.array_contains(included, value)) & ~F.array_contains(excluded, value)


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def intersect(a: Column, a_out: Column, b: Column, b_out: Column) -> Column:
    """Struct ``included, excluded, reachable`` of what both domains allow.

    With an include list on either side the result lists its values and
    excludes nothing; no value left means unreachable, never unrestricted.
    """
    a, a_out, b, b_out = map(_set, (a, a_out, b, b_out))
    gone = F.array_sort(F.array_union(a_out, b_out))
    both = F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.array_intersect(a, b))
    left = F.array_except(both, gone)
    finite = (F.size(a) > 0) | (F.size(b) > 0)
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(finite, left).otherwise(none).alias("included"),
        F.when(finite, none).otherwise(gone).alias("excluded"),
        (~finite | (F.size(left) > 0)).alias("reachable"),
    )


def set_problem(values: Column, media: bool) -> Column:
    """``condition.budget`` or ``condition.invalid`` for a set that can't be used, else null."""
    good = text.media_type if media else text.http_token
    values = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.size(values) > SET_LIMIT, "condition.budget").when(~F.forall(values, good), "condition.invalid")


def link(routes: DataFrame, variants: DataFrame, by: str = "operation_key") -> DataFrame:
    """Variants that apply to each route and medium: ``route columns, media, variant columns``.

    ``routes`` has ``method`` and ``media`` (array; empty for no content type);
    ``variants`` has ``methods, except_methods, media_types,
    except_media_types``. Rows meet on ``by`` first, so each key's pairs only
    are tested, and no cartesian product arises.
    """
    media = F.when(F.size("media") > 0, F.col("media")).otherwise(F.array(F.lit("")))
    asked = routes.select(*(c for c in routes.columns if c != "media"), F.explode(media).alias("media"))
    met = asked.join(variants, by)
    fits = allows(F.col("methods"), F.col("except_methods"), F.col("method")) & allows(
        F.col("media_types"), F.col("except_media_types"), F.col("media")
    )
    return met.where(fits)


def uncovered(routes: DataFrame, variants: DataFrame, by: str = "operation_key") -> DataFrame:
    """Route and medium pairs that no variant applies to."""
    media = F.when(F.size("media") > 0, F.col("media")).otherwise(F.array(F.lit("")))
    asked = routes.select(by, "method", F.explode(media).alias("media")).distinct()
    return asked.join(link(routes, variants, by).select(by, "method", "media"), [by, "method", "media"], "left_anti")


def rejects_only(statuses: Column) -> Column:
    """Whether a non-empty list holds statuses from 400 to 599 only."""
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s.rlike("^[45][0-9]{2}$"))
