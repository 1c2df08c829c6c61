"""Linking routes to the variants of contract templates.

``routes`` has ``route, method, path, operation_key, media array<string>``;
``templates`` has ``operation_key``; ``variants`` has ``operation_key,
variant, methods, except_methods, media_types, except_media_types`` and the
columns that operations take: ``status, schema, description, reads_body``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import budgets, conditions, folds

#: Variants that one template may have.
VARIANT_LIMIT = 1024


def route_issues(routes: DataFrame, templates: DataFrame, variants: DataFrame) -> DataFrame:
    """``route, code, message`` of routes that can't be linked as they are."""
    same = budgets.duplicates(routes, ["method", "path"], "route")
    out = same.select("route", F.lit("route.duplicate").alias("code"), F.concat_ws(" ", "method", "path").alias("message"))
    lost = routes.join(templates.select("operation_key").distinct(), "operation_key", "left_anti")
    out = out.unionByName(lost.select("route", F.lit("route.unresolved").alias("code"), F.col("operation_key").alias("message")))
    token = routes.where(~text.http_token(F.col("method")))
    out = out.unionByName(token.select("route", F.lit("method.invalid").alias("code"), F.col("method").alias("message")))
    # a variant that asks for a medium can't be judged for a route that names none
    restricted = variants.where((F.size("media_types") > 0) | (F.size("except_media_types") > 0)).select(
        "operation_key", "methods", "except_methods"
    )
    bare = routes.where(F.size("media") == 0).join(restricted, "operation_key")
    bare = bare.where(conditions.allows(F.col("methods"), F.col("except_methods"), F.col("method"))).select("route").distinct()
    out = out.unionByName(bare.select("route", F.lit("condition.media").alias("code"), F.lit("media is required").alias("message")))
    known = routes.join(templates.select("operation_key").distinct(), "operation_key", "left_semi").join(bare, "route", "left_anti")
    media = F.when(F.size("media") > 0, F.col("media")).otherwise(F.array(F.lit("")))
    asked = known.select("route", F.explode(media).alias("media"))
    met = conditions.link(known, variants).select("route", "media").distinct()
    bad = asked.join(met, ["route", "media"], "left_anti")
    return out.unionByName(bad.select("route", F.lit("condition.uncovered").alias("code"), F.col("media").alias("message")))


def template_issues(templates: DataFrame, variants: DataFrame) -> DataFrame:
    """``operation_key, code``: repeated keys, too many variants, and conditions that nothing or no value meets."""
    twice = templates.groupBy("operation_key").count().where("count > 1 or operation_key is null or operation_key = ''")
    out = twice.select("operation_key", F.lit("bundle.key").alias("code"))
    many = variants.groupBy("operation_key").count().where(F.col("count") > VARIANT_LIMIT)
    out = out.unionByName(many.select("operation_key", F.lit("condition.budget").alias("code")))
    names = (("methods", "except_methods", False), ("media_types", "except_media_types", True))
    problem = F.coalesce(*(conditions.set_problem(F.col(c), media) for a, b, media in names for c in (a, b)))
    empty = F.lit(False)
    none = F.array().cast("array<string>")
    for a, b, _ in names:
        empty = empty | ~conditions.intersect(F.col(a), F.col(b), none, none)["reachable"]
    code = F.coalesce(problem, F.when(empty, "condition.empty"))
    return out.unionByName(variants.select("operation_key", code.alias("code")).where("code is not null"))


def operations(routes: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per route that links: its id, the schemas of each status, and what the variants agree on.

    ``schema`` folds a status's alternatives in variant order; ``ambiguous``
    names the metadata on which variants differ; ``body_required`` is inferred
    from accepted paths; HEAD keeps no schema.
    """
    met = conditions.link(routes, variants)
    by_status = folds.alternatives(met.dropDuplicates(["route", "status", "variant"]), ["route", "status"], "schema", "variant")
    statuses = by_status.groupBy("route").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", F.col("folded").alias("schema"))))).alias("responses")
    )
    facts = folds.agreement(met, ["route"], ["description"]).withColumnRenamed("description", "agreed")
    bodies = folds.body_required(met, ["route"])
    out = routes.join(statuses, "route").join(facts, "route").join(bodies, "route")
    no_body = F.transform_values("responses", lambda _, v: F.lit(None).cast("string"))
    return out.select(
        "route",
        "method",
        "path",
        text.operation_id(F.col("method"), F.col("path")).alias("operation_id"),
        text.path_parameters(F.col("path")).alias("parameters"),
        F.when(F.col("method") == "HEAD", no_body).otherwise(F.col("responses")).alias("responses"),
        F.col("agreed").alias("description"),
        "ambiguous",
        "body_required",
    )


def build(routes: DataFrame, templates: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations of the routes without issues, and all issues.

    Issues of templates that no route selects don't count.
    """
    selected = templates.join(routes.select("operation_key").distinct(), "operation_key", "left_semi")
    used = variants.join(routes.select("operation_key").distinct(), "operation_key", "left_semi")
    broken = template_issues(selected, used)
    issues = route_issues(routes, templates, variants)
    by_template = routes.join(broken, "operation_key").select("route", "code", F.col("operation_key").alias("message"))
    issues = issues.unionByName(by_template)
    clean = routes.join(issues.select("route").distinct(), "route", "left_anti")
    return operations(clean, variants), issues.orderBy("route", "code", "message")
