"""Rules over the graph of schemas: proofs, inheritance and evidence through references.

A schema is named by its document and path. Edges come from resolved
references and from the items of ``allOf``, ``anyOf`` and ``oneOf``; every
search is a fixed point of joins over all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import pointer_parent
from assay.operators import graph

_SEP = "\u0001"


def _at(path: str | Column) -> Column:
    return F.concat(F.col("doc"), F.lit(_SEP), F.col(path) if isinstance(path, str) else path)


def _issue(df: DataFrame, code: str, path: Column, message: str) -> DataFrame:
    return df.select("doc", F.lit(code).alias("code"), path.alias("path"), F.lit(message).alias("message"))


def parts(nodes: DataFrame) -> DataFrame:
    """``doc, owner, keyword, path``: schemas inside a composition of another schema."""
    inside = F.col("path").rlike("/(allOf|anyOf|oneOf)/[0-9]+$")
    items = nodes.where((F.col("role") == "schema") & inside)
    return items.select(
        "doc",
        F.regexp_replace("path", "/(allOf|anyOf|oneOf)/[0-9]+$", "").alias("owner"),
        F.regexp_extract("path", "/(allOf|anyOf|oneOf)/[0-9]+$", 1).alias("keyword"),
        "path",
    )


def proved_required(objects: DataFrame, nodes: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, path, property`` of schemas that provably require a property of ``wanted(doc, property)``.

    A schema requires what it lists, what its reference requires, what any part
    of ``allOf``, all of ``anyOf`` or ``oneOf``, or both branches of a
    conditional require.
    """
    schemas = objects.where("role = 'schema'")
    props = wanted.select("doc", "property").distinct()
    listed = nodes.where((F.col("kind") == "string") & F.col("parent").endswith("/required")).select(
        "doc", pointer_parent(F.col("parent")).alias("path"), F.col("str").alias("property")
    )
    facts = listed.join(props, ["doc", "property"], "left_semi").join(schemas.select("doc", "path"), ["doc", "path"], "left_semi")
    refs = found.where("code is null and role = 'schema'").select("doc", "path", F.lit("ref").alias("proof"), F.col("target").alias("needs"))
    pieces = parts(nodes)
    any_of = pieces.where("keyword = 'allOf'").select("doc", F.col("owner").alias("path"), F.col("path").alias("proof"), F.col("path").alias("needs"))
    all_of = pieces.where("keyword <> 'allOf'").select("doc", F.col("owner").alias("path"), F.col("keyword").alias("proof"), F.col("path").alias("needs"))
    branched = schemas.where(F.forall(F.array(F.lit("if"), F.lit("then"), F.lit("else")), lambda k: F.map_contains_key("kids", k)))
    both = branched.select("doc", "path", F.lit("if").alias("proof"), F.explode(F.array(F.lit("/then"), F.lit("/else"))).alias("k"))
    both = both.select("doc", "path", "proof", F.concat("path", "k").alias("needs"))
    rules = refs.unionByName(any_of).unionByName(all_of).unionByName(both).join(props, "doc")
    key = lambda path: F.concat(_at(path), F.lit(_SEP), F.col("property"))
    held = graph.proven(facts.select(key("path").alias("node")), rules.select(key("path").alias("node"), "proof", key("needs").alias("needs")))
    split = F.split("node", _SEP)
    return held.select(split[0].alias("doc"), split[1].alias("path"), split[2].alias("property"))


def discriminator_issues(objects: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Where a discriminator has no alternatives, no usable fallback, or maps to a schema that is none of them."""
    owned = objects.where("role = 'discriminator'").select(
        "doc",
        F.col("path").alias("at"),
        pointer_parent(F.col("path")).alias("path"),
        F.col("kids")["propertyName"]["str"].alias("property"),
        F.map_contains_key("kids", "defaultMapping").alias("fallback"),
    )
    owned = owned.where("property is not null").join(objects.select("doc", "path", F.map_keys("kids").alias("keys")), ["doc", "path"])
    owned = graph.cut(owned)
    if owned.isEmpty():
        return _issue(owned, "", F.col("at"), "")
    union = F.array_contains("keys", "oneOf") | F.array_contains("keys", "anyOf")
    refs = found.where("code is null and role = 'schema'").select(_at("path").alias("src"), _at("target").alias("dst"), F.lit("ref").alias("kind"))
    inherits = parts(nodes).where("keyword = 'allOf'").select(_at("owner").alias("src"), _at("path").alias("dst"), F.lit("allOf").alias("kind"))
    heirs = graph.descendants(refs.unionByName(inherits), owned.where(~union).select(_at("path").alias("node"))).where("root <> node")
    heirs = graph.cut(heirs)
    childless = owned.where(~union & ~F.array_contains("keys", "allOf")).withColumn("root", _at("path")).join(heirs, "root", "left_anti")
    out = _issue(childless, "spec.discriminator.context", F.col("at"), "no alternatives beside the discriminator")
    proved = graph.cut(proved_required(objects, nodes, found, owned))
    open_ones = owned.join(proved, ["doc", "path", "property"], "left_anti")
    bare = open_ones.where(~F.col("fallback"))
    out = out.unionByName(
        _issue(bare, "spec.discriminator.default.required", F.concat("at", F.lit("/defaultMapping")), "the property may be absent")
    )
    # mapping values: component names first, then references within the document
    mapped = nodes.where((F.col("kind") == "string") & F.col("path").rlike("/discriminator/(mapping/[^/]+|defaultMapping)$"))
    mapped = mapped.select("doc", F.col("path").alias("map_path"), "str", F.regexp_replace("path", "/(mapping/[^/]+|defaultMapping)$", "").alias("at"))
    mapped = mapped.withColumn("by_name", F.concat(F.lit("/components/schemas/"), "str"))
    mapped = mapped.withColumn("by_pointer", F.when(F.col("str").startswith("#/"), F.substr("str", F.lit(2))))
    known = objects.where("role = 'schema'").select("doc", F.col("path").alias("target"))
    named = mapped.join(known.withColumnRenamed("target", "by_name"), ["doc", "by_name"], "left_semi").withColumn("target", F.col("by_name"))
    pointed = mapped.join(known.withColumnRenamed("target", "by_pointer"), ["doc", "by_pointer"], "left_semi").withColumn("target", F.col("by_pointer"))
    columns = ["doc", "at", "map_path", "target"]
    targets = graph.cut(named.select(*columns).unionByName(pointed.select(*columns)).join(owned.select("doc", "at", "path", "property", union.alias("union")), ["doc", "at"]))
    # aliases: a schema and all that its references lead to
    walk = refs.select(F.col("src").alias("node"), F.col("dst").alias("target"))
    ends = graph.chain_ends(walk).select("node", F.coalesce("end", "node").alias("end"))
    listed = parts(nodes).where("keyword <> 'allOf'").select("doc", F.col("owner").alias("path"), _at("path").alias("node"))
    resolved = listed.join(ends, "node", "left").select("doc", "path", F.coalesce("end", "node").alias("identity"))
    asked = targets.withColumn("node", _at("target")).join(ends, "node", "left").withColumn("identity", F.coalesce("end", "node"))
    in_union = asked.where("union").join(resolved, ["doc", "path", "identity"], "left_anti")
    below = heirs.select(F.col("root"), F.col("node").alias("heir"))
    chained = asked.where(~F.col("union")).withColumn("root", _at("path"))
    own = chained.join(below.withColumnRenamed("heir", "node"), ["root", "node"], "left_anti")
    own = own.join(below.withColumnRenamed("heir", "identity"), ["root", "identity"], "left_anti")
    for lost in (in_union, own):
        out = out.unionByName(_issue(lost, "spec.discriminator.target", F.col("map_path"), "the target is no alternative"))
    fallback = targets.where(F.col("map_path").endswith("/defaultMapping")).join(proved, ["doc", "path", "property"], "left_anti")
    needs = proved.select("doc", F.col("path").alias("target"), "property")
    strict = fallback.join(needs, ["doc", "target", "property"], "left_semi")
    return out.unionByName(_issue(strict, "spec.discriminator.default.optional", F.col("map_path"), "the fallback requires the property"))


def encoding_issues(objects: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Positional encodings of media whose schema shows no evidence of an array."""
    has = lambda k: F.map_contains_key("kids", k)
    media = objects.where((F.col("role") == "media") & (has("prefixEncoding") | has("itemEncoding")) & ~has("itemSchema"))
    media = graph.cut(media.select("doc", "path", _at(F.concat("path", F.lit("/schema"))).alias("start")))
    if media.isEmpty():
        return _issue(media, "", F.col("path"), "")
    listed = nodes.where((F.col("kind") == "string") & (F.col("str") == "array") & F.col("parent").endswith("/type")).select(
        "doc", pointer_parent(F.col("parent")).alias("path"), F.lit(True).alias("listed")
    )
    schemas = objects.where("role = 'schema'").join(listed.distinct(), ["doc", "path"], "left")
    typed = F.coalesce(F.col("kids")["type"]["str"] == "array", F.lit(False)) | F.coalesce("listed", F.lit(False))
    evidence = typed | (~has("type") & (has("items") | has("prefixItems")))
    judged = graph.cut(schemas.select(_at("path").alias("node"), evidence.alias("array"), has("type").alias("typed")))
    steps = found.where("code is null and role = 'schema'").select(_at("path").alias("src"), _at("target").alias("dst"))
    steps = steps.unionByName(parts(nodes).select(_at("owner").alias("src"), _at("path").alias("dst")))
    # a schema with a type of its own says all there is
    edges = steps.join(judged.where("not typed").select(F.col("node").alias("src")), "src", "left_semi")
    # searches start at several media, so the start is part of the state
    reach = media.select("start", F.col("start").alias("node")).distinct()
    frontier = reach
    while True:
        ahead = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = graph.cut(ahead.join(reach, ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        reach, frontier = graph.cut(reach.unionByName(new)), new
    shown = reach.join(judged.where("array"), "node", "left_semi").select("start").distinct()
    lost = media.join(shown, "start", "left_anti")
    return _issue(lost, "spec.encoding.array", F.col("path"), "positional encoding needs an array")


def xml_issues(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wrapped`` beside a schema that is no array."""
    wrapped = objects.where((F.col("role") == "xml") & F.map_contains_key("kids", "wrapped")).select(
        "doc", F.col("path").alias("at"), pointer_parent(F.col("path")).alias("path")
    )
    schemas = objects.where("role = 'schema'").select("doc", "path", F.col("kids")["type"]["str"].alias("type"))
    listed = nodes.where((F.col("kind") == "string") & (F.col("str") == "array") & F.col("parent").endswith("/type")).select(
        "doc", pointer_parent(F.col("parent")).alias("path")
    )
    bad = wrapped.join(schemas, ["doc", "path"]).where("type is null or type <> 'array'").join(listed, ["doc", "path"], "left_anti")
    return _issue(bad, "spec.xml.wrapped", F.concat("at", F.lit("/wrapped")), "wrapped needs an array")
