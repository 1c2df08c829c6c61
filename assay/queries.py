"""Registered queries over the driver tables, with their DuckDB equivalents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import budgets, conditions, folds, graph, instance, projection, schema
from assay.plans import build, document
from assay.sources import nodes, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if SQL can express it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROPS_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}


@query("""
SELECT event_id, '/k' AS path, 'minimum' AS keyword FROM events WHERE CAST(props ->> '$.k' AS BIGINT) < 10
UNION ALL SELECT event_id, '' AS path, 'required' AS keyword FROM events WHERE (props -> '$.k') IS NULL""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks of the JSON in ``events.props``."""
    return schema.violations(table(spark, sf_dir, "events"), "props", PROPS_SCHEMA, ["event_id"])


@query("SELECT doc_id, 'ref.missing' AS code FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label refers to."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return budgets.missing(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT page_id, 'get_' || substr(sha256('GET ' || url), 1, 16) AS operation_id FROM pages")
def operation_id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short digests that name the operation of each page."""
    return table(spark, sf_dir, "pages").select("page_id", text.operation_id(F.lit("GET"), F.col("url")).alias("operation_id"))


@query(r"""
SELECT doc_id, CAST(len(regexp_split_to_array(text, '\r\n|\r|\n')) - CAST(regexp_matches(text, '(^|\r|\n)\z') AS INTEGER) AS INTEGER) AS n_lines,
  CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents""")
def stream_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.split_lines(F.col("text"))).alias("n_lines"), F.octet_length("text").alias("n_bytes"))


@query("""
SELECT conv_id, turn, CAST(used AS BIGINT) AS used, used > 1000 AS over FROM (
  SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)""")
def cumulative_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each conversation so far, and where 1000 are passed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return budgets.byte_budget(turns, ["conv_id"], ["turn"], F.col("size"), 1000).drop("size")


_CONDITIONS = [
    ("first", ["en", "fr"], [], [], ["src0"]),
    ("second", [], ["en"], ["src1", "src2", "src3"], []),
    ("third", ["de"], ["de"], [], []),
    ("fourth", [], [], ["src0"], []),
]


@query("""
WITH c(variant, inc, exc, minc, mexc) AS (VALUES
  ('first', ['en', 'fr'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['src0']),
  ('second', CAST([] AS VARCHAR[]), ['en'], ['src1', 'src2', 'src3'], CAST([] AS VARCHAR[])),
  ('third', ['de'], ['de'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])),
  ('fourth', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['src0'], CAST([] AS VARCHAR[])))
SELECT doc_id, variant FROM documents JOIN c
  ON (len(inc) = 0 OR list_contains(inc, lang)) AND NOT list_contains(exc, lang)
  AND (len(minc) = 0 OR list_contains(minc, source)) AND NOT list_contains(mexc, source)""")
def condition_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose condition each document's language and source meet."""
    variants = spark.createDataFrame(
        [("doc", *c) for c in _CONDITIONS],
        "operation_key string, variant string, methods array<string>, except_methods array<string>, media_types array<string>, except_media_types array<string>",
    )
    routes = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("doc").alias("operation_key"), F.col("lang").alias("method"), F.array("source").alias("media")
    )
    # the decision table is a literal of four rows
    return conditions.link(routes, F.broadcast(variants)).select("doc_id", "variant")


@query(r"""
SELECT shape, count(*) AS n_pages, min(page_id) AS first_page FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[0-9]+', '{id}', 'g'), '\{[^{}]+\}', '{}', 'g') AS shape FROM pages)
GROUP BY shape""")
def path_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the shape of their paths, numbers read as template names."""
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "[0-9]+", "{id}")
    pages = table(spark, sf_dir, "pages").select("page_id", text.path_shape(path).alias("shape"))
    return pages.groupBy("shape").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


@query("SELECT source, string_agg(lang, ' / ' ORDER BY lang) AS \"values\" FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def enum_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each source in one text."""
    return folds.described(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""
WITH RECURSIVE edges AS (
  SELECT DISTINCT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem
  UNION SELECT DISTINCT l_partkey * 2 + 1, l_orderkey * 2 FROM lineitem),
walk(node) AS (SELECT min(src) FROM edges WHERE src % 2 = 0 UNION SELECT dst FROM walk JOIN edges ON src = node)
SELECT node FROM walk""")
def reachable_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (even) and parts (odd) that the first order reaches in any number of steps."""
    return reachable_closure(spark, sf_dir).select("node")


@query()
def reachable_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (even) and parts (odd) that the first order reaches, with the fewest steps."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    edges = items.unionByName(items.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.reachable(edges, items.agg(F.min("src").alias("node")))


@query("""
SELECT doc_id, first_holder FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_holder FROM documents) WHERE doc_id > first_holder""")
def duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text an earlier one holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return budgets.duplicates(docs, ["digest"], "doc_id").select("doc_id", "first_holder")


@query("""
SELECT conv_id, turn, CAST(ordinal AS INTEGER) AS ordinal FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations) WHERE ordinal > 3""")
def item_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns beyond the third of each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return budgets.item_limit(turns, ["conv_id"], ["turn"], 3).where("over").drop("over")


_DOMAINS = [
    (1, ["GET", "POST"], [], ["POST", "PUT"], []),
    (2, [], ["GET"], [], ["PUT", "GET"]),
    (3, ["GET"], [], [], ["HEAD"]),
    (4, ["GET"], [], ["POST"], []),
]


@query("""
WITH c(id, a, ax, b, bx) AS (VALUES
  (1, ['GET', 'POST'], CAST([] AS VARCHAR[]), ['POST', 'PUT'], CAST([] AS VARCHAR[])),
  (2, CAST([] AS VARCHAR[]), ['GET'], CAST([] AS VARCHAR[]), ['PUT', 'GET']),
  (3, ['GET'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['HEAD']),
  (4, ['GET'], CAST([] AS VARCHAR[]), ['POST'], CAST([] AS VARCHAR[]))),
d AS (SELECT id, len(a) > 0 OR len(b) > 0 AS finite, list_sort(list_distinct(list_concat(ax, bx))) AS gone,
  CASE WHEN len(a) = 0 THEN b WHEN len(b) = 0 THEN a ELSE list_filter(a, lambda x: list_contains(b, x)) END AS joint FROM c),
e AS (SELECT id, finite, gone, list_sort(list_filter(joint, lambda x: NOT list_contains(gone, x))) AS rest FROM d)
SELECT id, array_to_string(CASE WHEN finite THEN rest ELSE [] END, ',') AS included,
  array_to_string(CASE WHEN finite THEN [] ELSE gone END, ',') AS excluded, NOT finite OR len(rest) > 0 AS reachable FROM e""")
def condition_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections of domains, one of them unreachable."""
    rows = spark.createDataFrame(_DOMAINS, "id int, a array<string>, ax array<string>, b array<string>, bx array<string>")
    met = rows.select("id", conditions.intersect(F.col("a"), F.col("ax"), F.col("b"), F.col("bx")).alias("m"))
    return met.select(
        "id", F.array_join("m.included", ",").alias("included"), F.array_join("m.excluded", ",").alias("excluded"), "m.reachable"
    )


@query("""
WITH own AS (SELECT l_orderkey AS k, min(l_linestatus) AS v FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey)
SELECT k AS order_key, v AS value, 'own' AS origin FROM own
UNION ALL SELECT o_orderkey, o_orderstatus, 'inherited' FROM orders WHERE NOT EXISTS (SELECT 1 FROM own WHERE k = o_orderkey)""")
def parameter_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of orders, those of their larger items first."""
    inherited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("value"))
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 5")
    own = items.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.min("l_linestatus").alias("value"))
    return budgets.overridden(inherited, own, ["order_key"])


@query("SELECT user_id, bool_and(coalesce(value > 1, false)) AS required FROM events GROUP BY user_id")
def all_paths_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users all of whose events have a value above one."""
    return folds.required_by_all(table(spark, sf_dir, "events"), ["user_id"], F.col("value") > 1)


@query("""
WITH g AS (SELECT source AS g, lang, min(doc_id) AS seen FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
f AS (SELECT g, count(*) AS n, string_agg(lang, ',' ORDER BY seen) AS v FROM g GROUP BY g)
SELECT g, CAST(n AS INTEGER) AS n, CASE WHEN n = 1 THEN v ELSE 'anyOf(' || v || ')' END AS folded FROM f""")
def schema_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents of each source, in the order in which they came."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("g"), "lang", "doc_id")
    return folds.alternatives(docs, ["g"], "lang", order="doc_id").select("g", F.size("alternatives").alias("n"), "folded")


@query()
def projected_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON Schema of each column of ``lineitem``."""
    return projection.projected_schema(spark, table(spark, sf_dir, "lineitem"))


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS event_no,
  replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS data, role AS event,
  CAST(turn AS VARCHAR) AS id, CAST(turn AS VARCHAR) AS retry, false AS over FROM conversations""")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as event streams, line ends of all three kinds among them, and read again."""
    turns = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    # a text's own line ends are kept as they are
    lines = F.concat(F.lit("data: "), F.regexp_replace("text", "(\r\n|\r|\n)", "$1data: "))
    frame = F.concat(
        F.lit(": note\nevent: "), F.col("role"), F.lit("\nid: "), turn, F.lit("\nretry: 00"), turn, F.lit("\n"), lines, F.lit("\n\n")
    )
    written = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", frame.alias("frame")))).alias("f"))
    joined = F.concat(F.lit("\ufeff"), F.array_join(F.transform("f", lambda x: x["frame"]), ""), F.lit("data: unfinished"))
    return streams.events(written.select("conv_id", joined.alias("stream")), "stream", ["conv_id"])


@query("""
WITH v AS (SELECT DISTINCT CAST(CAST(l_discount * 100 - 4 AS INTEGER) AS VARCHAR) || 'e-' || CAST(l_linenumber % 3 AS VARCHAR) AS number_text FROM lineitem)
SELECT number_text, CAST(number_text AS DOUBLE) < 0 AS negative, CAST(number_text AS DOUBLE) = 0 AS zero,
  CAST(number_text AS DECIMAL(18, 6)) = floor(CAST(number_text AS DECIMAL(18, 6))) AS "integer" FROM v""")
def number_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign, zero and wholeness of decimal texts with exponents, by their digits."""
    whole = F.round(F.col("l_discount") * 100 - 4).cast("int").cast("string")
    made = F.concat(whole, F.lit("e-"), (F.col("l_linenumber") % 3).cast("string"))
    texts = table(spark, sf_dir, "lineitem").select(made.alias("number_text")).distinct()
    return texts.select("number_text", text.number_traits(F.col("number_text")).alias("t")).select("number_text", "t.*")


@query("SELECT page_id, NOT contains(regexp_replace(html, '%[0-9A-Fa-f]{2}', '', 'g'), '%') AS valid FROM pages")
def percent_escape_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every percent sign of a page starts an escape."""
    return table(spark, sf_dir, "pages").select("page_id", text.percent_valid(F.col("html")).alias("valid"))


@query("""
SELECT 'ref.missing' AS code, '/documents/' || doc_id AS path, 'no label' AS message FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'contract.instance', '/events/' || event_id || '/k', 'minimum' FROM events WHERE CAST(props ->> '$.k' AS BIGINT) < 10""")
def sorted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two rules in one order."""
    lost = missing_references(spark, sf_dir).select(
        "code", F.concat(F.lit("/documents/"), F.col("doc_id")).alias("path"), F.lit("no label").alias("message")
    )
    bad = schema_violations(spark, sf_dir).select(
        F.lit("contract.instance").alias("code"), F.concat(F.lit("/events/"), F.col("event_id"), F.col("path")).alias("path"), F.col("keyword").alias("message")
    )
    return budgets.ordered_issues(lost, bad)


@query("""
SELECT o.o_orderpriority AS shape, bool_and(o.o_totalprice > 1000) AS required, count(*) AS n, min(o.o_orderkey) AS first_holder
FROM orders o GROUP BY 1""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of all rows of each priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("shape")).agg(
        F.bool_and(F.col("o_totalprice") > 1000).alias("required"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_holder")
    )


@query("""
SELECT c_nationkey AS nation, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS c_mktsegment,
  CASE WHEN min(c_nationkey) = max(c_nationkey) THEN min(c_nationkey) END AS key,
  CASE WHEN min(c_mktsegment) <> max(c_mktsegment) THEN 'c_mktsegment' ELSE '' END AS ambiguous FROM customer GROUP BY c_nationkey""")
def metadata_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that all customers of a nation share, and the names on which they differ."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_mktsegment", F.col("c_nationkey").alias("key"))
    return folds.agreement(rows, ["nation"], ["c_mktsegment", "key"]).withColumn("ambiguous", F.array_join("ambiguous", ","))


@query("""
SELECT s_nationkey AS nation, CAST(max(CAST(s_acctbal AS DECIMAL(38, 10))) AS DOUBLE) AS lower, CAST(min(CAST(s_acctbal + 5000 AS DECIMAL(38, 10))) AS DOUBLE) AS upper,
  max(CAST(s_acctbal AS DECIMAL(38, 10))) > min(CAST(s_acctbal + 5000 AS DECIMAL(38, 10))) AS conflict FROM supplier GROUP BY s_nationkey""")
def bound_tightening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tightest bounds that the suppliers of a nation set."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("lower"), (F.col("s_acctbal") + 5000).alias("upper")
    )
    return folds.bounds(rows, ["nation"]).withColumns({c: F.col(c).cast("double") for c in ("lower", "upper")})


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000), n AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT coalesce(d.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'unused' ELSE 'missing' END AS problem
FROM d FULL JOIN n ON d.k = n.k WHERE d.k IS NULL OR n.k IS NULL""")
def one_sided_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with large orders but no balance, and the reverse."""
    declared = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    named = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return budgets.one_sided(declared, named, ["k"])


@query("""
WITH c AS (SELECT user_id, min(ts) AS commit_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, e.event_type AS name, arg_max(value, ts) AS value FROM events e JOIN c ON e.user_id = c.user_id AND ts < commit_ts GROUP BY ALL""")
def snapshot_as_of_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last value of every type before the first purchase."""
    events = table(spark, sf_dir, "events")
    return budgets.as_of(
        events.select("user_id", F.col("event_type").alias("name"), "ts", "value"),
        events.where("event_type = 'purchase'").select("user_id", "ts"),
        ["user_id"],
        "ts",
        "value",
    )


@query("""
SELECT n_nationkey AS key, n_name AS expected, r_name AS actual,
  CASE WHEN r_name IS NULL THEN 'unknown' WHEN r_name = n_name THEN 'match' ELSE 'mismatch' END AS status
FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""")
def build_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and actual values of keys."""
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    actual = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return budgets.selectors(expected, actual)


@query("""
WITH RECURSIVE link AS (SELECT p_partkey AS node, p_partkey // 2 AS target FROM part WHERE p_partkey > 1),
walk(node, place, hops) AS (SELECT node, target, 1 FROM link UNION ALL SELECT w.node, target, hops + 1 FROM walk w JOIN link l ON l.node = w.place)
SELECT node, arg_max(place, hops) AS "end", CAST(max(hops) AS BIGINT) AS hops, false AS cyclic FROM walk GROUP BY node""")
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of halved part keys end."""
    parts = table(spark, sf_dir, "part").where("p_partkey > 1")
    return graph.chain_ends(parts.select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("target")))


@query(r"""
SELECT page_id, path, coalesce(max_by(a, length(a)), NULL) AS ancestor FROM (
  SELECT page_id, path, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS a FROM (
    SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)))
WHERE a IN ('', '/en', '/fr', '/es/533') GROUP BY page_id, path""")
def nearest_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of four prefixes that each page's path lies under."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    known = spark.createDataFrame([("",), ("/en",), ("/fr",), ("/es/533",)], "path string")
    return pages.join(graph.nearest_ancestor(pages, known), "path").select("page_id", "path", "ancestor")


@query("""
SELECT o_orderstatus AS path, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority <> '1-URGENT') AS other
FROM orders GROUP BY 1""")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two kinds in one pass."""
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("path")).agg(F.sum(urgent).alias("urgent"), F.sum(1 - urgent).alias("other"))


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS \"bytes\" FROM documents WHERE strlen(text) > 4096")
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beyond a byte limit."""
    docs = streams.line_budget(table(spark, sf_dir, "documents"), "text", ["doc_id"], max_bytes=4096)
    return docs.where(F.col("bytes") > 4096).select("doc_id", "bytes")


@query("""
SELECT event_id, CASE WHEN CAST(props ->> '$.k' AS BIGINT) % 7 = 0 THEN 'multiple' ELSE 'other' END AS branch FROM events
WHERE NOT (CAST(props ->> '$.k' AS BIGINT) % 7 = 0 AND CAST(props ->> '$.k' AS BIGINT) > 50)""")
def conditional_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose ``k``, if a multiple of seven, is at most fifty."""
    rule = {"if": {"properties": {"k": {"multipleOf": 7}}}, "then": {"properties": {"k": {"maximum": 50}}}}
    events = table(spark, sf_dir, "events").select("event_id", "props")
    kept = schema.valid(events, "props", rule).where("valid")
    seventh = schema.valid(kept, "props", rule["if"], "seventh")
    return seventh.select("event_id", F.when(F.col("seventh"), "multiple").otherwise("other").alias("branch"))


@query()
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of service descriptions made from the pages, some with planted faults."""
    return document.check(document.sample_documents(table(spark, sf_dir, "pages")))


@query()
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of ``events.props``."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc"), F.col("props").alias("content"))
    return nodes.parsed(events).select("doc", "path", "parent", "key", "depth", "kind", "num_text")


@query("""
SELECT event_id, '/k' AS path, 'minimum' AS keyword FROM events WHERE CAST(props ->> '$.k' AS BIGINT) < 10
UNION ALL SELECT event_id, '' AS path, 'required' AS keyword FROM events WHERE (props -> '$.k') IS NULL""")
def evaluated_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed checks of ``events.props`` by the whole evaluator."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    found = instance.validated(events, "props", json.dumps(PROPS_SCHEMA))
    return found.select("event_id", F.explode("errors").alias("e")).select("event_id", "e.path", "e.keyword")


@query(r"""
SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9!#$%&''*+.^_`|~-]+') AS token,
  regexp_full_match(p_brand || '/' || p_type, '[A-Za-z0-9!#$%&''*+.^_`|~-]+/[A-Za-z0-9!#$%&''*+.^_`|~-]+') AND NOT contains(p_brand || p_type, '*') AS media,
  regexp_full_match(CAST(p_size * 20 AS VARCHAR), 'default|[1-5](XX|[0-9]{2})') AS status,
  regexp_full_match(p_name, '[a-zA-Z0-9._-]+') AS component, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_.-]*') AS anchor,
  p_size * 20 BETWEEN 100 AND 199 OR p_size * 20 IN (204, 304) AS bodyless
FROM part""")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names read as tokens, media types, statuses, components and anchors."""
    status = (F.col("p_size") * 20).cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.http_token(F.col("p_brand")).alias("token"),
        text.media_type(F.concat("p_brand", F.lit("/"), "p_type")).alias("media"),
        text.status_key(status).alias("status"),
        text.component_name(F.col("p_name")).alias("component"),
        text.anchor_name(F.col("p_name")).alias("anchor"),
        text.bodyless_status(status).alias("bodyless"),
    )


@query(r"""
WITH e AS (SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS segment FROM pages)
SELECT page_id, segment, replace(replace(segment, '~1', '/'), '~0', '~') AS url, '/a/' || segment AS pointer, '/a' AS parent FROM e""")
def pointer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as pointer segments and back."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.pointer_escape(F.col("url")).alias("segment"))
    pointed = pages.withColumn("pointer", F.concat(F.lit("/a/"), "segment"))
    return pointed.select(
        "page_id", "segment", text.pointer_unescape(F.col("segment")).alias("url"), "pointer", text.pointer_parent(F.col("pointer")).alias("parent")
    )


@query("""
WITH v(variant, langs, sources) AS (VALUES ('a', ['en', 'fr'], CAST([] AS VARCHAR[])), ('b', ['de'], ['src0', 'src1']))
SELECT DISTINCT lang AS operation_key, lang AS method, source AS media FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM v WHERE list_contains(langs, d.lang) AND (len(sources) = 0 OR list_contains(sources, d.source)))""")
def uncovered_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and sources that no variant covers."""
    rows = [(lang, name, langs, [], sources, []) for name, langs, sources in (("a", ["en", "fr"], []), ("b", ["de"], ["src0", "src1"])) for lang in langs]
    variants = spark.createDataFrame(
        rows,
        "operation_key string, variant string, methods array<string>, except_methods array<string>, media_types array<string>, except_media_types array<string>",
    )
    docs = table(spark, sf_dir, "documents")
    routes = docs.select(F.col("lang").alias("operation_key"), F.col("lang").alias("method"), F.array("source").alias("media")).distinct()
    return conditions.uncovered(routes, variants)


@query("""
WITH c AS (SELECT p_brand AS owner, p_type AS name, p_size % 3 AS depth, p_retailprice > 1000 AS tagged FROM part),
r AS (SELECT *, rank() OVER (PARTITION BY owner, name ORDER BY depth, tagged DESC) AS place FROM c),
b AS (SELECT owner, name, depth, tagged, count(*) OVER (PARTITION BY owner, name) AS n FROM r WHERE place = 1)
SELECT owner, name, depth, tagged FROM b WHERE n = 1""")
def wire_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that owns each name of a brand, where one does."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("owner"), F.col("p_type").alias("name"), (F.col("p_size") % 3).alias("depth"), (F.col("p_retailprice") > 1000).alias("tagged")
    )
    return projection.wire_fields(parts, ["owner"])


@query("""
SELECT user_id, min(event_id) FILTER (event_type = 'view') AS "GET", min(event_id) FILTER (event_type = 'click') AS "POST",
  min(event_id) FILTER (event_type = 'signup') AS "PUT", array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type IN ('error', 'purchase'))), ',') AS additional
FROM events GROUP BY user_id""")
def method_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of each user by fixed method, and the names of other methods."""
    kinds = F.create_map(*(F.lit(x) for x in ("view", "GET", "click", "POST", "signup", "PUT")))
    events = table(spark, sf_dir, "events").select("user_id", F.coalesce(kinds[F.col("event_type")], "event_type").alias("method"), "event_id")
    wide = projection.method_pivot(events, "user_id", "method", F.col("event_id"))
    names = F.array_join(F.array_sort(F.map_keys("additional")), ",")
    return wide.select("user_id", "GET", "POST", "PUT", names.alias("additional"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, p_partkey % 3 = 0 AS passes FROM part WHERE p_partkey > 1),
walk(root, node, inherits) AS (
  SELECT p_partkey, p_partkey, false FROM part
  UNION SELECT root, src, inherits OR passes FROM walk JOIN e ON dst = node)
SELECT DISTINCT root, node FROM walk WHERE inherits""")
def inheriting_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lead to any part over at least one inheriting edge."""
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "allOf").otherwise("ref")
    edges = parts.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"), kind.alias("kind"))
    return graph.descendants(edges, parts.select(F.col("p_partkey").alias("node")))


@query("""
WITH t AS (SELECT p_type AS name, CASE WHEN p_size > 45 THEN p_brand END AS parent FROM part)
SELECT 'tag.duplicate' AS code, name FROM t GROUP BY name HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'tag.parent', name FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT name FROM t)""")
def tag_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types that repeat, and those whose parent is no type."""
    parent = F.when(F.col("p_size") > 45, F.col("p_brand"))
    return graph.hierarchy_issues(table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), parent.alias("parent")))


@query("""
WITH RECURSIVE needs AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 AND p_partkey % 5 <> 0),
walk(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT n.node FROM walk w JOIN needs n ON n.needs = w.node)
SELECT node FROM walk""")
def proven_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose chain of needs ends at part 1; both needs of a proof are the same part here."""
    parts = table(spark, sf_dir, "part").where("p_partkey > 1 and p_partkey % 5 <> 0")
    rules = parts.select(F.col("p_partkey").alias("node"), F.lit(1).alias("proof"), F.expr("p_partkey div 2").alias("needs"))
    return graph.proven(spark.createDataFrame([(1,)], "node long"), rules)


_STATUS = {"view": "200", "click": "201", "error": "500", "signup": None, "purchase": "204"}


@query("""
WITH p AS (SELECT user_id % 400 + CAST(event_id % 200 AS BIGINT) AS k, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 201 WHEN 'error' THEN 500 WHEN 'purchase' THEN 204 END AS status,
  value > 5 AS reads FROM events)
SELECT k, coalesce(bool_and(status IS NOT NULL) AND bool_and(reads) FILTER (status < 400), false) AS body_required,
  bool_and(coalesce(status BETWEEN 400 AND 599, false)) AS rejected FROM p GROUP BY k""")
def inferred_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events read as paths: whether the body is required, and whether all are rejected."""
    kinds = F.create_map(*(F.lit(x) for k, v in _STATUS.items() if v for x in (k, v)))
    paths = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 400 + F.col("event_id") % 200).alias("k"), kinds[F.col("event_type")].alias("status"), (F.col("value") > 5).alias("reads_body")
    )
    return folds.body_required(paths, ["k"]).join(folds.rejected_only(paths, ["k"]), "k")


@query("""
SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rows with sorted columns."""
    return projection.fingerprint(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("""
SELECT n_nationkey AS key, n_name AS name, 'missing' AS side FROM nation WHERE n_regionkey = 0
UNION ALL SELECT r_regionkey, r_name, 'extra' FROM region""")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two tables has."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    others = nations.where("n_regionkey <> 0").drop("n_regionkey")
    return budgets.stale(nations.drop("n_regionkey"), others.unionByName(regions))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_records, count(*) FILTER (contains(rtrim(line, chr(13)), chr(13))) AS n_bad FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY doc_id""")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank records of each document, and those with a bare CR."""
    found = streams.records(table(spark, sf_dir, "documents"), "text", ["doc_id"], max_items=1 << 30)
    bad = F.sum((F.col("code") == "contract.ndjson").cast("long"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(bad, F.lit(0)).alias("n_bad"))


@query(r"""
WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '([a-z]+)/([0-9]+)', '{\1}/{id\2}') AS path FROM pages),
x AS (SELECT page_id, path, regexp_extract_all(path, '\{([^}]*)\}', 1) AS names FROM p)
SELECT page_id, path, CAST(i - 1 AS INTEGER) AS position, names[i] AS name FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM x)""")
def path_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names between braces of templates made from page paths."""
    tail = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    path = F.concat(F.lit("/"), F.regexp_replace(tail, "([a-z]+)/([0-9]+)", "{$1}/{id$2}"))
    return projection.derived_parameters(table(spark, sf_dir, "pages").select("page_id", path.alias("path")))


@query("""
SELECT c_nationkey AS place, c_mktsegment AS name, c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first_holder
FROM customer QUALIFY c_custkey > first_holder""")
def repeated_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the first of their nation and segment."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"))
    return budgets.duplicates(rows, ["place", "name"], "id")


@query()
def linked_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of routes made from page paths, linked to four variants."""
    variants = spark.createDataFrame(
        [
            ("page", "a", ["GET"], [], [], [], "200", "string", "read", False),
            ("page", "b", ["POST"], [], ["application/json"], [], "201", "integer", "make", True),
            ("page", "c", ["POST"], [], ["text/plain"], [], "201", "string", "make", True),
            ("page", "d", [], ["GET", "POST"], [], [], "405", "null", None, False),
        ],
        "operation_key string, variant string, methods array<string>, except_methods array<string>, media_types array<string>, "
        "except_media_types array<string>, status string, schema string, description string, reads_body boolean",
    )
    even = F.col("page_id") % 2 == 0
    media = F.when(even, F.array().cast("array<string>")).otherwise(F.array(F.lit("application/json"), F.lit("text/plain")))
    routes = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("route"),
        F.when(even, "GET").otherwise("POST").alias("method"),
        F.regexp_extract("url", "://[^/?#]*(/[^?#]*)", 1).alias("path"),
        F.lit("page").alias("operation_key"),
        media.alias("media"),
    )
    return build.operations(routes, variants)
