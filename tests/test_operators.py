import pytest
from pyspark.sql import functions as F

from assay.operators import budgets, conditions, folds, graph, instance, projection, schema


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- conditions ------------------------------------------------------------------

VARIANTS = [
    ("k", "read", ["GET"], [], [], []),
    ("k", "json", ["POST"], [], ["application/json"], []),
    ("k", "text", ["POST"], [], ["text/plain"], []),
    ("k", "other", ["POST"], [], [], ["", "application/json", "text/plain"]),
]
VARIANT_SQL = (
    "operation_key string, variant string, methods array<string>, except_methods array<string>, "
    "media_types array<string>, except_media_types array<string>"
)


@pytest.mark.parametrize(
    ("method", "media", "found"),
    [
        ("GET", [], ["read"]),
        ("POST", [], []),
        ("POST", ["application/json"], ["json"]),
        ("POST", ["text/plain"], ["text"]),
        ("POST", ["application/xml"], ["other"]),
        ("POST", ["application/json", "text/plain"], ["json", "text"]),
    ],
)
@pytest.mark.parametrize("order", [1, -1])
def test_variants_link(spark, method, media, found, order):
    routes = spark.createDataFrame([("k", method, media)], "operation_key string, method string, media array<string>")
    variants = spark.createDataFrame(VARIANTS[::order], VARIANT_SQL)
    assert sorted(r.variant for r in conditions.link(routes, variants).collect()) == found
    assert conditions.uncovered(routes, variants).isEmpty() == bool(found)


@pytest.mark.parametrize(
    ("a", "ax", "b", "bx", "want"),
    [
        (["A", "B"], [], ["B", "C"], [], (["B"], [], True)),
        ([], ["A"], [], ["B", "A"], ([], ["A", "B"], True)),
        (["A"], [], [], ["A"], ([], [], False)),
        (["A"], [], ["B"], [], ([], [], False)),
        ([], [], [], [], ([], [], True)),
        (["B", "A", "A"], ["B"], [], [], (["A"], [], True)),
    ],
)
def test_domains_intersect(spark, a, ax, b, bx, want):
    df = spark.createDataFrame([(a, ax, b, bx)], "a array<string>, ax array<string>, b array<string>, bx array<string>")
    got = df.select(conditions.intersect(*(F.col(c) for c in ("a", "ax", "b", "bx"))).alias("m")).first().m
    assert tuple(got) == want


def test_set_problems(spark):
    df = spark.createDataFrame([(["GET"],), (["a b"],), ([str(i) for i in range(257)],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(conditions.set_problem(F.col("v"), media=False)).collect()] == [
        None, "condition.invalid", "condition.budget", None,
    ]
    statuses = spark.createDataFrame([(["400", "500"],), ([],), (["302"],), (["default"],)], "v array<string>")
    assert [r[0] for r in statuses.select(conditions.rejects_only(F.col("v"))).collect()] == [True, False, False, False]


# ---- folds and budgets -------------------------------------------------------------


def test_alternatives_keep_first_seen_order(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (2, "x", 0), (2, None, 1)], "k int, v string, i int")
    assert rows(folds.alternatives(df, ["k"], "v", "i").select("k", "folded")) == [(1, "anyOf(b,a)"), (2, "x")]


def test_conjunction_and_union(spark):
    df = spark.createDataFrame([(["1", "1"],), (["1", "2", "1"],), ([],), (["1", None],)], "v array<string>")
    assert [r[0] for r in df.select(folds.conjunction(F.filter("v", lambda x: x.isNotNull()))).collect()] == ["1", '{"allOf":[1,2]}', None, "1"]
    assert [r[0] for r in df.select(folds.binary_union(F.col("v"))).collect()] == ["1", '{"anyOf":[{"anyOf":[1,2]},1]}', None, None]


def test_bodies(spark):
    df = spark.createDataFrame(
        [(1, "200", True), (1, "400", False), (2, "200", True), (2, None, True), (3, "404", True), (4, "200", False)],
        "k int, status string, reads_body boolean",
    )
    assert rows(folds.body_required(df, ["k"])) == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(folds.rejected_only(df, ["k"])) == [(1, False), (2, False), (3, True), (4, False)]


def test_agreement_and_bounds(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 3)], "k int, x string, y int")
    assert rows(folds.agreement(df, ["k"], ["x", "y"])) == [(1, "a", None, ["y"]), (2, "b", 3, [])]
    facts = spark.createDataFrame([(1, "3", None), (1, None, "2"), (2, "1", "9")], "k int, lower string, upper string")
    assert [(r.k, r.conflict) for r in folds.bounds(facts, ["k"]).orderBy("k").collect()] == [(1, True), (2, False)]


def test_budgets_at_their_limits(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(3)], "k string, i int, n int")
    assert [r.over for r in budgets.byte_budget(df, ["k"], ["i"], F.col("n"), 30).orderBy("i").collect()] == [False] * 3
    assert [r.over for r in budgets.byte_budget(df, ["k"], ["i"], F.col("n"), 29).orderBy("i").collect()] == [False, False, True]
    assert budgets.over_limit(df, ["k"], ["i"], 3, "budget").isEmpty()
    assert rows(budgets.over_limit(df, ["k"], ["i"], 2, "budget")) == [("a", "budget", 2)]


def test_identities(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id int, k string")
    assert rows(budgets.duplicates(df, ["k"], "id")) == [("x", 2, 1)]
    own = spark.createDataFrame([("q", "a", 1)], "place string, name string, v int")
    inherited = spark.createDataFrame([("q", "a", 2), ("h", "a", 3)], "place string, name string, v int")
    assert rows(budgets.overridden(inherited, own, ["place", "name"])) == [("h", "a", 3, "inherited"), ("q", "a", 1, "own")]
    assert rows(budgets.one_sided(own.select("name"), inherited.select(F.lit("b").alias("name")), ["name"])) == [("a", "unused"), ("b", "missing")]
    assert budgets.stale(df, df).isEmpty()
    assert budgets.stale(df, df.limit(4)).count() == 1


def test_best_candidates_and_snapshots(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("b", 1, False), ("b", 1, False)], "name string, depth int, tagged boolean")
    assert rows(budgets.best_candidates(df, ["name"], ["depth"])) == [("a", 0, True)]
    wide = df.withColumn("owner", F.lit(1))
    assert [r.name for r in projection.wire_fields(wide, ["owner"]).collect()] == ["a"]
    events = spark.createDataFrame([(1, "h", 1, "x"), (1, "h", 2, "y"), (1, "h", 4, "z")], "k int, name string, seq int, v string")
    commits = spark.createDataFrame([(1, 3), (1, 9)], "k int, seq int")
    assert rows(budgets.as_of(events, commits, ["k"], "seq", "v")) == [(1, "h", "y")]


# ---- graphs --------------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reachability_ends_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("a", "a"))
    assert rows(graph.reachable(e, nodes(spark, "a"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.reachable(e, nodes(spark, "a"), max_depth=1)) == [("a", 0), ("b", 1)]
    kept = graph.pruned(nodes(spark, "a", "d", "e"), e, nodes(spark, "d"))
    assert rows(kept) == [("d",), ("e",)]


def test_descendants_need_an_all_of_edge(spark):
    e = spark.createDataFrame([("Cat", "Pet", "allOf"), ("Alias", "Cat", "ref"), ("Other", "Pet", "ref")], "src string, dst string, kind string")
    assert rows(graph.descendants(e, nodes(spark, "Pet"))) == [("Pet", "Alias"), ("Pet", "Cat")]


def test_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "node string, target string")
    assert rows(graph.chain_ends(links).select("node", F.coalesce("end", F.lit("-")), "cyclic")) == [
        ("a", "c", False), ("b", "c", False), ("s", "-", True), ("x", "-", True), ("y", "-", True), ("z", "-", True),
    ]


def test_hierarchies(spark):
    tags = spark.createDataFrame(
        [("a", None), ("b", "a"), ("b", "a"), ("c", "lost"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s")], "name string, parent string"
    )
    assert rows(graph.hierarchy_issues(tags)) == [("tag.cycle", "s"), ("tag.cycle", "x"), ("tag.duplicate", "b"), ("tag.parent", "c")]


def test_proofs(spark):
    rules = spark.createDataFrame([("a", 1, "b"), ("a", 1, "c"), ("d", 1, "x"), ("d", 2, "a"), ("e", 1, "e")], "node string, proof int, needs string")
    assert rows(graph.proven(nodes(spark, "b", "c"), rules)) == [("a",), ("b",), ("c",), ("d",)]


def test_nearest_ancestor(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/x",), ("/ab",)], "path string")
    known = spark.createDataFrame([("/a",), ("/a/b",)], "path string")
    assert sorted(map(tuple, graph.nearest_ancestor(paths, known).collect()), key=str) == [("/a/b/c", "/a/b"), ("/ab", None), ("/x", None)]


# ---- schemas ---------------------------------------------------------------------------

CASES = [
    ({"type": "integer"}, ["1", "1.0", "-3"], ["1.5", '"1"', "null", "true"]),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "[]"]),
    ({"type": "object", "required": ["a"]}, ['{"a":null}'], ["{}", "[]"]),
    ({"required": ["a"]}, ["1", '{"a":1}'], ["{}"]),
    ({"minimum": 2, "exclusiveMaximum": 5}, ["2", "4.9", '"x"'], ["1.99", "5"]),
    ({"const": 9007199254740993}, ["9007199254740993"], ["9007199254740992"]),
    ({"enum": [1, "a", {"x": [1, 2]}]}, ["1.0", '"a"', '{"x":[1,2]}'], ["2", '{"x":[2,1]}']),
    ({"multipleOf": 0.1}, ["0.3", "7"], ["0.25"]),
    ({"minLength": 3}, ['"User A"', '"éé€"', "1"], ['"ab"', '"😀😀"']),
    ({"maxLength": 1}, ['"😀"'], ['"ab"']),
    ({"pattern": "b+"}, ['"abc"'], ['"ac"']),
    ({"items": {"type": "number"}, "minItems": 1}, ["[1,2]", "{}"], ["[]", '[1,"a"]']),
    ({"prefixItems": [{"type": "string"}], "items": False}, ['["a"]', "[]"], ["[1]", '["a",1]']),
    ({"contains": {"const": 1}, "maxContains": 2}, ["[1]", "[1,1,2]"], ["[]", "[1,1,1]"]),
    ({"uniqueItems": True}, ["[1,2]", '[{"a":1},{"a":2}]'], ["[1,1.0]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"properties": {"a": {"type": "string"}}}, ["{}", '{"a":"x"}', "3"], ['{"a":1}', '{"a":null}']),
    ({"properties": {"a": True}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": False}, ['{"a":1,"x1":2}'], ['{"x1":"a"}', '{"b":1}']),
    ({"propertyNames": {"pattern": "^a"}}, ['{"ab":1}'], ['{"b":1}']),
    ({"dependentRequired": {"a": ["b"]}}, ['{"b":1}', '{"a":1,"b":1}'], ['{"a":1}']),
    ({"dependentSchemas": {"a": {"minProperties": 2}}}, ['{"b":1}', '{"a":1,"b":1}'], ['{"a":1}']),
    ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, ["1", '"a"'], ["3"]),
    ({"anyOf": [{"const": 1}, {"const": 2}]}, ["2"], ["3"]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["1.5"], ["3"]),
    ({"not": {"type": "null"}}, ["1"], ["null"]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"const": 1}}, ['"ab"', "1"], ['"a"', "2"]),
    ({"$ref": "#/$defs/a", "$defs": {"a": {"type": "boolean"}}}, ["true"], ["1"]),
    ({"$ref": "#x", "$defs": {"a": {"$anchor": "x", "maxItems": 1}}}, ["[1]"], ["[1,2]"]),
    (False, [], ["1"]),
    (True, ["1", "null"], []),
]


@pytest.mark.parametrize(("rule", "good", "bad"), CASES, ids=lambda x: str(x)[:40])
def test_keywords_compiled_and_evaluated(spark, rule, good, bad):
    samples = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
    got = schema.valid(samples, "t", rule).collect()
    assert [(r.t, r.valid) for r in got if r.valid != r.want] == []
    import json

    evaluator = instance.Evaluator(instance.parse(json.dumps(rule)))
    assert [t for t in good if evaluator.errors(instance.parse(t))] == []
    assert [t for t in bad if not evaluator.errors(instance.parse(t))] == []


def test_violations_name_place_and_keyword(spark):
    df = spark.createDataFrame([(1, '{"k":5}'), (2, "{}"), (3, "{"), (4, None), (5, '{"k":"a"}')], "id int, t string")
    rule = {"required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}
    assert rows(schema.violations(df, "t", rule, ["id"])) == [(1, "/k", "minimum"), (2, "", "required"), (3, "", "json"), (5, "/k", "type")]


def test_recursion_goes_to_the_evaluator(spark):
    tree = {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#"}}}}
    with pytest.raises(schema.Uncompilable):
        schema.compiled(tree, F.col("x"))
    df = spark.createDataFrame([('{"kids":[{"kids":[]}]}',), ('{"kids":[{"kids":[1]}]}',), ("{} {}",), (None,), ("1" * 5000,)], "t string")
    import json

    out = [r.errors for r in instance.validated(df, "t", json.dumps(tree)).collect()]
    assert out[0] == [] and [tuple(e) for e in out[1]] == [("/kids/0/kids/0", "type")]
    assert out[2][0].keyword == "contract.json" and out[3] is None and out[4][0].keyword == "contract.budget"


def test_unevaluated_and_dynamic():
    rule = {"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}
    e = instance.Evaluator(rule)
    assert not e.errors(instance.parse('{"a":1}')) and e.errors(instance.parse('{"b":1}'))
    e = instance.Evaluator({"prefixItems": [True], "unevaluatedItems": False})
    assert not e.errors(instance.parse("[1]")) and e.errors(instance.parse("[1,2]"))
    tree = {"$id": "urn:tree", "$dynamicAnchor": "node", "properties": {"kids": {"items": {"$dynamicRef": "#node"}}}}
    strict = {"$id": "urn:strict", "$dynamicAnchor": "node", "$ref": "urn:tree", "unevaluatedProperties": False}
    e = instance.Evaluator(strict, documents={"urn:tree": tree})
    assert not e.errors(instance.parse('{"kids":[{"kids":[]}]}'))
    assert e.errors(instance.parse('{"kids":[{"odd":1}]}'))
    with pytest.raises(ValueError, match="external.denied"):
        instance.Evaluator({"$ref": "http://h/x"}).errors(None)


def test_projected_types(spark):
    df = spark.createDataFrame([], "a bigint not null, b array<int>, c map<bigint,string>, d struct<x:timestamp>, e decimal(20,0), f binary")
    got = {r["name"]: r["schema"] for r in projection.projected_schema(spark, df).collect()}
    assert got["a"] == '{"format": "int64", "type": "integer"}'
    assert '"pattern": "^-?[0-9]+$"' in got["c"] and '"uint64"' in got["e"] and '"base64"' in got["f"]


def test_document_projections(spark):
    ops = spark.createDataFrame([("/a", "GET", "x"), ("/a", "COPY", "y"), ("/b", "PUT", "z")], "path string, method string, op string")
    out = {r.path: r for r in projection.method_pivot(ops, "path", "method", F.col("op")).collect()}
    assert out["/a"].GET == "x" and out["/a"].additional == {"COPY": "y"} and out["/b"].additional is None
    params = spark.createDataFrame([(1, {"a": "s", "b": "t"}, ["a"])], "k int, properties map<string,string>, required array<string>")
    assert rows(projection.expanded_parameters(params, ["k"])) == [(1, "a", "s", True), (1, "b", "t", False)]
    routes = spark.createDataFrame([("/a/{b}/{c}",)], "path string")
    assert [r.name for r in projection.derived_parameters(routes).collect()] == ["b", "c"]
    assert "content" not in projection.head_projection(routes.withColumn("content", F.lit(1))).columns
