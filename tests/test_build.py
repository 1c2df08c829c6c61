from assay.plans import build

VARIANT = (
    "operation_key string, variant string, methods array<string>, except_methods array<string>, media_types array<string>, "
    "except_media_types array<string>, status string, schema string, description string, reads_body boolean"
)
ROUTE = "route string, method string, path string, operation_key string, media array<string>"


def test_routes_link_and_issues_name_the_rest(spark):
    variants = spark.createDataFrame(
        [
            ("pet", "a", ["GET", "HEAD"], [], [], [], "200", "string", "read", False),
            ("pet", "b", ["POST"], [], ["application/json"], [], "201", "integer", "make", True),
            ("pet", "c", ["POST"], [], ["text/plain"], [], "201", "string", "make", True),
            ("bad", "a", ["GET"], ["GET"], [], [], "200", "string", None, False),
            ("unused", "a", ["a b"], [], [], [], "200", "string", None, False),
        ],
        VARIANT,
    )
    templates = variants.select("operation_key").distinct()
    routes = spark.createDataFrame(
        [
            ("r1", "GET", "/pets/{id}", "pet", []),
            ("r2", "POST", "/pets", "pet", ["application/json", "text/plain"]),
            ("r3", "POST", "/other", "pet", []),
            ("r4", "POST", "/third", "pet", ["application/xml"]),
            ("r5", "GET", "/lost", "none", []),
            ("r6", "GET", "/pets/{id}", "pet", []),
            ("r7", "GET", "/bad", "bad", []),
            ("r8", "HEAD", "/head", "pet", []),
            ("r9", "a b", "/token", "pet", []),
        ],
        ROUTE,
    )
    linked, issues = build.build(routes, templates, variants)
    found = sorted((r.route, r.code) for r in issues.collect())
    assert found == [
        ("r3", "condition.media"), ("r4", "condition.uncovered"), ("r5", "route.unresolved"), ("r6", "route.duplicate"),
        ("r7", "condition.empty"), ("r7", "condition.uncovered"), ("r9", "condition.uncovered"), ("r9", "method.invalid"),
    ]
    got = {r.route: r for r in linked.collect()}
    assert sorted(got) == ["r1", "r2", "r8"]
    assert got["r1"].responses == {"200": "string"} and got["r1"].parameters == ["id"]
    assert got["r2"].responses == {"201": "anyOf(integer,string)"} and got["r2"].description == "make" and got["r2"].body_required
    assert got["r8"].responses == {"200": None} and not got["r8"].body_required
    assert got["r1"].operation_id.startswith("get_") and len(got["r1"].operation_id) == 20
