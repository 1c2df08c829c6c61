from collections import defaultdict

from assay import queries

SF = "/root/testdata/sf0.001"


def test_alternatives_of_all_documents(spark):
    want = defaultdict(dict)
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect(), key=lambda r: r.doc_id):
        want[r.source].setdefault(r.lang)
    got = {r.g: (r.n, r.folded) for r in queries.schema_alternatives(spark, SF).collect()}
    assert got == {g: (len(v), next(iter(v)) if len(v) == 1 else f"anyOf({','.join(v)})") for g, v in want.items()}


def test_closure_goes_on_to_its_end(spark):
    ahead, seen = defaultdict(set), {}
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    for r in items:
        ahead[r.l_orderkey * 2].add(r.l_partkey * 2 + 1)
        ahead[r.l_partkey * 2 + 1].add(r.l_orderkey * 2)
    now, depth = {min(r.l_orderkey for r in items) * 2}, 0
    while now:
        seen |= dict.fromkeys(now, depth)
        now, depth = {y for x in now for y in ahead[x]} - seen.keys(), depth + 1
    assert max(seen.values()) > 2
    assert {r.node: r.depth for r in queries.reachable_closure(spark, SF).collect()} == seen
    assert {r.node for r in queries.reachable_components(spark, SF).collect()} == seen.keys()


def test_all_roots_have_their_inheriting_nodes(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect():
        node, inherits = r.p_partkey, False
        while node > 1:
            inherits, node = inherits or node % 3 == 0, node // 2
            if inherits:
                want.add((node, r.p_partkey))
    got = [tuple(r) for r in queries.inheriting_nodes(spark, SF).select("root", "node").collect()]
    assert len({root for root, _ in want}) > 5 and sorted(got) == sorted(want)
