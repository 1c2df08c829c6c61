import json
import time

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.plans import document
from assay.sources import files, nodes, streams
from assay.streaming import ndjson


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- records and events ----------------------------------------------------------


def records(spark, text, **limits):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return [(r.item, r.record, r.code) for r in streams.records(df, "t", ["k"], **limits).orderBy("item").collect()]


def test_records(spark):
    assert records(spark, "1\n2\r\n3") == [(1, "1", None), (2, "2", None), (3, "3", None)]
    assert records(spark, "1\n\n \t\n2\n") == [(1, "1", None), (2, "2", None)]
    assert records(spark, "1\r2") == [(1, "1\r2", "contract.ndjson")]
    assert records(spark, "\r\r\n") == [(1, "\r", "contract.ndjson")]
    assert records(spark, "1\n2", max_items=1) == [(1, "1", None), (2, "2", "contract.budget")]
    assert records(spark, "1\n2", max_items=2)[1][2] is None
    assert records(spark, None) == [] and records(spark, "") == []


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_line_budgets(spark, end):
    df = spark.createDataFrame([(1, f"abc{end}de{end}")], "k int, t string")
    size = 5 + 2 * len(end)

    def code(**limits):
        return streams.line_budget(df, "t", ["k"], **limits).first().code

    assert code(max_bytes=size) is None and code(max_bytes=size - 1) == "contract.budget"
    assert code(max_line=3) is None and code(max_line=2) == "contract.budget"


SSE = [
    (
        "﻿: note\r\nevent: update\r\nid: 42\r\nretry: 0010\r\ndata: first\r\ndata:second\r\n\r\ndata: x\n\ndata: unfinished",
        [("first\nsecond", "update", "42", "10"), ("x", None, None, None)],
    ),
    ("event: a\n\ndata\n\n", [("", None, None, None)]),
    ("data: 1\rid: a\0b\rretry: 1x\revent: p\revent: q\r\r", [("1", "q", None, None)]),
    ("data:  two\nother: x\n:c\n\n\n\n", [(" two", None, None, None)]),
    ("x\n﻿data: 1\n\n", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), SSE)
def test_events(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = streams.events(df, "t", ["k"]).orderBy("event_no").collect()
    assert [(r.data, r.event, r.id, r.retry) for r in got] == want
    assert [r.event_no for r in got] == list(range(1, len(want) + 1))


def test_event_limit(spark):
    df = spark.createDataFrame([(1, "data: 1\n\ndata: 2\n\n")], "k int, t string")
    assert [r.over for r in streams.events(df, "t", ["k"], max_items=1).orderBy("event_no").collect()] == [False, True]


@given(st.lists(st.sampled_from(["data: a", "\n", "\r", "\r\n", "id: 1", ": c", "event: e", "\n\n"]), max_size=20))
def test_chunks_of_any_size_frame_alike(parts):
    text = "".join(parts)
    whole, left = ndjson._frames(text)
    out, rest = [], ""
    for c in text:
        found, rest = ndjson._frames(rest + c)
        out += found
    assert out == whole and rest == left


# ---- streaming --------------------------------------------------------------------


def finished(stream, spark, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_streamed_records_are_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_bytes(b'{"k":1}\r\n\n{"k":"x"}\n{"k":2}\r{}\n')
    stream = ndjson.invalid_records(ndjson.read_records(spark, str(tmp_path / "in")), {"properties": {"k": {"type": "integer"}}})
    got = finished(stream, spark, "bad_records", tmp_path).select("path", "keyword")
    assert rows(got) == [("", "contract.ndjson"), ("/k", "type")]


def test_streamed_chunks_make_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "﻿data: one\r\n\r\ndata: two\n\ndata: three"
    for i, c in enumerate(text[k : k + 5] for k in range(0, len(text), 5)):
        pd.DataFrame({"stream": ["s"], "seq": [i], "chunk": [c]}).to_json(tmp_path / f"in/{i:03}.json", orient="records", lines=True)
        time.sleep(0.02)
    chunks = spark.readStream.schema("stream string, seq long, chunk string").option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    got = finished(ndjson.framed_events(chunks), spark, "framed", tmp_path)
    assert rows(got.select("event_no", "data")) == [(1, "one"), (2, "two")]


# ---- files --------------------------------------------------------------------------


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text("{}")
    (tmp_path / "docs/b.json").write_text("[1, 2, 3]")
    got = {r.path.rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path / "docs"), max_bytes=2).collect()}
    assert got["a.json"].content == b"{}" and got["b.json"].content is None and got["b.json"].code == "input.budget"
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps([{"uri": "urn:a", "file": "a.json"}, {"uri": "urn:b", "file": "b.json", "kind": "example"}, {"uri": "urn:c", "file": "c.json"}, {"file": "a.json"}]))
    listed = files.read_manifest(spark, str(manifest))
    every = files.read_files(spark, str(tmp_path / "docs"))
    codes = {r.uri: r.code for r in files.resources(listed, every).collect()}
    assert codes == {"urn:a": None, "urn:b": None, "urn:c": "input.file", None: "cli.resources"}
    codes = {r.uri: r.code for r in files.resources(listed, every, max_bytes=4).collect()}
    assert codes["urn:b"] == "cli.budget"


def test_bundles_and_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1,"z":2}'), (3, '{"a":1} {}'), (4, "{"), (5, '{"a":1}  x')], "k int, t string")
    codes = {r.k: r.code for r in files.bundles(df, "t", ["k"], ["a"]).collect()}
    assert codes[1] is None and codes[2] == codes[4] == "bundle.invalid" and codes[5] is not None
    text = df.select(F.col("t").alias("value"))
    files.write_text(text, str(tmp_path / "out"))
    with pytest.raises(Exception, match="EXIST|exist"):
        files.write_text(text, str(tmp_path / "out"))
    files.write_text(text, str(tmp_path / "out"), owned=True)


# ---- documents -----------------------------------------------------------------------


def test_node_rows():
    got = nodes.rows_of("d", '{"a":[1.50,{"b/c":"x"}],"t":true,"n":null}', role=None)
    assert [(r[1], r[6], r[7], r[8], r[9]) for r in got] == [
        ("", "object", None, None, None), ("/a", "array", None, None, None), ("/a/0", "number", None, "1.50", None),
        ("/a/1", "object", None, None, None), ("/a/1/b~1c", "string", "x", None, None), ("/t", "boolean", None, None, True), ("/n", "null", None, None, None),
    ]
    for bad in ('{"a":1,"a":2}', "{} {}", "", "NaN", None, "[" * 200 + "]" * 200):
        assert [r[6] for r in nodes.rows_of("d", bad)] == ["fatal"]
    big = "1" * 60
    assert nodes.rows_of("d", big)[0][8] == big


BASE = {"openapi": "3.2.0", "info": {"title": "t", "version": "1"}, "paths": {}}


def described(**more):
    return {**BASE, **more}


def operation(**more):
    return {"responses": {"200": {"description": "ok"}}, **more}


ISSUES = [
    (described(), []),
    ({"openapi": "3.1.0", "info": {"title": "t", "version": "1"}, "paths": {}}, ["spec.version"]),
    ({"openapi": "3.2.0", "paths": {}}, ["spec.info"]),
    ({"openapi": "3.2.0", "info": {"title": "t", "version": "1"}}, ["spec.root.required"]),
    (described(odd=1), ["spec.root.field"]),
    (described(**{"x-odd": 1}), []),
    (described(info={"version": "1"}), ["spec.info.required"]),
    (described(info={"title": 1, "version": "1"}), ["spec.info.string"]),
    (described(info={**BASE["info"], "license": {"name": "n", "url": "u", "identifier": "i"}}), ["spec.license.conflict"]),
    (described(info={**BASE["info"], "contact": {"email": "a b"}}), ["spec.contact.email"]),
    (described(info={**BASE["info"], "termsOfService": "%zz"}), ["spec.info.uri"]),
    (described(paths={"a": {}}), ["spec.path"]),
    (described(paths={"/{a}": {}, "/{b}": {}}), ["spec.paths.identical"]),
    (described(paths={"/{a}": {"get": operation()}}), ["spec.parameter.path.missing"]),
    (described(paths={"/a": {"get": operation(parameters=[{"name": "x", "in": "path", "required": True, "schema": {}}])}}), ["spec.parameter.path.unused"]),
    (described(paths={"/{x}": {"parameters": [{"name": "x", "in": "path", "required": True, "schema": {}}], "get": operation()}}), []),
    (described(paths={"/a": {"get": operation(parameters=[{"name": "x", "in": "query", "schema": {}}] * 2)}}), ["spec.parameter.duplicate"]),
    (described(paths={"/a": {"get": operation(parameters=[{"name": "x", "in": "query", "schema": {}, "style": "matrix"}])}}), ["spec.parameter.style"]),
    (described(paths={"/a": {"get": operation(parameters=[{"name": "x", "in": "query"}])}}), ["spec.parameter.content"]),
    (described(paths={"/a": {"get": {"responses": {"299x": {}}}}}), ["spec.response.missing", "spec.response.status"]),
    (described(paths={"/a": {"get": operation(operationId="i"), "put": operation(operationId="i")}}), ["spec.operationId.duplicate"]),
    (described(paths={"/a": {"post": operation(requestBody={"content": {}})}}), ["spec.request.content"]),
    (described(paths={"/a": {"additionalOperations": {"GET": operation(), "a b": operation()}}}), ["spec.method.duplicate", "spec.method.token"]),
    (described(components={"schemas": {"a b": {}}}), ["spec.components.name"]),
    (described(components={"schemas": {"A": {"type": "text"}}}), ["spec.schema.keyword"]),
    (described(components={"schemas": {"A": {"nullable": True}}}), ["spec.schema.nullable"]),
    (described(components={"schemas": {"A": {"minLength": -1, "multipleOf": 0}}}), ["spec.schema.keyword"] * 2),
    (described(components={"schemas": {"A": {"allOf": []}}}), ["spec.schema.keyword"]),
    (described(components={"schemas": {"A": {"$ref": "#/components/schemas/B"}}}), ["spec.ref.missing"]),
    (described(components={"schemas": {"A": {"$ref": "#here", "$defs": {"x": {"$anchor": "here"}}}}}), []),
    (described(components={"schemas": {"A": {"$ref": "http://h/x"}}}), ["spec.external.denied"]),
    (described(components={"schemas": {"A": {"$ref": "#/info"}}}), ["spec.ref.type"]),
    (described(components={"parameters": {"p": {"$ref": "#/components/parameters/q", "name": "x"}, "q": {"name": "q", "in": "query", "schema": {}}}}), ["spec.ref.sibling"]),
    (described(components={"securitySchemes": {"s": {"type": "http"}}}), ["spec.security.http"]),
    (described(components={"securitySchemes": {"s": {"type": "apiKey", "name": "n", "in": "query", "scheme": "x"}}}), ["spec.security.field"]),
    (described(components={"securitySchemes": {"s": {"type": "openIdConnect", "openIdConnectUrl": "http://h"}}}), ["spec.security.url"]),
    (described(components={"examples": {"e": {"value": 1, "externalValue": "u"}}}), ["spec.example.conflict"]),
    (described(servers=[{"url": "http://{h}/{h}"}]), ["spec.server.template"]),
    (described(servers=[{"url": "a", "variables": {"v": {"enum": []}}}]), ["spec.serverVariable.default", "spec.serverVariable.enum"]),
    (described(servers={}), ["spec.server.array"]),
    (described(tags=[{"name": "a", "parent": "b"}, {"name": "b", "parent": "a"}, {"name": "c", "parent": "z"}]), ["spec.tag.cycle", "spec.tag.parent"]),
    (described(externalDocs={"url": "a b"}), ["spec.externalDocs.url"]),
    (described(paths={"/a": {"get": operation(tags=["x", 1])}}), ["spec.operation.tags"]),
    (described(security=[{"s": ["a", 1]}, 1]), ["spec.security.requirements", "spec.security.scopes"]),
    (described(components={"schemas": {"A": {"required": ["a", "a"]}, "B": {"type": ["string", "string"]}, "C": {"type": ["string", "null"], "required": []}}}), ["spec.schema.keyword"] * 2),
    (described(servers=[{"url": "/", "variables": {"v": {"default": "a", "enum": ["b"]}}}]), ["spec.serverVariable.default"]),
    (described(components={"securitySchemes": {"s": {"type": "oauth2", "flows": {"implicit": {"authorizationUrl": "http://h", "scopes": {}, "tokenUrl": "u"}, "odd": {}, "deviceAuthorization": {"tokenUrl": "/t"}}}}}), ["spec.security.device", "spec.security.field", "spec.security.flow", "spec.security.scopes", "spec.security.url"]),
    (described(components={"schemas": {"A": {"discriminator": {"propertyName": "p"}, "required": ["p"]}}}), ["spec.discriminator.context"]),
    (described(components={"schemas": {"A": {"discriminator": {"propertyName": "p"}, "oneOf": [{"required": ["p"]}, {"$ref": "#/components/schemas/B"}]}, "B": {"required": ["p"]}}}), []),
    (described(components={"schemas": {"A": {"discriminator": {"propertyName": "p"}, "oneOf": [{"required": ["p"]}, {}]}}}), ["spec.discriminator.default.required"]),
    (described(components={"schemas": {"Pet": {"discriminator": {"propertyName": "p", "mapping": {"c": "Cat", "d": "Dog"}}, "required": ["p"]}, "Cat": {"allOf": [{"$ref": "#/components/schemas/Pet"}]}, "Dog": {}}}), ["spec.discriminator.target"]),
    (described(components={"schemas": {"U": {"discriminator": {"propertyName": "p", "mapping": {"a": "#/components/schemas/Alias"}, "defaultMapping": "Cat"}, "anyOf": [{"$ref": "#/components/schemas/Cat"}, {}]}, "Cat": {"required": ["p"]}, "Alias": {"$ref": "#/components/schemas/Cat"}}}), ["spec.discriminator.default.optional"]),
    (described(components={"mediaTypes": {"m": {"schema": {"$ref": "#/components/schemas/A"}, "itemEncoding": {}}, "n": {"schema": {"type": "object", "items": {}}, "itemEncoding": {}}}, "schemas": {"A": {"anyOf": [{"type": "string"}, {"type": ["array", "null"]}]}}}), ["spec.encoding.array"]),
    (described(components={"schemas": {"A": {"type": "array", "xml": {"wrapped": True}}, "B": {"xml": {"wrapped": True}}}}), ["spec.xml.wrapped"]),
    (described(paths=[]), ["spec.object"]),
    ('{"openapi":"3.2.0","openapi":"3.2.0"}', ["spec.json"]),
]


def test_document_issues(spark):
    made = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, (d, _) in enumerate(ISSUES)]
    found: dict = {}
    for r in document.check(spark.createDataFrame(made, "doc string, content string")).collect():
        found.setdefault(r.doc, []).append(r.code)
    wrong = {i: (found.get(str(i), []), want) for i, (_, want) in enumerate(ISSUES) if sorted(found.get(str(i), [])) != sorted(want)}
    assert wrong == {}


def test_unused_components(spark):
    doc = described(
        paths={"/a": {"get": {"responses": {"200": {"content": {"a/b": {"schema": {"$ref": "#/components/schemas/A"}}}}}}}},
        components={"schemas": {"A": {"items": {"$ref": "#/components/schemas/B"}}, "B": {"not": {"$ref": "#/components/schemas/A"}}, "C": {"not": {"$ref": "#/components/schemas/C"}}}},
    )
    table = nodes.parsed(spark.createDataFrame([("d", json.dumps(doc))], "doc string, content string"), roles=True)
    objects = nodes.objects_of(table)
    assert rows(document.unused_components(objects, document.references(objects, table))) == [("d", "C")]
