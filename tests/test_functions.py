import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.functions import grammar, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "negative", "zero", "integer"),
    [
        ("0", False, True, True),
        ("-0.0", True, True, True),
        ("-1", True, False, True),
        ("1.0", False, False, True),
        ("1.50", False, False, False),
        ("15e-1", False, False, False),
        ("1.5e1", False, False, True),
        ("150e-1", False, False, True),
        ("1e999999999999", False, False, True),
        ("1e-999999999999", False, False, False),
        ("0e-999999999999", False, True, True),
        ("-12345678901234567890123456789012345678901234567890", True, False, True),
    ],
)
def test_number_traits(spark, value, negative, zero, integer):
    assert tuple(one(spark, text.number_traits, value)) == (negative, zero, integer)


@pytest.mark.parametrize("value", ["", "01", "1.", ".5", "+1", "1e", "NaN", "1\n"])
def test_number_traits_of_other_text(spark, value):
    assert one(spark, text.number_traits, value) is None


@pytest.mark.parametrize(
    ("column", "good", "bad"),
    [
        (text.http_token, ["GET", "a!#$%&'*+-.^_`|~"], ["", "a b", "é", "a/b", "a\n"]),
        (text.media_type, ["", "application/json", "a/b+c"], ["a", "a/*", "a/b/c", "/b"]),
        (text.status_key, ["default", "200", "5XX"], ["600", "2xx", "20", "", "200\n"]),
        (text.anchor_name, ["a", "_a.b-c"], ["", "1a", "a:b"]),
        (text.component_name, ["A.b-c_1"], ["", "a/b", "é"]),
        (text.pointer_valid, ["", "/a~0~1"], ["a", "/~", "/~2"]),
        (text.percent_valid, ["", "a%20b", "%aF"], ["%", "%2", "%zz", "a%2"]),
        (text.path_template_valid, ["/", "/a/{b}", "/a%20/{b}{c}"], ["a", "/{}", "/{a", "/a}", "/{a}/{a}", "/%2", "/a b"]),
    ],
)
def test_text_rules(spark, column, good, bad):
    rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert [r.v for r in rows.withColumn("got", column(F.col("v"))).collect() if r.got != r.want] == []


def test_pointers(spark):
    assert one(spark, text.pointer_escape, "a~/b") == "a~0~1b"
    assert one(spark, lambda c: text.pointer_unescape(text.pointer_escape(c)), "~1/~0") == "~1/~0"
    assert one(spark, text.pointer_parent, "/a/b") == "/a"
    assert one(spark, text.pointer_parent, "") is None
    assert one(spark, text.pointer_ancestors, "/a/b") == ["", "/a", "/a/b"]


def test_lines_and_records(spark):
    assert one(spark, text.split_lines, "a\r\nb\rc\n\nd") == ["a", "b", "c", "", "d"]
    assert one(spark, text.split_lines, "a\n") == ["a"]
    assert one(spark, text.split_lines, "") == []
    assert one(spark, text.split_records, "1\n2\r\n3\r4") == ["1", "2", "3\r4"]


def test_small_functions(spark):
    assert one(spark, text.path_parameters, "/a/{b}/{c}/{d") == ["b", "c"]
    assert one(spark, text.path_shape, "/a/{b}/c/{d}") == "/a/{}/c/{}"
    assert one(spark, text.retry_text, "0010") == "10"
    assert one(spark, text.retry_text, "000") == "0"
    assert one(spark, text.retry_text, "1a") is None
    assert one(spark, text.build_tags, "b,a,,b") == "a,b"
    assert one(spark, text.bodyless_status, "204") and not one(spark, text.bodyless_status, "default")


@pytest.mark.parametrize(
    ("raw", "repaired"),
    [(b"a\xffb", "a�b"), (b"\xe2\x82", "�"), (b"\xf0\x9f\x92z", "�z"), (b"\xc0\xaf", "��"), (b"\xed\xa0\x80", "���"), ("é€".encode(), "é€")],
)
def test_utf8_repair(spark, raw, repaired):
    assert one(spark, text.repaired_utf8, bytearray(raw), "binary") == repaired


def test_mailboxes():
    good = ["a@b", "a.b+c@example.org", '"a b"@x.y', "a@[127.0.0.1]", "a@[IPv6:::1]", "a@b."]
    bad = ["", "a", "@b", "a@", ".a@b", "a..b@c", 'a"b@c', "a@-b", "a@b..c", "é@b", "a@[1.2.3]", "a@[IPv6:fe80::1%x]", "x" * 65 + "@b"]
    assert [m for m in good if not grammar.mailbox(m)] == []
    assert [m for m in bad if grammar.mailbox(m)] == []


def test_uris():
    assert grammar.uri_reference("../a?b#c") and grammar.uri_reference("")
    assert not grammar.uri_reference("1:a") and not grammar.uri_reference("a b") and not grammar.uri_reference("%zz")
    assert grammar.non_relative_iri("urn:é") and grammar.non_relative_iri("urn:") and not grammar.non_relative_iri("a/b")
    assert grammar.non_relative_iri("urn:a?\ue000") and not grammar.non_relative_iri("urn:\ue000")
    assert grammar.resolve_uri("http://h/a/b", "../c") == "http://h/c"
    assert grammar.resolve_uri("http://h/a#x", "#y") == "http://h/a#y"
    assert grammar.resolve_uri("", "a") == "a"
    assert grammar.resource_uri("HTTP://Host/A#b") == "http://host/A"


def test_server_templates(spark):
    want = {
        None: ["https://{h}/a%20{b}", None, "{a}", "/é\ue000\U00010000", "x" * 20_000, "[::1]:{port}/~a"],
        "url": ["", "a?b", "%2", "a b", "a\x7f", "{a} {", "a\ufffe", "%zz{a}"],
        "template": ["{", "}", "{}", "{a}{a}", "{a{b}", "a{b", "{a}{a} ", "x}y z"],
    }
    rows = [(t, fault) for fault, texts in want.items() for t in texts]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select("t", "want", grammar.server_template(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got if r.got != r.want] == []


@given(st.decimals(allow_nan=False, allow_infinity=False, places=3), st.decimals(allow_nan=False, allow_infinity=False, places=3))
def test_numbers_compare_exactly(a, b):
    assert grammar.compare_numbers(f"{a:f}", f"{b:f}") == (a > b) - (a < b)


def test_number_limits():
    assert grammar.compare_numbers("9007199254740993", "9007199254740992") == 1
    assert grammar.compare_numbers("1e5000", "1") is None
    assert grammar.compare_numbers("x", "1") is None


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_json_size(t):
    raw = json.dumps(t, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        raw = raw.replace(c, f"\\u{ord(c):04x}")
    assert grammar.json_size(t) == len(raw.encode())


def test_flags():
    assert grammar.split_flags(" -a  'b c' \"d\" ") == ["-a", "b c", "d"]
    assert grammar.split_flags("'a") is None
