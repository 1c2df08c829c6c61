import pytest

from assay.sources import directives


def test_values_and_prose():
    got = directives.parse('// Makes a pet.\n// More words.\n/* @doc required minLength=3 enum=["a b", {"c": 1}] */\n// @doc response status="404" description="x"', "@doc")
    assert (got.summary, got.description) == ("Makes a pet.", "More words.")
    assert got.values == [
        (3, "", "required", "true"), (3, "", "minLength", "3"), (3, "", "enum", '["a b", {"c": 1}]'),
        (4, "response", "status", '"404"'), (4, "response", "description", '"x"'),
    ]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("@doc", "comment.syntax"),
        ("@docs required", "comment.syntax"),
        ("@doc =1", "comment.syntax"),
        ("@doc minimum=1,maximum=2", "comment.syntax"),
        ("@doc odd", "comment.unknown"),
        ("@doc minimum=", "comment.json"),
        ("@doc minimum=NaN", "comment.json"),
        ("@doc minimum=1 minimum=1", "comment.conflict"),
        ("@doc minimum=1\n@doc minimum=2", "comment.conflict"),
        ("x" * 65_537, "comment.budget"),
    ],
)
def test_faults(text, code):
    with pytest.raises(directives.Problem) as found:
        directives.parse(text, "@doc")
    assert found.value.code == code


def test_same_value_twice_and_kinds_may_differ():
    assert len(directives.parse("@doc minimum=1\n@doc minimum=1\n@doc request status=1\n@doc response status=2", "@doc").values) == 4


def test_rows(spark):
    df = spark.createDataFrame([("a", "@doc required"), ("b", "@doc odd"), ("c", "prose"), ("d", None)], "id string, text string")
    got = sorted((r.id, r.name, r.code) for r in directives.directives(df, "@doc").collect())
    assert got == [("a", "required", None), ("b", None, "comment.unknown")]
