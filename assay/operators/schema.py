"""JSON Schema keywords compiled to Column predicates over VARIANT values.

A keyword that doesn't apply to a value's kind passes. Unknown never means
failed: every predicate is guarded by the kind it applies to. References are
resolved inside the schema and inlined; recursive schemas and keywords that
depend on annotations are left to ``assay.operators.instance``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that never assert.
ANNOTATIONS = {
    "$schema", "$id", "$anchor", "$defs", "$comment", "$vocabulary", "title", "description", "default", "examples", "deprecated",
    "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType", "contentSchema", "discriminator", "xml", "externalDocs",
    "definitions",
}
#: Keywords that need the whole evaluation of an instance.
DYNAMIC = {"unevaluatedItems", "unevaluatedProperties", "$dynamicRef", "$dynamicAnchor"}
#: Applied together with other keywords.
_HELPERS = {"then", "else", "minContains", "maxContains"}
_DECIMAL = "decimal(38,10)"


class Uncompilable(ValueError):
    """The schema needs the evaluator of ``assay.operators.instance``."""


def kind_of(v: Column) -> Column:
    """``object, array, string, number, boolean`` or ``null`` of a VARIANT."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


@dataclass(frozen=True)
class Check:
    """One keyword at one place of the schema, and whether a value passes it."""

    path: str
    keyword: str
    passes: Column


def _member(v: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", _DECIMAL)


def canonical(v: Column) -> Column:
    """JSON text for equality: keys sorted, numbers as decimals without trailing zeros."""
    number = F.regexp_replace(F.regexp_replace(_number(v).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(kind_of(v) == "number", F.coalesce(number, F.to_json(v))).otherwise(F.to_json(v))


def _literal(value) -> Column:
    return canonical(F.parse_json(F.lit(json.dumps(value, sort_keys=True, ensure_ascii=False))))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


class Compiler:
    def __init__(self, root):
        self.root = root

    def resolve(self, ref: str, trail: tuple[str, ...]):
        if ref in trail:
            raise Uncompilable(f"recursive reference {ref}")
        if ref == "#":
            return self.root
        if not ref.startswith("#/"):
            found = self._anchor(self.root, ref.removeprefix("#")) if ref.startswith("#") else None
            if found is None:
                raise ValueError(f"ref.missing: {ref}")
            return found
        node = self.root
        for part in ref[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                node = node[int(part)] if isinstance(node, list) else node[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise ValueError(f"ref.missing: {ref}") from None
        return node

    def _anchor(self, node, name: str):
        if isinstance(node, dict):
            if node.get("$anchor") == name:
                return node
            node = [v for k, v in node.items() if k not in ("examples", "enum", "const", "default")]
        if isinstance(node, list):
            for x in node:
                found = self._anchor(x, name)
                if found is not None:
                    return found
        return None

    def passes(self, schema, v: Column, trail: tuple[str, ...] = ()) -> Column:
        return _all([c.passes for c in self.checks(schema, v, "", trail)])

    def checks(self, schema, v: Column, path: str = "", trail: tuple[str, ...] = ()) -> list[Check]:
        """The checks of a schema on a non-null VARIANT column."""
        if isinstance(schema, bool):
            return [] if schema else [Check(path, "false", F.lit(False))]
        out: list[Check] = []
        kind = kind_of(v)

        def add(keyword: str, applies: Column | None, test: Column) -> None:
            ok = F.coalesce(test, F.lit(False))
            out.append(Check(path, keyword, ok if applies is None else ~applies | ok))

        # F.forall and its like pass a place to a lambda of two arguments, so these take one
        def fits(sub):
            return lambda x: self.passes(sub, x, trail)

        def member(pattern: str, sub):
            return lambda e: ~e["key"].rlike(pattern) | self.passes(sub, e["value"], trail)

        def other_member(names: list[str], patterns: list[str], sub):
            def test(e: Column) -> Column:
                known = e["key"].isin(names) if names else F.lit(False)
                for p in patterns:
                    known = known | e["key"].rlike(p)
                return known | self.passes(sub, e["value"], trail)

            return test

        def named(sub):
            return lambda k: self._name(sub, k)

        number, string, array, obj = (kind == k for k in ("number", "string", "array", "object"))
        for key, value in sorted(schema.items()):
            if key in DYNAMIC:
                raise Uncompilable(key)
            if key in ANNOTATIONS or key in _HELPERS or key.startswith("x-"):
                continue
            if key == "$ref":
                out += self.checks(self.resolve(value, trail), v, path, (*trail, value))
            elif key == "type":
                names = [value] if isinstance(value, str) else value
                whole = number & (_number(v) == F.floor(_number(v)).cast(_DECIMAL))
                tests = [whole if n == "integer" else kind == n for n in names]
                add(key, None, F.coalesce(F.greatest(*tests, F.lit(False)), F.lit(False)))
            elif key in ("enum", "const"):
                values = value if key == "enum" else [value]
                add(key, None, canonical(v).isin([]) if not values else F.array_contains(F.array(*map(_literal, values)), canonical(v)))
            elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                bound = F.lit(str(value)).cast(_DECIMAL)
                test = {
                    "minimum": _number(v) >= bound,
                    "maximum": _number(v) <= bound,
                    "exclusiveMinimum": _number(v) > bound,
                    "exclusiveMaximum": _number(v) < bound,
                }[key]
                add(key, number, test)
            elif key == "multipleOf":
                add(key, number, F.pmod(_number(v), F.lit(str(value)).cast(_DECIMAL)) == 0)
            elif key in ("minLength", "maxLength"):
                size = F.char_length(F.try_variant_get(v, "$", "string"))
                add(key, string, size >= value if key == "minLength" else size <= value)
            elif key == "pattern":
                add(key, string, F.try_variant_get(v, "$", "string").rlike(value))
            elif key in ("minItems", "maxItems"):
                add(key, array, F.size(_items(v)) >= value if key == "minItems" else F.size(_items(v)) <= value)
            elif key == "uniqueItems":
                if value:
                    texts = F.transform(_items(v), canonical)
                    add(key, array, F.size(texts) == F.size(F.array_distinct(texts)))
            elif key == "prefixItems":
                for i, sub in enumerate(value):
                    item = F.try_variant_get(v, f"$[{i}]", "variant")
                    add(key, array & item.isNotNull(), self.passes(sub, item, trail))
            elif key == "items":
                skip = len(schema.get("prefixItems", ()))
                rest = F.slice(_items(v), skip + 1, F.greatest(F.size(_items(v)) - skip, F.lit(0)))
                add(key, array, F.forall(rest, fits(value)))
            elif key == "contains":
                n = F.size(F.filter(_items(v), fits(value)))
                test = n >= schema.get("minContains", 1)
                if "maxContains" in schema:
                    test = test & (n <= schema["maxContains"])
                add(key, array, test)
            elif key == "required":
                add(key, obj, F.size(F.array_except(F.array(*map(F.lit, value)), _keys(v))) == 0 if value else F.lit(True))
            elif key in ("minProperties", "maxProperties"):
                add(key, obj, F.size(_keys(v)) >= value if key == "minProperties" else F.size(_keys(v)) <= value)
            elif key == "dependentRequired":
                for name, needs in sorted(value.items()):
                    absent = ~F.array_contains(_keys(v), name)
                    add(key, obj, absent | (F.size(F.array_except(F.array(*map(F.lit, needs)), _keys(v))) == 0) if needs else F.lit(True))
            elif key == "dependentSchemas":
                for name, sub in sorted(value.items()):
                    add(key, obj, ~F.array_contains(_keys(v), name) | self.passes(sub, v, trail))
            elif key == "properties":
                for name, sub in sorted(value.items()):
                    member = _member(v, name)
                    there = obj & F.array_contains(_keys(v), name)
                    below = f"{path}/{name}"
                    # a JSON null member is a VARIANT null, which SQL does not see as null
                    inner = self.checks(sub, member, below, trail)
                    out += [Check(c.path, c.keyword, ~F.coalesce(there, F.lit(False)) | c.passes) for c in inner]
            elif key == "patternProperties":
                members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
                for pattern, sub in sorted(value.items()):
                    test = F.forall(members, member(pattern, sub))
                    add(key, obj, test)
            elif key == "additionalProperties":
                members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
                names = list(schema.get("properties", {}))
                patterns = list(schema.get("patternProperties", {}))

                add(key, obj, F.forall(members, other_member(names, patterns, value)))
            elif key == "propertyNames":
                test = F.forall(_keys(v), named(value))
                add(key, obj, test)
            elif key in ("allOf", "anyOf", "oneOf"):
                tests = [self.passes(sub, v, trail) for sub in value]
                n = sum((t.cast("int") for t in tests), F.lit(0))
                add(key, None, n == len(tests) if key == "allOf" else n >= 1 if key == "anyOf" else n == 1)
            elif key == "not":
                add(key, None, ~self.passes(value, v, trail))
            elif key == "if":
                test = self.passes(value, v, trail)
                then = self.passes(schema.get("then", True), v, trail)
                other = self.passes(schema.get("else", True), v, trail)
                add(key, None, F.when(test, then).otherwise(other))
            else:
                raise ValueError(f"schema.keyword: {key}")
        return out

    def _name(self, schema, name: Column) -> Column:
        """A schema on a property name, which is a string."""
        if isinstance(schema, bool):
            return F.lit(schema)
        tests = []
        for key, value in schema.items():
            if key == "pattern":
                tests.append(name.rlike(value))
            elif key == "minLength":
                tests.append(F.char_length(name) >= value)
            elif key == "maxLength":
                tests.append(F.char_length(name) <= value)
            elif key == "enum":
                tests.append(name.isin([x for x in value if isinstance(x, str)]))
            elif key == "const":
                tests.append(name == value if isinstance(value, str) else F.lit(False))
            elif key == "type":
                tests.append(F.lit("string" in ([value] if isinstance(value, str) else value)))
            elif key not in ANNOTATIONS:
                raise Uncompilable(f"propertyNames with {key}")
        return _all(tests)


def compiled(schema, v: Column) -> list[Check]:
    """The checks of a whole schema; ``Uncompilable`` if it needs the evaluator."""
    return Compiler(schema).checks(schema, v)


def violations(df: DataFrame, json_col: str, schema, keep: list[str]) -> DataFrame:
    """``keep, path, keyword``: one row per failed check of each JSON text.

    Text that is no JSON gives the keyword ``json``. Null is no sample and
    gives nothing. All checks are expressions of one projection.
    """
    parsed = df.where(F.col(json_col).isNotNull()).select(*keep, F.try_parse_json(json_col).alias("sample"))
    checks = compiled(schema, F.col("sample"))
    failed = [
        F.when(F.col("sample").isNotNull() & ~c.passes, F.struct(F.lit(c.path).alias("path"), F.lit(c.keyword).alias("keyword")))
        for c in checks
    ]
    broken = F.when(F.col("sample").isNull(), F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword")))
    found = parsed.select(*keep, F.explode(F.array_compact(F.array(broken, *failed))).alias("f"))
    return found.select(*keep, "f.path", "f.keyword")


def valid(df: DataFrame, json_col: str, schema, name: str = "valid") -> DataFrame:
    """``df`` with whether each JSON text fits the schema; null text gives null."""
    parsed = F.try_parse_json(json_col)
    ok = _all([c.passes for c in compiled(schema, F.col("__sample"))])
    out = df.withColumn("__sample", parsed)
    test = F.when(F.col(json_col).isNotNull(), F.when(F.col("__sample").isNull(), False).otherwise(ok))
    return out.withColumn(name, test).drop("__sample")
