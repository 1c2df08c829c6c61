"""Column expressions over pointers, tokens, paths, numbers and lines.

All are built-in expressions, so they stay inside generated code. Null in
gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The methods that a path item names directly.
FIXED_METHODS = ["GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE", "QUERY"]
#: The simple JSON types.
SIMPLE_TYPES = ["null", "boolean", "object", "array", "number", "string", "integer"]
TOKEN = r"[A-Za-z0-9!#$%&'*+.^_`|~-]+"
_NUMBER = r"^(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def pointer_escape(segment: Column) -> Column:
    """A JSON Pointer segment with ``~`` and ``/`` escaped."""
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_valid(pointer: Column) -> Column:
    """Empty or starting with ``/``, with no escapes but ``~0`` and ``~1``."""
    return ((pointer == "") | pointer.startswith("/")) & ~pointer.rlike("~([^01]|$)")


def pointer_parent(pointer: Column) -> Column:
    """The pointer without its last segment; null for the root."""
    return F.when(pointer != "", F.regexp_replace(pointer, "/[^/]*$", ""))


def pointer_ancestors(pointer: Column) -> Column:
    """All prefixes of a pointer that are pointers, the root first and itself last."""
    parts = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def http_token(value: Column) -> Column:
    return value.rlike(f"^{TOKEN}$") & ~value.contains("\n")


def media_type(value: Column) -> Column:
    """A media type without wildcard, or empty for no content type."""
    return (value == "") | (value.rlike(f"^{TOKEN}/{TOKEN}$") & ~value.contains("*") & ~value.contains("\n"))


def status_key(value: Column) -> Column:
    return value.rlike("^(default|[1-5](XX|[0-9]{2}))$") & ~value.contains("\n")


def fixed_method(method: Column) -> Column:
    return method.isin(FIXED_METHODS)


def bodyless_status(status: Column) -> Column:
    """Whether a response of this status has no body: 1xx, 204 and 304."""
    code = F.expr("int(null)") if status is None else status.try_cast("int")
    return F.coalesce(code.between(100, 199) | code.isin(204, 304), F.lit(False))


def anchor_name(value: Column) -> Column:
    return value.rlike("^[A-Za-z_][A-Za-z0-9_.-]*$") & ~value.contains("\n")


def component_name(value: Column) -> Column:
    return value.rlike("^[a-zA-Z0-9._-]+$") & ~value.contains("\n")


def simple_type(value: Column) -> Column:
    return value.isin(SIMPLE_TYPES)


def all_unique(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def percent_valid(value: Column) -> Column:
    """Whether every ``%`` starts an escape of two hexadecimal digits."""
    return ~F.regexp_replace(value, "%[0-9A-Fa-f]{2}", "").contains("%")


def path_parameters(path: Column) -> Column:
    """Names between braces, in order; an unclosed brace ends the scan."""
    return F.regexp_extract_all(path, F.lit(r"\{([^}]*)\}"), F.lit(1))


def path_template_valid(path: Column) -> Column:
    """A path of literals and non-empty, unrepeated names in braces, with valid escapes."""
    literal = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@/-]|%[0-9A-Fa-f]{2})"
    names = path_parameters(path)
    return path.rlike(rf"^/(?:{literal}|\{{[^{{}}]+\}})*$") & ~path.contains("\n") & all_unique(names)


def path_shape(path: Column) -> Column:
    """A path with the names in braces left out: equal shapes are one hierarchy."""
    return F.regexp_replace(path, r"\{[^{}]+\}", "{}")


def operation_id(method: Column, path: Column) -> Column:
    """``method_`` and the first 16 hexadecimal digits of SHA-256 of ``METHOD path``."""
    return F.concat(F.lower(method), F.lit("_"), F.substring(F.sha2(F.concat(method, F.lit(" "), path), 256), 1, 16))


def retry_text(value: Column) -> Column:
    """Digits without leading zeros (``0`` for zeros only); null for anything else."""
    return F.when(value.rlike("^[0-9]+$") & ~value.contains("\n"), F.regexp_replace(value, "^0+(?=.)", ""))


def repaired_utf8(raw: Column) -> Column:
    """Text of bytes, each maximal invalid part replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def build_tags(tags: Column) -> Column:
    """A comma list as a set: sorted, without repeats and empty names."""
    parts = F.filter(F.split(tags, ","), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ",")


def split_lines(text: Column) -> Column:
    """Lines ended by LF, CR or CRLF; text after the last end is a line, nothing is none."""
    lines = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def split_records(text: Column) -> Column:
    """Records ended by LF or CRLF; a bare CR stays in its record."""
    lines = F.split(text, "\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def number_traits(text: Column) -> Column:
    """``negative, zero, integer`` of decimal text, exponents not expanded; null if it is no number.

    The sign is the text's, so minus zero is negative and zero.
    """
    sign = F.regexp_extract(text, _NUMBER, 1)
    whole = F.regexp_extract(text, _NUMBER, 2)
    part = F.regexp_extract(text, _NUMBER, 3)
    exponent = F.regexp_extract(text, _NUMBER, 4)
    digits = F.concat(whole, part)
    zero = digits.rlike("^0+$")
    # places after the point that hold no trailing zero, against the exponent's shift
    tail = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    # an exponent of over nine digits moves the point past any text that fits a row
    long_exponent = F.length(F.regexp_replace(exponent, "^[+-]?0*", "")) > 9
    shift = F.when(exponent == "", 0).when(long_exponent, F.when(exponent.startswith("-"), -2_000_000_000).otherwise(2_000_000_000)).otherwise(exponent.try_cast("long"))
    integer = zero | (F.length(part) - tail - shift <= 0)
    return F.when(
        text.rlike(_NUMBER) & ~text.contains("\n"),
        F.struct((sign == "-").alias("negative"), zero.alias("zero"), integer.alias("integer")),
    )


def canonical(value: Column) -> Column:
    """JSON text of a struct, map or array, for equality."""
    return F.to_json(value)
