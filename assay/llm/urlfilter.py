"""URL rules by hashed expressions, with DataFrame functions only.

Each URL becomes host-suffix and path-prefix expressions, of the shapes that
the rules have. They meet the rules on the first four bytes of their SHA-256;
the full digest confirms a meeting, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that are joined on.
PREFIX = 8
#: Rules are broadcast up to so many; beyond, the join is salted over SALTS copies of them.
BROADCAST_RULES = 50_000
SALTS = 16
#: The verdict without a fitting rule.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with digests; null parts are dropped, of equal rules a block stays."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    kept = rules.select(host.alias("host"), "path", "verdict").dropna()
    kept = kept.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return kept.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("host_length"),
        F.size(F.split("host", "\\.")).alias("labels"),
        F.length("path").alias("path_length"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX).alias("prefix"),
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per input row.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host
    and all subdomains if the path starts with the rule's. The longest rule
    (host and path together, then the host) wins; without one, ``rule`` is null
    and the verdict is ``allow``. Null urls have empty host and path. Rows with
    the same id and url are judged once and given back as often as they came.
    Other columns are ignored.
    """
    rules = prepared(rules)
    # as many shapes as there are pairs of label counts and path lengths
    kinds = rules.groupBy("labels", "path_length").count().collect()
    shapes, n_rules = [(r["labels"], r["path_length"]) for r in kinds], sum(r["count"] for r in kinds)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # the first expression is the row itself; it counts rows and meets no rule
    none = F.struct(F.lit(True).alias("own"), F.lit(None).cast("string").alias("digest"))
    labels = F.size(F.split("host", "\\."))
    found = [
        F.when(
            (labels >= n) & (F.length("path") >= size),
            F.struct(
                F.lit(False).alias("own"),
                _digest(F.substring_index("host", ".", -n), F.substring("path", 1, size)).alias("digest"),
            ),
        )
        for n, size in sorted(shapes)
    ]
    spread = rows.select("*", F.explode(F.array_compact(F.array(none, *found))).alias("e")).select(
        "page_id", "host", "path", "e.own", "e.digest", F.substring("e.digest", 1, PREFIX).alias("prefix")
    )
    if n_rules <= BROADCAST_RULES:
        met = spread.join(F.broadcast(rules), "prefix", "left")
    else:
        salted = rules.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
        met = spread.join(salted, ["prefix", "salt"], "left")
    fits = F.col("rule_digest") == F.col("digest")
    best = F.max(
        F.when(fits, F.struct(F.length("rule").alias("size"), "host_length", "rule", F.col("rule_verdict").alias("verdict")))
    )
    own = F.sum(F.col("own").cast("long"))
    judged = met.groupBy("page_id", "host", "path").agg(own.alias("n"), best.alias("best"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
