"""Fixed points over edges: reachability, chains, hierarchies and proofs.

Each loop advances all keys at once by joins. Edges are written once, before
the first round; each round's new rows are cut at a checkpoint, in the folder
that the session names, so plans stay short and a lost executor costs little.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.text import pointer_ancestors


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session without one (a test) gets a temporary folder; on a
    cluster it is an error, as executors can't read each other's disks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node, depth``: nodes reached from ``seeds(node)`` over ``edges(src, dst)``, with the fewest steps.

    Only the last round's nodes meet the edges. Cycles end the search, not the
    depth bound, which is optional.
    """
    seen = cut(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    edges = cut(edges.select("src", "dst").distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = cut(ahead.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        # rounds are written once each; what was seen is their union
        seen, frontier = seen.unionByName(new), new
    return seen


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``root, node``: nodes that reach ``seeds(node)`` backwards over at least one ``allOf`` edge.

    ``edges(src, dst, kind)`` has kinds ``ref`` and ``allOf``. The state is a
    node and whether an ``allOf`` edge has been passed.
    """
    state = cut(seeds.select(F.col("node").alias("root"), "node").distinct().withColumn("inherits", F.lit(False)))
    back = cut(edges.select("src", "dst", (F.col("kind") == "allOf").alias("passes")).distinct())
    frontier = state
    while True:
        ahead = frontier.join(back, F.col("node") == F.col("dst")).select(
            "root", F.col("src").alias("node"), (F.col("inherits") | F.col("passes")).alias("inherits")
        )
        new = cut(ahead.distinct().join(state, ["root", "node", "inherits"], "left_anti"))
        if new.isEmpty():
            break
        state, frontier = state.unionByName(new), new
    return state.where("inherits").select("root", "node").distinct()


def chain_ends(links: DataFrame) -> DataFrame:
    """``node, end, hops, cyclic`` for ``links(node, target)``: where following single targets ends.

    Pointers double each round, so a chain of n hops takes about log2 n rounds.
    A node that runs into a cycle has a null end. Of several targets of a node
    the least counts.
    """
    first = cut(links.dropna().groupBy("node").agg(F.min("target").alias("target")))
    n = first.count()
    now = first.select("node", F.col("target").alias("end"), F.lit(1).cast("long").alias("hops"))
    rounds = max(1, n).bit_length() + 1
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("end"), F.col("end").alias("next_end"), F.col("hops").alias("more"))
        met = now.join(ahead, "end", "left").select(
            "node", F.coalesce("next_end", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), "next_end"
        )
        met = cut(met)
        now = met.drop("next_end")
        if met.where("next_end is not null").isEmpty():
            break  # all stand at their ends
    # after 2 ** rounds > n hops, whoever still stands on a node with a target is on a cycle
    inside = first.select(F.col("node").alias("end"), F.lit(True).alias("cyclic"))
    out = now.join(inside, "end", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return out.select(
        "node", F.when(~F.col("cyclic"), F.col("end")).alias("end"), F.when(~F.col("cyclic"), F.col("hops")).alias("hops"), "cyclic"
    )


def hierarchy_issues(tags: DataFrame) -> DataFrame:
    """Issues of ``tags(name, parent)``: ``tag.duplicate``, ``tag.parent`` (missing) and one ``tag.cycle`` per cycle."""
    names = tags.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    twice = names.where("n > 1").select(F.lit("tag.duplicate").alias("code"), "name")
    parents = tags.where("parent is not null").select("name", "parent").distinct()
    lost = parents.join(names.select(F.col("name").alias("parent")), "parent", "left_anti")
    lost = lost.select(F.lit("tag.parent").alias("code"), "name").distinct()
    links = cut(parents.groupBy("name").agg(F.min("parent").alias("target")).withColumnRenamed("name", "node"))
    if links.isEmpty():
        return twice.unionByName(lost)
    ends = chain_ends(links).where("cyclic").select("node")
    # on a cycle: nodes that stay after all with no cyclic child are peeled away
    ring = cut(links.join(ends, "node"))
    while True:
        kept = cut(ring.join(ring.select(F.col("target").alias("node")).distinct(), "node", "left_semi"))
        if kept.count() == ring.count():
            break
        ring = kept
    # the least name of a cycle, carried around it
    least = ring.select("node", "target", F.col("node").alias("least"))
    while True:
        handed = least.select(F.col("target").alias("node"), F.col("least").alias("other"))
        after = cut(least.join(handed, "node", "left").select("node", "target", F.least("least", F.coalesce("other", "least")).alias("least")))
        if after.exceptAll(least).isEmpty():
            break
        least = after
    cycles = least.select(F.lit("tag.cycle").alias("code"), F.col("least").alias("name")).distinct()
    return twice.unionByName(lost).unionByName(cycles)


def proven(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes proved by monotone rules: the least fixed point.

    ``facts(node)`` hold from the start. A row of ``rules(node, proof, needs)``
    says that ``node`` holds if all ``needs`` of one ``proof`` hold. Proofs of
    a node are alternatives.
    """
    known = cut(facts.select("node").distinct())
    rules = cut(rules.select("node", "proof", "needs").distinct())
    while True:
        held = rules.join(known.select(F.col("node").alias("needs"), F.lit(True).alias("held")), "needs", "left")
        met = held.groupBy("node", "proof").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("all_held"))
        new = cut(met.where("all_held").select("node").distinct().join(known, "node", "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def pruned(components: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of ``components(node, ...)`` that ``seeds`` reach."""
    return components.join(reachable(edges, seeds).select("node"), "node", "left_semi")


def nearest_ancestor(nodes: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """``path, ancestor``: for each path the longest of ``candidates(path)`` that it lies under, itself included.

    Each path meets the candidates on its own prefixes, an equi-join.
    """
    paths = nodes.select(F.col(path).alias("path")).distinct()
    tries = paths.withColumn("ancestor", F.explode(pointer_ancestors(F.col("path"))))
    met = tries.join(candidates.select(F.col(path).alias("ancestor")).distinct(), "ancestor")
    best = met.groupBy("path").agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return paths.join(best, "path", "left")
