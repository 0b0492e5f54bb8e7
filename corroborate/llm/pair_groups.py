"""Consolidating pairwise matches into groups, by stripping leaves and splicing chains."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators.components import solve_components
from corroborate.session import cut

#: A round of stripping has to take away this share of the edges, else the reduced core is solved.
WORTHWHILE = 0.4


def _number(handle: Column, seed: int) -> Column:
    return F.xxhash64(handle, F.lit(seed))


def _numbered(handles: DataFrame, tries: int = 8) -> tuple[DataFrame, int]:
    """(handle, id) of distinct handles, and the seed of the hash that gives the ids. Hashes spare a global sort and
    two joins of all pairs with a table of handles; that no two handles have the same one is checked, else they are
    drawn anew."""
    for seed in range(tries):
        ids = cut(handles.select("handle", _number(F.col("handle"), seed).alias("id")))
        if ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return ids, seed
    raise RuntimeError(f"handles share ids under {tries} hashes")


def _vertices(edges: DataFrame, seed: int) -> DataFrame:
    """Per vertex its degree, its neighbours' least and greatest id, and whether its hash is below all neighbours'."""
    hu, hv = F.xxhash64("u", F.lit(seed)), F.xxhash64("v", F.lit(seed))
    lower = (hu < hv) | ((hu == hv) & (F.col("u") < F.col("v")))
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y"), lower.alias("low")), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), (~lower).alias("low")))
    return edges.select(F.inline(ends)).groupBy("x").agg(F.count("*").alias("deg"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("low").alias("least"))


def group_pairs(pairs: DataFrame, vertices: DataFrame, worthwhile: float = WORTHWHILE) -> DataFrame:
    """(handle, group_handle) of all vertices(handle), linked by pairs(a, b); the group's name is its smallest handle
    by code point.

    Every round removes an independent set of light vertices (degree one or two): those whose hash, drawn anew each
    round, is below their neighbours'. A leaf is stripped; a chain vertex is spliced out, its two neighbours joined
    by an edge. That is list ranking by independent-set splicing: a chain of any length shrinks by a constant factor
    a round, as do bushes of leaves, so the number of rounds is logarithmic, not the length of the longest chain,
    and the work of all rounds together is a few times the first. Each removed vertex remembers the neighbour it
    hung on. When a round takes away less than the share `worthwhile` of the edges, the reduced core is solved by
    contraction. Labels then go back, last round first, each by one join with the removed vertices.

    A hub with a third of all pairs is never light; its pairs are only counted (with partial aggregation) and
    filtered by a join with the light vertices, which a skewed side doesn't gather in one task (AQE splits it).
    Null ends, self pairs and repeated pairs in either order are allowed. Vertices without a pair are groups of
    their own. Empty tables give no rows.
    """
    ids, named = _numbered(vertices.select("handle").where("handle is not null").distinct())
    a, b = _number(F.col("a"), named), _number(F.col("b"), named)
    edges = cut(pairs.where("a is not null and b is not null and a <> b").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    left = edges.count()
    removed: list[DataFrame] = []
    while left > 0:
        seed = len(removed)
        # leaf: hangs on its neighbour; chain vertex: hangs on the lower one, and lo - hi become neighbours
        light = cut(_vertices(edges, seed).where("deg <= 2 and least").select("x", "deg", "lo", "hi"))
        gone = light.select(F.col("x").alias("w"))
        hu, hv = F.xxhash64("u", F.lit(seed)), F.xxhash64("v", F.lit(seed))
        lower = F.when((hu < hv) | ((hu == hv) & (F.col("u") < F.col("v"))), F.col("u")).otherwise(F.col("v"))
        # only an edge's lower end can have been removed, so one anti-join finds the edges that stay
        stay = edges.withColumn("w", lower).join(gone, "w", "left_anti").select("u", "v")
        spliced = light.where("deg = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        edges = cut(stay.unionByName(spliced).distinct())
        removed.append(light.select(F.col("x").alias("id"), F.col("lo").alias("on")))
        before, left = left, edges.count()
        if left >= before or left > (1 - worthwhile) * before:
            break
    # every part is cut by itself: the union grows, but no part is computed twice
    parts = [cut(solve_components(edges))] if left else []
    for light in reversed(removed):
        if not parts:
            parts = [light.select("id", F.col("on").alias("root"))]
            continue
        known_roots = functools.reduce(DataFrame.unionByName, parts)
        # a neighbour that no later round saw an edge of is its own root
        back = light.join(known_roots.select(F.col("id").alias("on"), "root"), "on", "left")
        parts.append(cut(back.select("id", F.coalesce("root", "on").alias("root"))))
    if not parts:
        return ids.select("handle", F.col("handle").alias("group_handle"))
    roots = functools.reduce(DataFrame.unionByName, parts)
    all_roots = cut(ids.join(roots, "id", "left").select("handle", F.coalesce("root", "id").alias("root")))
    names = all_roots.groupBy("root").agg(F.min("handle").alias("group_handle"))
    return all_roots.join(names, "root").select("handle", "group_handle")


def handle_groups(edges: DataFrame) -> DataFrame:
    """group_pairs() over an evidence table (a, b, weight): linked by rows with both ends and weight > 0."""
    vertices = edges.select(F.explode(F.array("a", "b")).alias("handle"))
    linked = edges.where("weight > 0 and not isnan(weight)").select("a", "b")
    return group_pairs(linked, vertices)
