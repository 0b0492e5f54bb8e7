"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.session import cut


def solve_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) of every vertex in edges(u, v): BIGINT ids, root the same for all vertices of a component.

    Every round, each vertex moves to the one of least hash within two steps, and the graph is contracted
    accordingly: stars of any size and most small groups are done in one round. Hashes are drawn anew each round, so
    no order of ids (a long path, say) is slow: a constant share of the vertices goes per round. The labels then go
    back round by round. A hub's edges are only aggregated partially and joined with one row per vertex, never
    gathered. Self loops and repeated edges are allowed; null ends are dropped. Raises if max_rounds don't do, rather
    than return groups that are too small.
    """
    rest = cut(edges.where("u is not null and v is not null").select("u", "v").distinct())
    loops = rest.where("u = v").select("u")
    rest = rest.where("u <> v")
    moves: list[DataFrame] = []
    seed = 0
    while not rest.isEmpty():
        if seed == max_rounds:
            raise RuntimeError(f"components aren't done after {max_rounds} rounds")
        both = rest.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("y"))  # noqa: B023, E731
        step = both.groupBy("x").agg(F.min(ranked("y")).alias("m")).select(F.col("x").alias("y"), F.least("m", ranked("x")).alias("m"))
        # the least of the neighbours' least is never above the vertex itself, for it is a neighbour of theirs
        to = cut(both.join(step, "y").groupBy("x").agg(F.min("m").alias("m")).select("x", F.col("m.y").alias("y")))
        moves.append(to)
        moved = rest.join(to.select(F.col("x").alias("u"), F.col("y").alias("mu")), "u").join(to.select(F.col("x").alias("v"), F.col("y").alias("mv")), "v")
        rest = cut(moved.where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
        seed += 1
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("root"))
    if not moves:
        return alone
    labels = moves[-1].select(F.col("x").alias("id"), F.col("y").alias("root"))
    for to in reversed(moves[:-1]):
        labels = to.join(labels.select(F.col("id").alias("y"), "root"), "y", "left").select(F.col("x").alias("id"), F.coalesce("root", "y").alias("root"))
    return labels.unionByName(alone.join(labels, "id", "left_anti"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): all vertices(id), component the least id of the group. Vertices without an edge are kept."""
    roots = cut(solve_components(edges))
    names = roots.groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(names, "root").select("id", "component")
    return vertices.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
