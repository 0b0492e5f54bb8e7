"""Closeness of ids in hash space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def xor_distance(a: Column, b: Column) -> Column:
    """The 256-bit distance of two texts' sha-256 hashes as a struct of eight 32-bit words, greatest first, so that
    structs order as the distances do."""
    word = lambda h, i: F.conv(F.substr(h, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("bigint")
    ha, hb = F.sha2(a, 256), F.sha2(b, 256)
    return F.struct(*[word(ha, i).bitwiseXOR(word(hb, i)).alias(f"w{i}") for i in range(8)])


def nearest_by_xor(ids: DataFrame, id: str, target: str, k: int) -> DataFrame:
    """(id, place): the k ids nearest to a target; ties go to the smaller id. A top-k, so each task keeps k rows."""
    near = ids.select(id, xor_distance(F.col(id), F.lit(target)).alias("d")).orderBy("d", id).limit(k)
    return near.select(id, F.row_number().over(Window.orderBy("d", id)).alias("place"))


def ring_distance(a: Column, b: Column) -> Column:
    """The shorter way between two places on a ring of circumference 1."""
    return F.least(F.abs(a - b), 1 - F.abs(a - b))


def greedy_route(neighbours: DataFrame, starts: DataFrame, target: float, max_hops: int = 20) -> DataFrame:
    """(start, node, hops): where a message goes that always moves to the neighbour nearest to target and stops when
    none is nearer. neighbours(node, place, next, next_place); starts(node, place). One join per hop for all
    starts at once."""
    from corroborate.session import cut

    best = F.min_by(F.struct("next", "next_place"), F.struct(ring_distance(F.col("next_place"), F.lit(target)), F.col("next")))
    hop = cut(neighbours.groupBy("node", "place").agg(best.alias("b")).select("node", "b.next", "b.next_place", ring_distance(F.col("place"), F.lit(target)).alias("here")).where(ring_distance(F.col("next_place"), F.lit(target)) < F.col("here")))
    at = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")))
    for _ in range(max_hops):
        moved = at.join(hop, "node", "left")
        at = cut(moved.select("start", F.coalesce("next", "node").alias("node"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("start", "node", "hops")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows plus n, from 1 in order of a column without ties. Sorted by ranges; each partition is numbered by itself
    from the counts of those before it, so no task sees all rows. Only a count per partition comes to the driver."""
    from corroborate.session import cut

    parts = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    total, before = 0, []
    for r in parts.groupBy("_p").agg(F.count("*").alias("k")).orderBy("_p").collect():
        before.append((r["_p"], total))
        total += r["k"]
    start = F.create_map(*[F.lit(x) for kv in before for x in kv]) if before else F.create_map().cast("map<int,int>")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("n", (inside + F.coalesce(F.try_element_at(start, F.col("_p")), F.lit(0))).cast("bigint")).drop("_p")
