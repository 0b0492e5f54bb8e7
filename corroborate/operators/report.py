"""Claims whose confidence comes from their basis, and the report made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what confidence a basis allows
CONFIDENCE = {"hard_identifier": "high", "observed_event": "high", "indirect_signals": "moderate", "single_soft_signal": "low"}
ORDER = {"high": 0, "moderate": 1, "low": 2}


def confidence(basis: Column) -> Column:
    """The level a basis allows; low for an unknown one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), basis), F.lit("low"))


def basis_of(hard: Column, events: Column, soft: Column) -> Column:
    """From the counts of hard identifiers, observed events and soft signals behind a claim."""
    return F.when(hard > 0, "hard_identifier").when(events > 0, "observed_event").when(soft > 1, "indirect_signals").otherwise("single_soft_signal")


def assemble(claims: DataFrame) -> DataFrame:
    """claims(id, basis, ...) plus confidence and finding, their place by confidence and id. A report is a list of
    tens of findings, so one window is over all of them."""
    level = confidence(F.col("basis"))
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), level)
    return claims.withColumn("confidence", level).withColumn("finding", F.row_number().over(Window.orderBy(rank, "id")))


def framers(cluster: DataFrame, pairs: DataFrame) -> DataFrame:
    """(handle): ends of framing pairs(a, b) outside the cluster(handle) whose other end is inside."""
    inside = cluster.select("handle").distinct().withColumn("in", F.lit(True))
    both = pairs.join(inside.select(F.col("handle").alias("a"), F.col("in").alias("ia")), "a", "left").join(inside.select(F.col("handle").alias("b"), F.col("in").alias("ib")), "b", "left")
    one = F.when(F.col("ia").isNotNull() & F.col("ib").isNull(), F.col("b")).when(F.col("ib").isNotNull() & F.col("ia").isNull(), F.col("a"))
    return both.select(one.alias("handle")).where("handle is not null").distinct()
