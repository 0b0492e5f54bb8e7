"""Aggregates over feeds: bursts, reposts, concentration, staircases."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(counts: DataFrame, n: str = "n", sds: float = 2.0) -> DataFrame:
    """counts plus mean, sd (of the population), threshold and burst (strictly above mean + sds * sd). Periods
    without a row aren't in the population. The aggregate is one row and is joined back."""
    stats = counts.agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd")).withColumn("threshold", F.col("mean") + sds * F.col("sd"))
    return counts.crossJoin(F.broadcast(stats)).withColumn("burst", F.col(n) > F.col("threshold"))


def taxonomy(posts: DataFrame, item: str, group: str) -> DataFrame:
    """One row: new items, reposts, and how often an item came to a further group; null items or groups don't count."""
    good = posts.where(F.col(item).isNotNull() & F.col(group).isNotNull())
    per = good.groupBy(item).agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"))
    return per.agg(F.count("*").alias("new_items"), F.sum(F.col("n") - 1).alias("reposts"), F.sum(F.col("g") - 1).alias("cross_group"))


def running_total(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """counts plus total up to and including each row; counts is already one row per period."""
    return counts.withColumn("total", F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def lorenz(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Per key its rank by n (greatest first, ties by key), and the share of all that ranks up to it hold.

    The running sum is over two levels, so that no task sorts all keys: keys of one count are totalled first (there
    are few different counts), and the rank within a count needs no sum, as all add the same.
    """
    by_count = counts.groupBy(n).agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc(n))
    before = by_count.select(
        n,
        F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank0"),
        F.coalesce(F.sum(F.col("k") * F.col(n)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum0"),
    )
    total = counts.agg(F.sum(n).alias("all"))
    inside = counts.withColumn("r", F.row_number().over(Window.partitionBy(n).orderBy(key)))
    joined = inside.join(before, n).crossJoin(F.broadcast(total))
    return joined.select(key, n, (F.col("rank0") + F.col("r")).alias("rank"), ((F.col("sum0") + F.col("r") * F.col(n)) / F.col("all")).alias("share"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def below_median(df: DataFrame, group: str, value: str, fraction: float) -> DataFrame:
    """Rows whose value is under a fraction of their group's exact median, with the median."""
    good = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    return good.join(good.groupBy(group).agg(F.median(value).alias("median")), group).where(F.col(value) < fraction * F.col("median"))


def staircase(turns: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The turns at which a running demand is first stated or reaches a new strict low; turns without a value are
    no steps. The window is per conversation."""
    w = Window.partitionBy(*key).orderBy(order)
    lowest = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stated = turns.where(F.col(value).isNotNull()).withColumn("_low", lowest)
    steps = stated.where(F.col("_low").isNull() | (F.col(value) < F.col("_low")))
    return steps.drop("_low").withColumn("step", F.row_number().over(w))


def final_then_lower(turns: DataFrame, key: list[str], order: str, value: str, final: str) -> DataFrame:
    """Per key the first turn that calls its figure final, and the first later turn with a lower one."""
    first = turns.where(F.col(final) & F.col(value).isNotNull()).groupBy(*key).agg(F.min(order).alias("final_at"), F.min_by(value, order).alias("final_value"))
    later = turns.where(F.col(value).isNotNull()).join(first, key).where((F.col(order) > F.col("final_at")) & (F.col(value) < F.col("final_value")))
    return later.groupBy(*key, "final_at", "final_value").agg(F.min(order).alias("lower_at"), F.min_by(value, order).alias("lower_value"))


def turns_after(turns: DataFrame, key: list[str], order: str, mark: str, least: int = 3) -> DataFrame:
    """Per key the first marked turn and how many turns follow it, if at least `least` do."""
    first = turns.where(F.col(mark)).groupBy(*key).agg(F.min(order).alias("at"))
    return turns.join(first, key).where(F.col(order) > F.col("at")).groupBy(*key, "at").agg(F.count("*").alias("after")).where(F.col("after") >= least)


def tops(parts: list[DataFrame], most: dict[str, int]) -> DataFrame:
    """(kind, name, n, place): of each kind of parts(kind, name) the names with most rows, as many as most says; ties
    by name. Counted partially; a place is only asked for within the few rows a kind keeps (a top-k per kind)."""
    out = []
    for part, (kind, k) in zip(parts, most.items()):
        counts = part.toDF("kind", "name").where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
        out.append(counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))))
    return functools.reduce(DataFrame.unionByName, out)


def thinned(points: DataFrame, order: str, most: int) -> DataFrame:
    """Every k-th of points, so that at most `most` are left, and the last; points is one row per period."""
    w = Window.orderBy(order)
    n = points.withColumns({"_i": F.row_number().over(w) - 1, "_k": F.count("*").over(Window.partitionBy())})
    step = F.greatest(F.lit(1), F.ceil(F.col("_k") / most))
    return n.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_k") - 1)).drop("_i", "_k")


def lagged_correlations(counts: DataFrame, series: str, bucket: str, n: str, lags: int = 8) -> DataFrame:
    """(a, b, lag, pairs, r) of every two series of counts(series, bucket, n), a < b: Pearson's correlation of a at
    bucket i and b at i + lag over the buckets in which any series has a count; missing counts are zero. r is 0
    without variance; lags with under 4 pairs are left out.

    One plan for all series: the sums of a series depend on the lag alone, so they are made once, and only buckets
    in which both have counts meet. From sums of integers, so exact and independent of order.
    """
    each = F.explode(F.sequence(F.lit(-lags), F.lit(lags)))
    rows = counts.select(F.col(series).alias("s"), F.col(bucket).alias("t"), F.col(n).cast("bigint").alias("n"))
    spine = rows.select("t").distinct()
    ends = spine.select(F.col("t").alias("at"))
    moved = spine.select("t", each.alias("lag")).withColumn("at", F.col("t") + F.col("lag")).join(ends, "at")
    pairs = moved.groupBy("lag").agg(F.count("*").alias("pairs")).where("pairs >= 4")
    sums = lambda at, x: moved.select(F.col(at).alias("_t"), "lag").join(rows.withColumnRenamed("t", "_t"), "_t").groupBy("lag", F.col("s").alias(x)).agg(F.sum("n").alias(f"s{x}"), F.sum(F.col("n") * F.col("n")).alias(f"q{x}"))
    a, b = rows.select(F.col("s").alias("a"), "t", F.col("n").alias("x")), rows.select(F.col("s").alias("b"), F.col("t").alias("at"), F.col("n").alias("y"))
    met = a.withColumn("lag", each).withColumn("at", F.col("t") + F.col("lag")).join(b, "at").where("a < b").groupBy("a", "b", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    all_ = sums("t", "a").join(sums("at", "b"), "lag").where("a < b").join(pairs, "lag").join(met, ["a", "b", "lag"], "left")
    k = F.col("pairs")
    vx, vy = k * F.col("qa") - F.col("sa") * F.col("sa"), k * F.col("qb") - F.col("sb") * F.col("sb")
    r = F.when((vx > 0) & (vy > 0), (k * F.coalesce("xy", F.lit(0)) - F.col("sa") * F.col("sb")) / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))).otherwise(0.0)
    return all_.select("a", "b", "lag", "pairs", r.alias("r"))


def lagged_correlation(a: DataFrame, b: DataFrame, bucket: str, n: str, buckets: DataFrame, lags: int = 8) -> DataFrame:
    """(lag, pairs, r): Pearson's correlation of series a at bucket i and b at i + lag, over the buckets where both
    are in buckets(bucket); missing counts are zero. r is 0 without variance; lags with under 4 pairs are left out.
    From sums of integers, so exact and independent of order."""
    spine = buckets.select(bucket).distinct()
    x = spine.join(a.select(bucket, F.col(n).alias("x")), bucket, "left").select(bucket, F.coalesce("x", F.lit(0)).cast("bigint").alias("x"))
    y = spine.join(b.select(bucket, F.col(n).alias("y")), bucket, "left").select(F.col(bucket).alias("at"), F.coalesce("y", F.lit(0)).cast("bigint").alias("y"))
    moved = x.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("at", F.col(bucket) + F.col("lag"))
    s = moved.join(y, "at").groupBy("lag").agg(F.count("*").alias("pairs"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    k = F.col("pairs")
    vx, vy = k * F.col("sxx") - F.col("sx") * F.col("sx"), k * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), (k * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))).otherwise(0.0)
    return s.where(k >= 4).select("lag", "pairs", r.alias("r"))
