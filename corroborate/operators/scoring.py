"""Grading results against the truth, without comparing pairs one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, empty: float = 1.0) -> Column:
    """n / d, and a fixed value where there is nothing to count."""
    return F.when(d == 0, F.lit(empty)).otherwise(n / d)


def pair_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row (true_pairs, found_pairs, right_pairs, false_merges, recall, precision) of two groupings (id, group).

    Pairs are counted from group sizes, n (n - 1) / 2 each: in the true groups, in the found ones, and in the cells
    where both agree. No pair is ever made. Ids missing on a side are alone there.
    """
    both = truth.select("id", F.col("group").alias("g")).join(found.select("id", F.col("group").alias("f")), "id", "full_outer")

    def pairs(*by: str) -> DataFrame:
        n = both.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("_".join(by)))

    one = pairs("g").crossJoin(pairs("f")).crossJoin(pairs("g", "f"))
    t, p, r = F.col("g"), F.col("f"), F.col("g_f")
    return one.select(t.alias("true_pairs"), p.alias("found_pairs"), r.alias("right_pairs"), (p - r).alias("false_merges"), ratio(r, t).alias("recall"), ratio(r, p).alias("precision"))


def set_scores(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """One row of recall and precision of rows as sets. Recall counts distinct right keys among the distinct true ones;
    precision counts them among all rows found, so repeats cost precision without being false."""
    t, f = truth.select(*key).distinct(), found.select(*key)
    right = t.join(f.distinct(), key, "left_semi").agg(F.count("*").alias("matched"))
    wrong = f.join(t, key, "left_anti").agg(F.count("*").alias("false_rows"))
    one = right.crossJoin(wrong).crossJoin(t.agg(F.count("*").alias("true_rows"))).crossJoin(f.agg(F.count("*").alias("found_rows")))
    return one.select("true_rows", "found_rows", "matched", "false_rows", ratio(F.col("matched"), F.col("true_rows")).alias("recall"), ratio(F.col("matched"), F.col("found_rows")).alias("precision"))


def field_recall(truth: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n, right, recall): how many true values of each field the found rows give; numbers are compared as
    numbers, all else as text. Missing rows and fields are wrong."""

    def long(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(F.col(key).alias("key"), F.inline(each))

    both = long(truth, "t").where("t is not null").join(long(found, "f"), ["key", "field"], "left")
    same = F.coalesce(F.col("t").try_cast("double") == F.col("f").try_cast("double"), F.col("t") == F.col("f"), F.lit(False))
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count_if(same).alias("right")).withColumn("recall", F.col("right") / F.col("n"))


def role_recall(truth: DataFrame, found: DataFrame, role: str) -> DataFrame:
    """One row (n, right, recall): true members(id, canonical, role) of a role that were found with that role in the
    cluster (id, cluster, role) of their canonical page."""
    t = truth.where(F.col("role") == role).select("id", "canonical")
    f = found.select("id", "cluster", F.col("role").alias("found_role"))
    home = found.select(F.col("id").alias("canonical"), F.col("cluster").alias("home"))
    both = t.join(f, "id", "left").join(home, "canonical", "left")
    ok = F.coalesce((F.col("cluster") == F.col("home")) & (F.col("found_role") == role), F.lit(False))
    return both.agg(F.count("*").alias("n"), F.count_if(ok).alias("right")).withColumn("recall", ratio(F.col("right"), F.col("n")))


def overclaims(truth: DataFrame, found: DataFrame, levels: list[str]) -> DataFrame:
    """One row (claims, covered, calibrated, overclaimed) of found(id, level) against truth(id, level): a claim is
    calibrated at its true level and overclaimed above it. An unknown level is the lowest."""
    order = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, i)])
    rank = lambda c: F.coalesce(F.try_element_at(order, F.col(c)), F.lit(0))
    both = truth.select("id", F.col("level").alias("t")).join(found.select("id", F.col("level").alias("f")), "id", "left")
    return both.agg(F.count("*").alias("claims"), F.count("f").alias("covered"), F.count_if(F.col("f") == F.col("t")).alias("calibrated"), F.count_if(F.col("f").isNotNull() & (rank("f") > rank("t"))).alias("overclaimed"))


def crawl_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row of a crawl found(host, role, same_as) against truth(host, role, original): services found, mirrors told
    as such of the right host, clones told as such, and clones believed to be services. Nothing to find counts 0."""
    t = truth.select("host", F.col("role").alias("t"), "original")
    both = t.join(found.select("host", F.col("role").alias("f"), "same_as"), "host", "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = both.agg(
        count(F.col("t") == "service").alias("services"),
        count((F.col("t") == "service") & F.col("f").isNotNull()).alias("reached"),
        F.count("f").alias("found"),
        count(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("real"),
        count(F.col("t") == "mirror").alias("mirrors"),
        count((F.col("t") == "mirror") & (F.col("f") == "mirror") & (F.col("same_as") == F.col("original"))).alias("mirrors_collapsed"),
        count(F.col("t") == "clone").alias("clones"),
        count((F.col("t") == "clone") & (F.col("f") == "clone")).alias("clones_caught"),
        count((F.col("t") == "clone") & (F.col("f") == "service")).alias("clones_believed"),
    )
    return n.withColumns({"recall": ratio(F.col("reached"), F.col("services"), 0.0), "precision": ratio(F.col("real"), F.col("found"), 0.0)})


def calibration(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row (groups, recovered, calibrated) of found(id, group, confidence) against truth(id, group, confidence):
    of the true groups of several ids, how many came out with exactly the same ids, and with the true confidence.
    Groups are compared by size and by the size of their common part, never brought together."""
    t = truth.groupBy("group").agg(F.count("*").alias("n"), F.max("confidence").alias("want")).where("n > 1")
    f = found.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("m"), F.max("confidence").alias("got"))
    common = truth.select("id", "group").join(found.select("id", F.col("group").alias("g")), "id").groupBy("group", "g").agg(F.count("*").alias("c"))
    exact = common.join(t, "group").join(f, "g").where("c = n and c = m")
    told = exact.agg(F.count("*").alias("recovered"), F.count_if(F.col("want") == F.col("got")).alias("calibrated"))
    return t.agg(F.count("*").alias("groups")).crossJoin(told)  # one row each


def at_level(truth: DataFrame, found: DataFrame, key: list[str], level: str) -> DataFrame:
    """One row (n, right): of the true rows of a level (key, severity), how many were found at it."""
    t = truth.where(F.col("severity") == level).select(*key).distinct()
    right = t.join(found.where(F.col("severity") == level).select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("right"))
    return t.agg(F.count("*").alias("n")).crossJoin(right)  # one row each


def label_recall(truth: DataFrame, found: DataFrame, key: str, labels: str) -> DataFrame:
    """One row (n, right, recall): of the labels true records carry in an array, how many the found ones carry too."""
    long = lambda df: df.select(F.col(key).alias("key"), F.explode(labels).alias("label")).distinct()
    t = long(truth)
    right = t.join(long(found), ["key", "label"], "left_semi").agg(F.count("*").alias("right"))
    return t.agg(F.count("*").alias("n")).crossJoin(right).select("n", "right", ratio(F.col("right"), F.col("n")).alias("recall"))


def provenance(claims: DataFrame, evidence: str = "evidence") -> DataFrame:
    """One row (claims, sourced): claims that name what they rest on."""
    return claims.agg(F.count("*").alias("claims"), F.count_if(F.size(F.filter(evidence, lambda e: e != "")) > 0).alias("sourced"))
