"""Mirrors, clones and canonical pages; a crawl over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import address as A
from corroborate.session import cut


def exact_groups(pages: DataFrame, id: str, digest: Column) -> DataFrame:
    """(id, digest, canonical, copies): pages that share a content hash with others; the least id is canonical."""
    each = pages.select(F.col(id).alias("id"), digest.alias("digest")).where("digest is not null")
    groups = each.groupBy("digest").agg(F.min("id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1")
    return each.join(groups, "digest").select("id", "digest", "canonical", "copies")


def canonical(members: DataFrame, group: str = "class_id") -> DataFrame:
    """(group, canonical): the least listed id of members(id, group, listed, keyed), else the least with a key, else
    the least. Among listed members it doesn't matter who has a key."""
    rank = F.when(F.col("listed"), 0).when(F.col("keyed"), 1).otherwise(2)
    return members.groupBy(group).agg(F.min(F.struct(rank.alias("r"), F.col("id"))).alias("m")).select(group, F.col("m.id").alias("canonical"))


def intent(same_keys: Column, both_pay: Column, pays_differ: Column, keyless: Column, similarity: Column, shared_asset: Column, listed: Column) -> Column:
    """STRUCT<role, reason> of a look-alike beside the canonical page, by the first rule that fits."""
    rule = lambda role, reason: F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"))
    return (
        F.when(same_keys, rule("mirror", "shared_payment"))
        .when(both_pay & pays_differ, rule("clone", "payment_swap"))
        .when(keyless & (similarity >= 0.5), rule("mirror", "benign_copy"))
        .when(keyless & shared_asset & ~listed, rule("clone", "keyless_copy"))
        .otherwise(rule("mirror", "benign_copy"))
    )


def same_keys(pgp_a: Column, btc_a: Column, pgp_b: Column, btc_b: Column) -> Column:
    """Equal key material with a wallet on either side; a missing pgp key equals a missing one."""
    return btc_a.isNotNull() & btc_b.isNotNull() & (btc_a == btc_b) & pgp_a.eqNullSafe(pgp_b)


def services(first_pages: DataFrame) -> DataFrame:
    """(host, role, same_as) of first_pages(host, pos, chash, shash, pgp, btc), one row per host in order of pos.

    In a group of one structural hash the first is a service; a later one is a mirror if its content equals a
    service's, a clone if its keys differ from the first one's, and a service otherwise. Only services register
    hashes, so two equal clones are both clones. A window per structural hash; hosts with one template are few.
    """
    w = Window.partitionBy("shash").orderBy("pos")
    first = first_pages.withColumns({"n": F.row_number().over(w), "pgp0": F.first("pgp").over(w), "btc0": F.first("btc").over(w)})
    differs = ~(F.col("pgp").eqNullSafe(F.col("pgp0")) & F.col("btc").eqNullSafe(F.col("btc0")))
    serves = (F.col("n") == 1) | ~differs
    originals = first.where(serves).groupBy("chash").agg(F.min_by("host", "pos").alias("same_as"), F.min("pos").alias("at"))
    both = first.join(originals, "chash", "left").withColumn("earlier", F.col("at") < F.col("pos"))
    role = F.when(F.coalesce("earlier", F.lit(False)), "mirror").when((F.col("n") > 1) & differs, "clone").otherwise("service")
    return both.select("host", role.alias("role"), F.when(role == "mirror", F.col("same_as")).alias("same_as"))


def crawl(pages: DataFrame, seeds: list[str], allowed: DataFrame, sessions: bool = True, max_depth: int = 50) -> DataFrame:
    """(url, depth): the stored pages reached from seeds, breadth first, within allowed(host) on dark networks.

    pages(url, status, html, needs_session). Links are taken out of every page once; then each depth is a join of
    the frontier with the link table, less what has been seen and what is out of scope. A page behind a login is
    reached only with sessions. Unreachable and failed pages lead nowhere.
    """
    ok = pages.where((F.col("status") == 200) & F.col("html").isNotNull() & (F.lit(sessions) | ~F.coalesce("needs_session", F.lit(False))))
    links = cut(ok.select(F.col("url").alias("src"), F.explode(A.links_of(F.col("html"), F.col("url"))).alias("url")).distinct())
    scope = cut(A.in_scope(links.select("url").distinct().unionByName(pages.select("url")).distinct(), "url", allowed))
    start = pages.sparkSession.createDataFrame([(A.normalized(s),) for s in seeds], "url string").join(scope, "url", "left_semi")
    seen = cut(start.distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.select(F.col("url").alias("src")), "src").select("url").distinct()
        frontier = cut(step.join(scope, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.join(ok.select("url").distinct(), "url", "left_semi")
