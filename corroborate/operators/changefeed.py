"""From consecutive snapshots to typed, ranked alerts without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.operators.snapshot_diff import canonical_map, consecutive, latest_delivery

# fixed values: the order of severities, and what each type of change starts from
RANKS = {"suppress": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
BASE = {
    "operator_resurface": "critical", "new_clone": "critical", "publication": "high", "new_victim": "high", "withdrawal": "medium", "deadline_slip": "medium",
    "market_down": "medium", "new_mirror": "low", "new_persona": "low", "content_change": "medium", "status_change": "low", "cosmetic_churn": "suppress",
}
CERTAIN = ("operator_resurface", "new_clone")
KLASS = {"victims": "victim", "sites": "site", "mirrors": "mirror", "clones": "clone", "personas": "persona", "pages": "page"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def attr(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def change_events(snapshots: DataFrame) -> DataFrame:
    """(t_from, t_to, pos, klass, name, surface, before, after) of snapshots(t, taken_at, section, name, site, attrs,
    loaded_at). Victims count when they appear, vanish or change status or deadline; sites when their state and
    pages when anything changes, if in both snapshots; mirrors, clones and personas when they appear. Missing
    attributes are left out of the maps, so all their spellings are equal."""
    key = ["section", "name", "site"]
    steps = consecutive(snapshots, "t", "taken_at")
    rows = latest_delivery(snapshots.withColumn("site", F.coalesce("site", F.lit(""))), key, "t", "loaded_at", canonical_map(F.col("attrs")))
    at = rows.join(steps.select("t_from", "pos"), rows["t"] == F.col("t_from")).select(*key, "pos", "state")
    old = at.withColumnRenamed("state", "old")
    new = at.select(*key, (F.col("pos") - 1).alias("pos"), F.col("state").alias("new"))
    both = old.join(new, [*key, "pos"], "full_outer").join(steps.where("t_to is not null"), "pos")
    was, now = F.map_from_entries("old"), F.map_from_entries("new")
    e = both.select("t_from", "t_to", "pos", "section", "name", "site", was.alias("before"), now.alias("after"))
    b, a = F.col("before"), F.col("after")
    here = b.isNotNull() & a.isNotNull()
    differs = lambda k: ~attr(b, k).eqNullSafe(attr(a, k))
    counts = (
        F.when(F.col("section") == "victims", ~here | differs("status") | differs("deadline"))
        .when(F.col("section") == "sites", here & differs("state"))
        .when(F.col("section") == "pages", here & (F.map_entries(b) != F.map_entries(a)))
        .when(F.col("section").isin("mirrors", "clones", "personas"), b.isNull())
        .otherwise(False)
    )
    surface = F.when(F.col("section") == "victims", F.col("site")).otherwise(F.col("name"))
    return e.where(counts).select("t_from", "t_to", "pos", F.try_element_at(_map(KLASS), F.col("section")).alias("klass"), "name", surface.alias("surface"), "before", "after")


def typed(events: DataFrame, watch: DataFrame) -> DataFrame:
    """events plus type; watch(kind, value) holds keys, wallets and handles, each a semi-join."""
    b, a = F.col("before"), F.col("after")
    known = lambda kind, name: watch.where(F.col("kind") == kind).select(F.col("value").alias(name)).distinct().withColumn(f"has_{name}", F.lit(True))
    e = events.withColumns({"k": attr(a, "signed_key"), "w": attr(a, "wallet")}).join(known("key", "k"), "k", "left").join(known("wallet", "w"), "w", "left")
    seen = F.coalesce("has_k", F.lit(False)) | F.coalesce("has_w", F.lit(False))
    status = lambda m: attr(m, "status")
    victim = (
        F.when(a.isNull(), F.when(status(b).eqNullSafe(F.lit("published")), "victim_removed").otherwise("withdrawal"))
        .when(b.isNull(), "new_victim")
        .when(status(a).eqNullSafe(F.lit("published")) & ~status(b).eqNullSafe(F.lit("published")), "publication")
        .when(attr(a, "deadline") > attr(b, "deadline"), "deadline_slip")
        .otherwise("status_change")
    )
    kind = (
        F.when(F.col("klass") == "victim", victim)
        .when(F.col("klass") == "site", F.when(attr(a, "state").eqNullSafe(F.lit("down")), "market_down").otherwise("site_restored"))
        .when(F.col("klass") == "mirror", "new_mirror")
        .when(F.col("klass") == "clone", "new_clone")
        .when(F.col("klass") == "persona", F.when(seen, "operator_resurface").otherwise("new_persona"))
        .when(F.col("klass") == "page", F.when(attr(b, "content_id").eqNullSafe(attr(a, "content_id")), "cosmetic_churn").otherwise("content_change"))
        .otherwise("unknown")
    )
    return e.withColumn("type", kind).drop("k", "w", "has_k", "has_w")


def scored(events: DataFrame, watch: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """events plus rank, watched and confidence. A watched operator's site going down counts one rank more."""
    handles = watch.where("kind = 'handle'").select(F.col("value").alias("operator")).distinct().withColumn("known", F.lit(True))
    op = F.coalesce(attr(F.col("after"), "operator"), attr(F.col("before"), "operator"))
    e = events.withColumn("operator", op).join(handles, "operator", "left")
    watched = (F.col("type") == "operator_resurface") | F.coalesce("known", F.lit(False))
    start = F.coalesce(F.try_element_at(_map({k: RANKS[v] for k, v in base.items()}), F.col("type")), F.lit(RANKS["low"]))
    rank = F.when(watched & (F.col("type") == "market_down"), F.least(F.lit(4), start + 1)).otherwise(start)
    return e.withColumns({"rank": rank, "watched": watched, "confidence": F.when(F.col("type").isin(*CERTAIN), "high").otherwise("medium")}).drop("operator", "known")


def origins(snapshots: DataFrame) -> DataFrame:
    """(surface, origin): where each mirror copies from, as its latest delivery says."""
    m = snapshots.where("section = 'mirrors' and attrs['of'] is not null")
    return m.groupBy(F.col("name").alias("surface")).agg(F.max_by(F.col("attrs")["of"], F.struct("taken_at", "loaded_at", F.col("attrs")["of"])).alias("origin"))


def collapsed(events: DataFrame, mirrors: DataFrame) -> DataFrame:
    """One event per name, origin surface and snapshot: the one on the origin itself if there is one, else that of
    the highest rank, told as the origin's; ties go to the smaller surface and type. seen_on lists the surfaces."""
    e = events.join(mirrors, "surface", "left").withColumn("origin", F.coalesce("origin", "surface"))
    w = Window.partitionBy("name", "origin", "t_to").orderBy(F.desc(F.col("surface") == F.col("origin")), F.desc("rank"), "surface", "type")
    whole = Window.partitionBy("name", "origin", "t_to")
    all_ = e.withColumns({"n": F.row_number().over(w), "size": F.count("*").over(whole), "seen_on": F.array_sort(F.collect_set("surface").over(whole))})
    return all_.where("n = 1").withColumn("surface", F.col("origin")).withColumn("seen_on", F.when(F.col("size") > 1, F.col("seen_on"))).drop("origin", "n")


def alerts(snapshots: DataFrame, watch: DataFrame) -> DataFrame:
    """(t_from, t_to, type, name, surface, severity, rank, watched, confidence, n_seen_on), suppressed ones left out."""
    events = collapsed(scored(typed(change_events(snapshots), watch), watch), origins(snapshots))
    name = F.try_element_at(_map({v: k for k, v in RANKS.items()}), F.col("rank"))
    return events.where("rank > 0").select("t_from", "t_to", "type", "name", "surface", name.alias("severity"), "rank", "watched", "confidence", F.size(F.coalesce("seen_on", F.array())).alias("n_seen_on"))
