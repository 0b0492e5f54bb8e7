"""Whole analyses put together from the operators: each takes tables and gives a dict of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import address as A
from corroborate.functions import fields as E
from corroborate.functions import text as X
from corroborate.operators import evidence as V
from corroborate.operators import feeds as O
from corroborate.operators import leak as L
from corroborate.operators import pages as P
from corroborate.operators import report as R
from corroborate.operators.components import components
from corroborate.operators.ranking import numbered
from corroborate.operators.simjoin import similar_pairs
from corroborate.session import cut


def dedup(pages: DataFrame, likeness: float = 0.8, alike_structure: float = 0.85, k: int = 3, naive: bool = False) -> DataFrame:
    """(id, canonical, role, reason) of pages(id, html, listed). Pages are linked if their texts are alike, or their
    structure is and they share an asset (an image's or a style sheet's address); naive goes by hashes alone."""
    html = F.col("html")
    keys = pages.select("id", "listed", "html", A.pgp_key(html).alias("pgp"), A.btc_wallet(html).alias("btc"))
    if naive:
        hashed = keys.select("id", "listed", A.content_hash(html).alias("digest"), A.keymask_hash(html).alias("masked"), "pgp", "btc")
        return L.naive_duplicates(hashed).withColumn("reason", F.lit("hash"))
    asset = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<(?:img|link|script)\b[^>]*?(?:src|href)=[\"']([^\"']+)"), F.lit(1)))
    told = cut(keys.select("id", "listed", "pgp", "btc", X.shingles(html, k).alias("items"), X.simhash_bits(X.tag_features(html)).alias("s"), asset.alias("assets")))
    text = similar_pairs(told.select("id", "items"), likeness).select(F.col("x").alias("u"), F.col("y").alias("v"))
    # each page beside the least of those that show an asset, so an asset on m pages gives m - 1 candidates
    shown = told.select("id", "s", F.explode("assets").alias("asset"))
    head = shown.groupBy("asset").agg(F.min_by(F.struct("id", "s"), "id").alias("h"))
    bits = F.bit_count(F.col("s.hi").bitwiseXOR(F.col("h.s.hi"))) + F.bit_count(F.col("s.lo").bitwiseXOR(F.col("h.s.lo")))
    looks = shown.join(head, "asset").where(F.col("id") != F.col("h.id")).where(1 - bits / 64 >= alike_structure).select(F.col("h.id").alias("u"), F.col("id").alias("v"))
    groups = components(text.unionByName(looks).distinct(), told.select("id")).withColumnRenamed("component", "class_id")
    members = cut(groups.join(told, "id").withColumn("keyed", F.col("pgp").isNotNull() | F.col("btc").isNotNull()))
    top = P.canonical(members).join(members.select(F.col("id").alias("canonical"), F.col("pgp").alias("pgp0"), F.col("btc").alias("btc0"), F.col("items").alias("items0"), F.col("assets").alias("assets0")), "canonical")
    both = members.join(top, "class_id")
    pay = F.col("btc").isNotNull() & F.col("btc0").isNotNull()
    rule = P.intent(P.same_keys(F.col("pgp"), F.col("btc"), F.col("pgp0"), F.col("btc0")), pay, ~F.col("btc").eqNullSafe(F.col("btc0")), ~F.col("keyed"), X.jaccard(F.col("items"), F.col("items0")), F.arrays_overlap("assets", "assets0"), F.col("listed"))
    own = F.struct(F.lit("canonical").alias("role"), F.lit("").alias("reason"))
    return both.select("id", "canonical", F.when(F.col("id") == F.col("canonical"), own).otherwise(rule).alias("r")).select("id", "canonical", "r.*")


def market(pages: DataFrame, vendors: DataFrame, bait: float = 0.5, alike: float = 0.6) -> dict[str, DataFrame]:
    """listings, vendors, defences, honeypots, poisoned and flags of pages(file, html, status) and vendors(file, html).

    Pages behind a defence give no listing; of several pages of one listing the first by file counts. Flags are vendors
    of most listings (prolific), prices under a share of their category's median (bait) and rings of vendors whose
    descriptions are alike (ring)."""
    seen = cut(pages.withColumn("defence", E.defence(F.col("html"), F.col("status"))))
    record = E.parse_listing(F.col("html"))
    good = seen.where("defence = 'ok'").select("file", "html", record.alias("r")).select("file", "html", "r.*")
    first = good.where("listing_id is not null").groupBy("listing_id").agg(F.min_by(F.struct(*[c for c in good.columns if c != "listing_id"]), "file").alias("r")).select("listing_id", "r.*")
    listings = cut(first)
    words = listings.select(F.xxhash64("listing_id").alias("id"), "vendor", X.shingles(F.col("html"), 3).alias("items"))
    pairs = similar_pairs(words.select("id", "items"), alike).select(F.col("x").alias("u"), F.col("y").alias("v"))
    rings = words.join(components(pairs, words.select("id")), "id").groupBy("component").agg(F.count_distinct("vendor").alias("n"), F.array_join(F.array_sort(F.collect_set("vendor")), ",").alias("name")).where("n > 1")
    priced = listings.where("price is not null and category is not null")
    flags = (
        O.top_k(listings.where("vendor is not null").groupBy("vendor").agg(F.count("*").alias("n")), 1, F.desc("n"), F.col("vendor")).select(F.lit("prolific").alias("flag"), F.col("vendor").alias("name"))
        .unionByName(O.below_median(priced, "category", "price", bait).select(F.lit("bait").alias("flag"), F.col("listing_id").cast("string").alias("name")))
        .unionByName(rings.select(F.lit("ring").alias("flag"), "name"))
    )
    told = vendors.select("file", E.parse_vendor(F.col("html")).alias("r")).select("file", "r.*")
    return {
        "listings": listings.drop("html"),
        "vendors": told,
        "defences": seen.where("defence <> 'ok'").select("file", "defence", E.action(F.col("defence")).alias("action")),
        "honeypots": seen.select("file", F.explode(E.hidden_links(F.col("html"))).alias("link")),
        "poisoned": seen.where("defence = 'poisoned'").select("file"),
        "flags": flags,
    }


def leak(captures: DataFrame, transcripts: DataFrame) -> dict[str, DataFrame]:
    """victims, lifecycle, reposts, negotiations and bluffs of captures(t, site, file, html) of victim pages, in
    order of t, and transcripts(victim_id, text)."""
    rows = cut(captures.select("t", "site", "file", E.parse_victim(F.col("html")).alias("r")).select("t", "site", "file", "r.*").where("victim_id is not null"))
    w = Window.partitionBy("victim_id", "site").orderBy("t", "file")
    steps = rows.withColumns({"from_status": F.lag("status").over(w), "from_day": F.lag("deadline").over(w), "before": F.lag("t").over(w)}).where("before is not null")
    step = F.when(F.col("status").isin("published", "withdrawn"), F.col("status")).when(~F.col("status").eqNullSafe(F.col("from_status")), "escalated").otherwise("stable")
    lifecycle = steps.select("victim_id", "site", F.col("before").alias("t_from"), F.col("t").alias("t_to"), step.alias("transition"), F.coalesce(F.col("deadline") > F.col("from_day"), F.lit(False)).alias("deadline_slid"))
    last = rows.groupBy("victim_id", "site").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("victim_id", "site")]), F.struct("t", "file")).alias("r")).select("victim_id", "site", "r.*")
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "org", "sector", "country", "proof")), " "))
    reposts = L.repost_verdicts(last.select("victim_id", "site", words.alias("words"), F.col("claimed_gb").cast("string").alias("claim")))
    arcs = transcripts.select("victim_id", E.parse_arc(F.col("text")).alias("arc"))
    one = last.groupBy("victim_id").agg(F.max_by(F.struct("org", "claimed_gb", "status"), F.struct("t", "site")).alias("r")).select("victim_id", "r.*")
    return {"victims": last, "lifecycle": lifecycle, "reposts": reposts, "negotiations": arcs, "bluffs": L.bluffs(arcs, one, lifecycle)}


def personas(profiles: DataFrame, naive: bool = False) -> dict[str, DataFrame]:
    """personas, clusters (numbered op-1 ... in order of their members) and framing flags of profiles."""
    pairs = cut(V.pair_weights(V.all_edges(profiles, naive)))
    clusters = cut(V.fuse(pairs, profiles.select("handle")))
    ops = numbered(clusters.select("cluster", "size", "confidence").distinct(), "cluster").withColumn("op", F.concat(F.lit("op-"), "n")).drop("n")
    return {"personas": clusters, "clusters": ops, "framing_flags": V.framing_pairs(pairs)}


def report(claims: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """bluf, findings, what_would_change and annex of claims(id, statement, upgrade) and evidence(id, kind, source):
    the basis of a claim is told from its evidence (kind hard, event or soft), its confidence from the basis."""
    counts = evidence.groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("hard", "event", "soft")], F.array_sort(F.collect_set("source")).alias("evidence"))
    none = F.lit(0)
    told = claims.join(counts, "id", "left").withColumn("basis", R.basis_of(F.coalesce("hard", none), F.coalesce("event", none), F.coalesce("soft", none)))
    findings = cut(R.assemble(told.select("id", "statement", "upgrade", "basis", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))))
    return {
        "bluf": findings.orderBy("finding").limit(1).select("id", "statement", "confidence"),
        "findings": findings.select("finding", "id", "statement", "basis", "confidence"),
        "what_would_change": findings.where("confidence <> 'high'").select("finding", "id", "upgrade"),
        "annex": findings.select("id", F.explode("evidence").alias("source")),
    }
