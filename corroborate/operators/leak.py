"""What sites claim in public beside what is said in private."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import jaccard

VOLUME_RATIO, REPOST = 5, 0.5


def bluffs(arcs: DataFrame, victims: DataFrame, slid: DataFrame, ratio: float = VOLUME_RATIO) -> DataFrame:
    """(victim_id, org, bluffs) of every negotiation arcs(victim_id, arc): a deadline that slid, a claim of more than
    ratio times what was proved, data advertised as sold while talks go on, and a promise to delete, in this order.
    Arcs without a public entry are kept."""
    public = victims.select("victim_id", "org", "claimed_gb", "status")
    moved = slid.where("deadline_slid").select("victim_id").distinct().withColumn("slid", F.lit(True))
    both = arcs.join(public, "victim_id", "left").join(moved, "victim_id", "left")
    found = F.array(
        F.when(F.col("slid"), F.lit("deadline_bluff")),
        F.when(F.col("claimed_gb") > ratio * F.col("arc.proof_gb"), F.lit("volume_bluff")),
        F.when((F.col("status") == "sold") & (F.col("arc.outcome") == "ongoing"), F.lit("sold_bluff")),
        F.when(F.array_contains("arc.tactics", "deletion_promise"), F.lit("deletion_bluff")),
    )
    return both.select("victim_id", F.coalesce("org", "arc.victim").alias("org"), F.array_compact(found).alias("bluffs"))


def repost_verdicts(entries: DataFrame, least: float = REPOST) -> DataFrame:
    """(victim_id, site_a, site_b, similarity, verdict) of entries(victim_id, site, words, claim), one per victim and
    site: a victim on two sites whose entries are at least `least` alike is a mirror if both claim the same, else a
    clone. A join on the victim, so as large as a victim's sites are many."""
    a = entries.select("victim_id", F.col("site").alias("site_a"), F.col("words").alias("wa"), F.col("claim").alias("ca"))
    b = entries.select("victim_id", F.col("site").alias("site_b"), F.col("words").alias("wb"), F.col("claim").alias("cb"))
    both = a.join(b, "victim_id").where("site_a < site_b").withColumn("similarity", jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= least)
    return both.select("victim_id", "site_a", "site_b", "similarity", F.when(F.col("ca").eqNullSafe(F.col("cb")), "mirror").otherwise("clone").alias("verdict"))


def bind_addresses(records: DataFrame, name: str, address: str, env: DataFrame) -> DataFrame:
    """records with the published address of env(line), lines `ADDR_<name>=<address>`, in place of their own; names
    that are pending or not published keep theirs."""
    key = F.lower(F.regexp_extract("line", r"(?i)^addr[-_]([^=]+)=", 1))
    value = F.trim(F.regexp_extract("line", r"=(.*)$", 1))
    live = env.select(key.alias("_k"), value.alias("_v")).where("_k <> '' and _v <> '' and lower(_v) <> 'pending'").groupBy("_k").agg(F.max("_v").alias("_v"))
    return records.withColumn("_k", F.lower(name)).join(live, "_k", "left").withColumn(address, F.coalesce("_v", address)).drop("_k", "_v")


def consistent(text: Column, own: str, rivals: list[str], anchor: int) -> Column:
    """A reply in which rivals' names are its own and no dollar figure is above the anchor."""
    for r in rivals:
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}]){r}(?![\p{{L}}\p{{N}}])", own)
    figures = F.regexp_extract_all(text, F.lit(r"\$[0-9][0-9,]*"), F.lit(0))
    big = F.filter(figures, lambda f: F.regexp_replace(f, r"[$,]", "").try_cast("decimal(38,0)") > anchor)
    return F.aggregate(big, text, lambda t, f: F.replace(t, f, F.lit(f"${anchor:,}")))


def naive_duplicates(pages: DataFrame) -> DataFrame:
    """(id, canonical, role) of pages(id, listed, digest, masked, pgp, btc): the plain way, for comparison. Equal hashes
    are mirrors of the least listed page, else the least; a page alone is a clone of the first listed one with the
    same hash but for its keys, if the keys differ and it has a wallet."""
    first = pages.groupBy("digest").agg(F.min(F.struct((~F.col("listed")).alias("o"), F.col("id"))).alias("f"), F.count("*").alias("n")).select("digest", F.col("f.id").alias("canonical"), "n")
    own = pages.join(first, "digest")
    heads = own.where((F.col("id") == F.col("canonical")) & F.col("listed")).groupBy("masked").agg(F.min(F.struct("id", "pgp", "btc")).alias("h")).select("masked", F.col("h.id").alias("original"), F.col("h.pgp").alias("pgp0"), F.col("h.btc").alias("btc0"))
    both = own.join(heads, "masked", "left")
    differs = ~(F.col("pgp").eqNullSafe(F.col("pgp0")) & F.col("btc").eqNullSafe(F.col("btc0")))
    clone = (F.col("n") == 1) & F.col("btc").isNotNull() & F.col("original").isNotNull() & (F.col("original") != F.col("id")) & differs
    role = F.when(clone, "clone").when(F.col("id") != F.col("canonical"), "mirror").otherwise("canonical")
    return both.select("id", F.when(clone, F.col("original")).otherwise(F.col("canonical")).alias("canonical"), role.alias("role"))


def public_private_gap(chats: DataFrame, public: DataFrame, share: float = 0.15) -> DataFrame:
    """(chat_id, gaps): chats(chat_id, group_name, first_demand, floor, final, theatre, sells, deletes) beside
    public(group_name, demand): an opening more than a share away from the public demand, a floor under it though the
    price was called final, talks beyond a deadline, and a promise to delete beside a threat to sell."""
    both = chats.join(public, "group_name", "left")
    found = F.array(
        F.when(F.abs(F.col("first_demand") - F.col("demand")) > share * F.col("demand"), F.lit("opening")),
        F.when(F.col("final") & (F.col("floor") < F.col("demand")), F.lit("floor")),
        F.when(F.col("theatre"), F.lit("deadline")),
        F.when(F.col("sells") & F.col("deletes"), F.lit("deletion")),
    )
    return both.select("chat_id", F.array_compact(found).alias("gaps"))
