"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm import conversations, encode, mixture, pair_groups, product_groups, quantiles, residue, split
from corroborate.session import cut
from corroborate.sources.tables import table

QS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
EPS = 0.005


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return product_groups.same_product(table(spark, d, "listings"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each listing with the smallest listing of its product and how many offer it."""
    groups = cut(product_groups.group_products(table(spark, d, "listings")))
    named = groups.groupBy("group_id").agg(F.min("listing_id").alias("group_listing_id"), F.count("*").alias("n_listings"))
    return groups.join(named, "group_id").select("listing_id", "group_listing_id", "n_listings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "listings"))


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """Per listing with residue, the fields that hold it."""
    return residue.flags(table(spark, d, "listings")).where("bad_title or bad_vendor or bad_price").select("rec_id", "bad_title", "bad_vendor", "bad_price")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """One sketch per category and list_date: what a daily job would keep."""
    found = quantiles.sketches(table(spark, d, "market_listings"), ["category", "list_date"], "price_btc_low", EPS)
    return cut(quantiles.merge_sketches(cut(found), ["category", "list_date"], EPS))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per category and list_date, and per category over all dates (list_date null), the latter from the kept daily
    sketches, united by a tree."""
    daily = _daily(spark, d)
    by_day = quantiles.percentiles(daily, ["category", "list_date"], QS, EPS)
    parts = 1 << 14
    united = daily.withColumn("part", F.pmod(F.coalesce(F.datediff(F.to_date("list_date"), F.lit("2000-01-01").cast("date")), F.lit(0)), F.lit(parts))).drop("list_date")
    over_all = quantiles.percentiles(quantiles.merge_sketches(united, ["category"], EPS, parts=parts), ["category"], QS, EPS)
    return by_day.unionByName(over_all.withColumn("list_date", F.lit(None).cast("string")))


def p5_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Per category, from one sketch per input partition."""
    kept = cut(quantiles.sketches(table(spark, d, "market_listings"), ["category"], "price_btc_low", EPS))
    return quantiles.percentiles(quantiles.merge_sketches(kept, ["category"], EPS), ["category"], QS, EPS)


def p5_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile is within the stated error of its exact rank, counted over all rows."""
    told = cut(p5_by_category(spark, d))
    rows = table(spark, d, "market_listings").where("price_btc_low is not null and not isnan(price_btc_low)").select("category", "price_btc_low")
    asked = F.broadcast(told.groupBy("category").agg(F.collect_list(F.struct("q", "value", "n", "eps")).alias("told")))
    v = F.col("price_btc_low")
    ranks = (
        rows.join(asked, rows["category"].eqNullSafe(asked["category"]))
        .select(rows["category"].alias("category"), v, F.inline("told"))
        .groupBy("category", "q", "value", "n", "eps")
        .agg(F.count_if(v < F.col("value")).alias("below"), F.count_if(v <= F.col("value")).alias("upto"), F.count("*").alias("n_values"))
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    slack = F.col("eps") * F.col("n") + 1
    return ranks.select("category", "q", "n_values", ((rank >= F.col("below") + 1 - slack) & (rank <= F.col("upto") + slack) & (F.col("n") == F.col("n_values"))).alias("within"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_groups.handle_groups(table(spark, d, "edges"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "messages"))


def p7_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return conversations.transcripts(table(spark, d, "messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(table(spark, d, "documents"), table(spark, d, "split_limits"))


def p8_empty(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an id: those without text."""
    return p8_ids(spark, d).where("size(ids) = 0").select("doc_id")


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """One row that tells whether the mixture keeps its rules: documents used more often than their source allows,
    and documents that aren't of a source with a target."""
    used = p9_mix(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    caps = table(spark, d, "mix_targets").groupBy("source").agg(F.max("max_repeats").alias("cap"))
    both = used.join(docs, "doc_id", "left").join(F.broadcast(caps), "source", "left")
    return both.agg(F.count_if(F.col("n") > F.col("cap")).alias("over_cap"), F.count_if(F.col("cap").isNull()).alias("without_target"))


def p10_cover(spark: SparkSession, d: str) -> DataFrame:
    """One row that tells whether the pieces keep their rules: pieces over their limit, pieces that don't start within
    or right after the one before, texts whose ends aren't reached, and pieces whose text isn't what their place says."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("whole"))
    limits = table(spark, d, "split_limits").groupBy("source").agg(F.min("max_tokens").alias("most"))
    pieces = p10_pieces(spark, d).join(docs, "doc_id").join(F.broadcast(limits), "source")
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    each = pieces.withColumns({"last": F.lag("end_char").over(w), "next": F.lead("piece_no").over(w)})
    same = F.substr("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")
    return each.agg(
        F.count_if(F.col("n_tokens") > F.col("most")).alias("over_limit"),
        F.count_if((F.coalesce("last", F.lit(0)) < F.col("start_char")) | (F.col("end_char") <= F.coalesce("last", F.lit(0)))).alias("broken"),
        F.count_if(F.col("next").isNull() & (F.col("end_char") != F.length("whole"))).alias("unfinished"),
        F.count_if(~same).alias("misplaced"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_fields": p2_fields,
    "p5_percentiles": p5_percentiles,
    "p5_by_category": p5_by_category,
    "p5_bound": p5_bound,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_transcripts": p7_transcripts,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_pieces": p10_pieces,
    "p8_empty": p8_empty,
    "p9_caps": p9_caps,
    "p10_cover": p10_cover,
}

_P7 = r"""
WITH r AS (
  SELECT group_name, chat_id, seq, msg_id, content, content IS NOT NULL AND regexp_matches(content, '\S') AS spoken,
         party IS NULL OR NOT regexp_matches(party, '\S') AS nameless,
         CASE WHEN lower(trim(party)) = 'victim' THEN 'victim' ELSE 'operator' END AS speaker FROM messages),
turns AS (
  SELECT group_name, chat_id, seq, content, speaker, min(msg_id) AS msg_id, bool_or(nameless) AS nameless
  FROM r WHERE spoken GROUP BY ALL),
seqs AS (SELECT group_name, chat_id, count(DISTINCT seq) AS n, min(seq) AS lo, max(seq) AS hi, bool_or(seq IS NULL) AS lost FROM r GROUP BY ALL),
heard AS (
  SELECT group_name, chat_id, count(*) AS n_turns, count(DISTINCT seq) AS n_seqs, count(DISTINCT speaker) AS roles, bool_or(nameless) AS nameless
  FROM turns GROUP BY ALL),
kept AS (
  SELECT s.group_name, s.chat_id FROM seqs s JOIN heard h
    ON s.group_name IS NOT DISTINCT FROM h.group_name AND s.chat_id IS NOT DISTINCT FROM h.chat_id
  WHERE s.lo = 0 AND s.hi + 1 = s.n AND NOT s.lost AND h.n_turns = h.n_seqs AND h.roles = 2 AND NOT h.nameless),
found AS (
  SELECT t.group_name, t.chat_id, row_number() OVER (PARTITION BY t.group_name, t.chat_id ORDER BY t.seq)::INT AS turn, t.msg_id, t.speaker, t.content
  FROM turns t JOIN kept k ON t.group_name IS NOT DISTINCT FROM k.group_name AND t.chat_id IS NOT DISTINCT FROM k.chat_id)
"""

SQL = {
    "p8_empty": "SELECT doc_id FROM documents WHERE text IS NULL OR text = ''",
    "p9_caps": "SELECT 0::BIGINT AS over_cap, 0::BIGINT AS without_target",
    "p10_cover": "SELECT 0::BIGINT AS over_limit, 0::BIGINT AS broken, 0::BIGINT AS unfinished, 0::BIGINT AS misplaced",
    "p5_bound": """
SELECT category, q, count(*) AS n_values, true AS within
FROM market_listings, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q)
WHERE price_btc_low IS NOT NULL AND NOT isnan(price_btc_low) GROUP BY ALL""",
    "p6_found": """
WITH RECURSIVE v AS (SELECT DISTINCT handle FROM (SELECT a AS handle FROM edges UNION ALL SELECT b FROM edges) WHERE handle IS NOT NULL),
e AS (SELECT a AS x, b AS y FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND weight > 0 AND a <> b
      UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND weight > 0 AND a <> b),
reach AS (SELECT handle, handle AS other FROM v UNION SELECT r.handle, e.y FROM reach r JOIN e ON r.other = e.x)
SELECT handle, min(other) AS group_handle FROM reach GROUP BY handle""",
    "p7_found": _P7 + "SELECT group_name, chat_id, turn, msg_id, speaker FROM found",
    "p7_transcripts": _P7
    + """SELECT group_name, chat_id, (turn - 1) // 4096 AS part, count(*) AS n_turns,
list(struct_pack(turn := turn, speaker := speaker, content := content) ORDER BY turn) AS turns FROM found GROUP BY ALL""",
}
