"""Queries of dashboards and reports: top lists, tiers, thinned curves, verdicts, and conversations beside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.functions import fields as E
from corroborate.operators import feeds as O
from corroborate.operators.ranking import numbered
from corroborate.plans import feeds as P
from corroborate.plans import monitor as M
from corroborate.sources.tables import table


TIERS = ["0.0001", "0.001", "0.01", "0.1", "1", "10", "100", "1000", "10000"]


def vendor_shares(spark: SparkSession, d: str) -> DataFrame:
    """One row: vendors, the share of all rows the ten largest hold, and the median and greatest rows of a vendor."""
    counts = table(spark, d, "market_listings").where("vendor_id is not null").groupBy("vendor_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "vendor_id").limit(10).agg(F.sum("n").alias("top"))
    all_ = counts.agg(F.count("*").alias("vendors"), F.sum("n").alias("rows"), F.median("n").alias("median"), F.max("n").alias("most"))
    return all_.crossJoin(top).select("vendors", F.round(F.col("top") / F.col("rows"), 9).alias("top10_share"), "median", "most")  # one row each


def market_tops(spark: SparkSession, d: str) -> DataFrame:
    """(kind, name, n, place): the ten subcategories, eight price tiers (powers of ten) and eight lanes with most
    rows; ties by name."""
    rows = table(spark, d, "market_listings")
    price = F.col("price_btc_low")
    tier = F.lit(None).cast("string")
    for t in reversed(TIERS):
        tier = F.when(price < float(t), F.lit(f"under {t}")).otherwise(tier)
    tier = F.when((price > 0) & ~F.isnan("price_btc_low"), tier)
    return O.tops([rows.select(F.lit("subcategory").alias("kind"), F.col("subcategory").alias("name")), rows.select(F.lit("price"), tier), rows.select(F.lit("lane"), F.concat_ws("->", F.coalesce("origin", F.lit("")), F.coalesce("dest", F.lit(""))))], {"subcategory": 10, "price": 8, "lane": 8})


def top_sites(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "victims").where("site is not null").groupBy("site").agg(F.count("*").alias("n"), F.count_distinct("victim_id").alias("victims"))
    return rows.orderBy(F.desc("n"), "site").limit(10)


def growth_points(spark: SparkSession, d: str) -> DataFrame:
    """The curve of monthly_growth in at most forty points and the last one."""
    return O.thinned(P.monthly_growth(spark, d), "month", 40)


def group_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Per group the median of the deadlines its operators name, in whole days; 7 where they name none."""
    turns = P._turns(spark, d).where("party = 'operator' and group_name is not null")
    days = turns.groupBy("group_name").agg(F.median(E.deadline_days(F.col("said"))).alias("m"), F.count(E.deadline_days(F.col("said"))).alias("named"))
    return days.select("group_name", "named", F.coalesce(F.floor("m").cast("int"), F.lit(7)).alias("days"))


def chat_authenticity(spark: SparkSession, d: str, usual: float = 0.4) -> DataFrame:
    """Per conversation how many of its tactics are usual for its group (in at least a share of its conversations), and
    whether it is too thin to tell."""
    used = P.chat_tactics(spark, d).select(*P.KEY, "tactic")
    common = P.tactic_frequency(spark, d).where(F.col("frequency") >= usual).select("group_name", "tactic", F.lit(1).alias("usual"))
    per = used.join(common, ["group_name", "tactic"], "left").groupBy(*P.KEY).agg(F.count("*").alias("tactics"), F.count("usual").alias("usual"))
    thin = P.chat_summary(spark, d).select(*P.KEY, "thin")
    return thin.join(per, P.KEY, "left").select(*P.KEY, F.coalesce("tactics", F.lit(0)).alias("tactics"), F.coalesce("usual", F.lit(0)).alias("usual"), "thin")


def timing_verdicts(spark: SparkSession, d: str, least: float = 0.7) -> DataFrame:
    """Per two event types the hours in which each is active, the lag at which they agree most, and whether that is
    aligned."""
    hours = table(spark, d, "events").where("event_type is not null and ts is not null").groupBy("event_type").agg(F.count_distinct(F.floor(F.unix_timestamp("ts") / 3600)).alias("active"))
    best = P.timing_correlation(spark, d).where("best")
    a, b = (hours.select(F.col("event_type").alias(x), F.col("active").alias(f"active_{x}")) for x in "ab")
    return best.join(a, "a").join(b, "b").select("a", "b", "active_a", "active_b", "lag", "r", F.when(F.col("r") >= least, "aligned").otherwise("apart").alias("verdict"))


def operator_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of several handles, numbered op-1, op-2, ... in order of their sorted members."""
    clusters = M.operator_clusters(spark, d).where("size > 1").select("cluster", "size", "confidence").distinct()
    return numbered(clusters, "cluster").select(F.concat(F.lit("op-"), "n").alias("op"), "cluster", "size", "confidence")


QUERIES = {f.__name__: f for f in (vendor_shares, market_tops, top_sites, growth_points, group_deadlines, chat_authenticity, timing_verdicts, operator_numbers)}

SQL = {
    "vendor_shares": """WITH c AS (SELECT vendor_id, count(*) AS n FROM market_listings WHERE vendor_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS vendors, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, vendor_id LIMIT 10)) / sum(n), 9) AS top10_share, median(n) AS median, max(n) AS most FROM c""",
    "market_tops": f"""WITH r AS (SELECT 'subcategory' AS kind, subcategory AS name, 10 AS k FROM market_listings
UNION ALL SELECT 'price', CASE WHEN price_btc_low > 0 AND NOT isnan(price_btc_low) THEN CASE {" ".join(f"WHEN price_btc_low < {t}::DOUBLE THEN 'under {t}'" for t in TIERS)} END END, 8 FROM market_listings
UNION ALL SELECT 'lane', coalesce(origin, '') || '->' || coalesce(dest, ''), 8 FROM market_listings),
c AS (SELECT kind, name, any_value(k) AS k, count(*) AS n FROM r WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT kind, name, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM c QUALIFY place <= k""",
    "top_sites": "SELECT site, count(*) AS n, count(DISTINCT victim_id) AS victims FROM victims WHERE site IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "growth_points": f"""WITH g AS ({P.SQL["monthly_growth"]}), r AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS k FROM g)
SELECT month, n, total FROM r WHERE i % greatest(1, ceil(k / 40)::INT) = 0 OR i = k - 1""",
    "group_deadlines": P._TURNS + "SELECT group_name, count(days) AS named, coalesce(floor(median(days))::INT, 7) AS days FROM turns WHERE party = 'operator' AND group_name IS NOT NULL GROUP BY 1",
    "chat_authenticity": P._SUMMARY.replace("WITH m AS", "WITH m AS", 1)
    + ", "
    + P._TACTICS[len(P._TURNS) + 2 :]
    + """, u AS (SELECT group_name, tactic, count(*) AS chats FROM tags GROUP BY ALL), a AS (SELECT group_name, count(DISTINCT chat_id) AS n FROM turns GROUP BY 1),
c AS (SELECT group_name, tactic FROM u JOIN a USING (group_name) WHERE round(chats / n, 6) >= 0.4),
p AS (SELECT group_name, chat_id, count(*) AS tactics, count(c.tactic) AS usual FROM tags t LEFT JOIN c USING (group_name, tactic) GROUP BY ALL)
SELECT group_name, chat_id, coalesce(tactics, 0) AS tactics, coalesce(usual, 0) AS usual, operator_turns < 4 AS thin FROM sums LEFT JOIN p USING (group_name, chat_id)""",
    "timing_verdicts": f"""WITH t AS ({P.SQL["timing_correlation"]}), v AS (SELECT event_type, count(DISTINCT floor(epoch(ts) / 3600)) AS active FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
SELECT a, b, x.active AS active_a, y.active AS active_b, lag, r, CASE WHEN r >= 0.7 THEN 'aligned' ELSE 'apart' END AS verdict FROM t JOIN v x ON a = x.event_type JOIN v y ON b = y.event_type WHERE best""",
    "operator_numbers": f"""WITH o AS ({M.SQL["operator_clusters"]}), c AS (SELECT DISTINCT cluster, size, confidence FROM o WHERE size > 1)
SELECT 'op-' || row_number() OVER (ORDER BY cluster) AS op, cluster, size, confidence FROM c""",
}
