"""Queries over feeds: market listings, victim pages, chats and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.functions import fields as E
from corroborate.functions import names as N
from corroborate.operators import feeds as O
from corroborate.operators import leak as L
from corroborate.sources.tables import table


def prolific_vendors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "market_listings").groupBy("vendor_id").agg(F.count_distinct("list_id").alias("n_listings")).where("vendor_id is not null").orderBy(F.desc("n_listings"), "vendor_id").limit(50)


def vendor_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_listings").where("vendor_id is not null")
    return rows.groupBy("vendor_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("list_id").alias("n_listings"),
        F.count_distinct("subcategory").alias("n_subcategories"),
        F.array_join(F.slice(F.array_sort(F.collect_set("origin")), 1, 6), ",").alias("origins"),
        F.min("list_date").alias("first_date"),
        F.max("list_date").alias("last_date"),
        F.sum("n_feedback").alias("total_feedback"),
        F.try_divide(F.sum("fb_pos"), F.sum("fb_pos") + F.sum("fb_neg")).alias("positive_rate"),
    )


def vendor_concentration(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "market_listings").where("vendor_id is not null").groupBy("vendor_id").agg(F.count("*").alias("n"))
    return O.lorenz(counts, "vendor_id").withColumn("share", F.round("share", 9))


def shipping_lanes(spark: SparkSession, d: str) -> DataFrame:
    lane = F.concat(N.clean_place(F.col("origin")), F.lit("->"), N.clean_place(F.col("dest")))
    return table(spark, d, "market_listings").groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


def multi_origin_vendors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "market_listings").where("vendor_id is not null").groupBy("vendor_id").agg(F.count_distinct("origin").alias("n_origins")).where("n_origins > 1")


def bait_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_listings").select("list_id", "category", F.col("price_btc_low").alias("price"), "loaded_at")
    return O.below_median(rows, "category", "price", 0.5).groupBy("category", "median").agg(F.count("*").alias("n_rows"), F.count_distinct("list_id").alias("n_listings"))


def feedback_velocity(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "market_listings").where("vendor_id is not null and list_date is not null").groupBy("vendor_id").agg(F.min("list_date").alias("joined"), F.sum("n_feedback").alias("feedback"))
    months = N.months_between_parts(F.col("joined"), 2026, 7, 30)
    return per.select("vendor_id", "joined", "feedback", F.round(F.col("feedback") / months, 6).alias("per_month"))


def listing_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Of every listing captured more than once, the capture in file order that counts."""
    w = Window.partitionBy("listing_id").orderBy("file_name", "rec_id")
    rows = table(spark, d, "listings").where("listing_id is not null").withColumns({"n": F.row_number().over(w), "captures": F.count("*").over(Window.partitionBy("listing_id"))})
    return rows.where("n = 1 and captures > 1").select("listing_id", "rec_id", "file_name", "captures")


def price_texts(spark: SparkSession, d: str) -> DataFrame:
    p = N.price_range(F.col("price_text"))
    rows = table(spark, d, "listings").select("rec_id", p.alias("p"), F.regexp_extract("price_text", r"([0-9.]+)[ \t]*([A-Z]{3})", 2).alias("unit"))
    return rows.select("rec_id", "p.low", "p.high", E.none_if_empty(F.col("unit")).alias("unit"))


def site_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "victims").where("site is not null").withColumn("day", F.to_date("captured_at"))
    return rows.groupBy("site").agg(F.count("*").alias("n_posts"), F.count_distinct("victim_id").alias("n_victims"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("bigint").alias("active_days"))


def reposts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "victims").where("victim_id is not null").groupBy("victim_id").agg(F.count("*").alias("n"), F.count_distinct("site").alias("n_sites")).where("n > 1")


def weekly_bursts(spark: SparkSession, d: str) -> DataFrame:
    weeks = table(spark, d, "victims").where("captured_at is not null").groupBy(N.week_label(F.to_date("captured_at")).alias("week")).agg(F.count("*").alias("n"))
    return O.bursts(weeks).select("week", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "burst")


def weekly_parity(spark: SparkSession, d: str) -> DataFrame:
    """Weeks labelled with the calendar year, as a parity check beside weekly_bursts."""
    return table(spark, d, "victims").where("captured_at is not null").groupBy(N.week_label(F.to_date("captured_at"), parity=True).alias("week")).agg(F.count("*").alias("n"))


def monthly_growth(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "victims").where("captured_at is not null").groupBy(F.date_format("captured_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return O.running_total(months, "month")


def victim_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return O.taxonomy(table(spark, d, "victims"), "victim_id", "site")


def feed_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "victims").withColumn("day", F.to_date("captured_at"))
    total = rows.agg(F.count("*").alias("posts"), F.count_distinct("victim_id").alias("victims"), F.count_distinct("site").alias("sites"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"))
    per = rows.where("victim_id is not null").groupBy("victim_id").agg(F.count("*").alias("n"), F.count_distinct("site").alias("g"))
    rates = per.agg(F.avg((F.col("n") > 1).cast("int")).alias("repost_rate"), F.avg((F.col("g") > 1).cast("int")).alias("cross_rate"))
    months = rows.groupBy(F.date_format("captured_at", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).agg(F.floor(F.median("n")).alias("median_month"))
    one = total.crossJoin(rates).crossJoin(months)
    return one.select("posts", "victims", "sites", F.round(F.col("posts") / F.col("days"), 6).alias("posts_per_day"), F.round("repost_rate", 6).alias("repost_rate"), F.round("cross_rate", 6).alias("cross_rate"), "median_month")


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Each capture of a victim on a site beside the one before it: status transition, and whether the deadline slid."""
    w = Window.partitionBy("victim_id", "site").orderBy("captured_at", "rec_id")
    day = N.parse_day(F.col("deadline"))
    rows = table(spark, d, "victims").where("victim_id is not null and site is not null").withColumn("day", day)
    rows = rows.withColumns({"from_status": F.lag("status").over(w), "from_day": F.lag("day").over(w), "before": F.lag("rec_id").over(w)}).where("before is not null")
    step = F.when(F.col("status") == "published", "published").when(F.col("status") == "withdrawn", "withdrawn").when(~F.col("status").eqNullSafe(F.col("from_status")), "escalated").otherwise("stable")
    return rows.select("rec_id", F.col("before").alias("before_rec_id"), step.alias("transition"), F.coalesce(F.col("day") > F.col("from_day"), F.lit(False)).alias("deadline_slid"))


def repost_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Victims on several sites: whether the entries copy each other, and whether they claim the same."""
    last = F.max_by(F.struct("org", "sector", "country", "proof", "claimed_gb"), F.struct("captured_at", "rec_id"))
    one = table(spark, d, "victims").where("victim_id is not null and site is not null").groupBy("victim_id", "site").agg(last.alias("r"))
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "r.org", "r.sector", "r.country", "r.proof")), " "))
    return L.repost_verdicts(one.select("victim_id", "site", words.alias("words"), F.col("r.claimed_gb").cast("string").alias("claim"))).withColumn("similarity", F.round("similarity", 6))


def latest_market_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of every list_id the row loaded last, ties to the greater price."""
    last = F.max_by(F.struct("vendor_id", "category", "list_date"), F.struct("loaded_at", F.coalesce(F.nanvl("price_btc_low", F.lit(-1.0)), F.lit(-1.0)), "vendor_id", "list_date"))
    return table(spark, d, "market_listings").where("list_id is not null").groupBy("list_id").agg(last.alias("r"), F.count("*").alias("n_rows")).select("list_id", "r.vendor_id", "r.list_date", "n_rows")


# --- chats -------------------------------------------------------------------------------------------------------

FINAL = r"(?i)final (price|offer)|not lower"
KEY = ["group_name", "chat_id"]


def _turns(spark, d):
    said = E.unquoted(F.col("content"))
    rows = table(spark, d, "messages").where("content is not null").select("msg_id", *KEY, "seq", E.party_of(F.col("party")).alias("party"), said.alias("said"))
    first = rows.groupBy(*KEY, "seq").agg(F.min_by(F.struct("msg_id", "party", "said"), "msg_id").alias("r")).select(*KEY, "seq", "r.*")
    return first.where(F.trim("said") != "").withColumn("figure", F.array_max(E.figures(F.col("said"))))


def turn_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("content is not null").select("msg_id", E.figures(F.col("content")).alias("f"), E.deadline_days(F.col("content")).alias("deadline_days"))
    return rows.select("msg_id", F.size("f").cast("bigint").alias("n_figures"), F.array_max("f").alias("top_figure"), "deadline_days").where("n_figures > 0 or deadline_days is not null")


def chat_tactics(spark: SparkSession, d: str) -> DataFrame:
    """How often each tactic is used in each conversation by the operator."""
    ops = _turns(spark, d).where("party = 'operator'")
    return ops.select(*KEY, F.explode(E.tagged(F.col("said"), E.TURN_TACTICS)).alias("tactic")).groupBy(*KEY, "tactic").agg(F.count("*").alias("n"))


def tactic_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Per group the share of its conversations in which each tactic occurs, and the three most frequent."""
    used = chat_tactics(spark, d).groupBy("group_name", "tactic").agg(F.count("*").alias("chats"))
    all_ = _turns(spark, d).select(*KEY).distinct().groupBy("group_name").agg(F.count("*").alias("n"))
    freq = used.join(all_, "group_name").select("group_name", "tactic", F.round(F.col("chats") / F.col("n"), 6).alias("frequency"), "chats")
    rank = F.row_number().over(Window.partitionBy("group_name").orderBy(F.desc("chats"), "tactic"))
    return freq.withColumn("rank", rank).select("group_name", "tactic", "frequency", (F.col("rank") <= 3).alias("top3"))


def demand_staircase(spark: SparkSession, d: str) -> DataFrame:
    return O.staircase(_turns(spark, d).where("party = 'operator'"), KEY, "seq", "figure").select(*KEY, "seq", "figure", "step")


def final_bluffs(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).where("party = 'operator'").withColumn("final", F.col("said").rlike(FINAL))
    return O.final_then_lower(turns, KEY, "seq", "figure", "final")


def deadline_theatre(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in which at least three turns of any party follow the operator's first deadline."""
    mark = (F.col("party") == "operator") & E.deadline_days(F.col("said")).isNotNull()
    return O.turns_after(_turns(spark, d).withColumn("mark", mark), KEY, "seq", "mark")


def chat_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: turns by party, first demand (the greatest of the first three figures), least figure, and the
    outcome: settled if any turn says so, else published, else ongoing."""
    t = _turns(spark, d)
    op = F.col("party") == "operator"
    outcome = F.max(F.when(F.col("said").rlike("(?i)settle"), 2).when(F.col("said").rlike("(?i)publish|page goes up"), 1).otherwise(0))
    figures = F.sort_array(F.collect_list(F.when(op & F.col("figure").isNotNull(), F.struct("seq", "figure"))))
    agg = t.groupBy(*KEY).agg(F.count_if(op).alias("operator_turns"), F.count_if(~op).alias("victim_turns"), F.slice(figures, 1, 3).alias("f"), F.min(F.when(op, F.col("figure"))).alias("floor"), outcome.alias("o"))
    names = F.when(F.col("o") == 2, "settled").when(F.col("o") == 1, "published").otherwise("ongoing")
    return agg.select(*KEY, "operator_turns", "victim_turns", F.array_max(F.transform("f", lambda x: x["figure"])).alias("first_demand"), "floor", names.alias("outcome"), (F.col("operator_turns") < 4).alias("thin"))


def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["settled", "published", "ongoing"]
    wide = chat_summary(spark, d).groupBy("group_name").pivot("outcome", kinds).count()
    n = {k: F.coalesce(F.col(k), F.lit(0)) for k in kinds}
    return wide.select("group_name", *[n[k].alias(k) for k in kinds], F.round(n["settled"] / sum(n.values(), F.lit(0)), 6).alias("settled_share"))


def group_demands(spark: SparkSession, d: str) -> DataFrame:
    per = chat_summary(spark, d).where("first_demand is not null").groupBy("group_name").agg(F.min("first_demand").alias("least"), F.floor(F.median("first_demand")).alias("middle"), F.max("first_demand").alias("most"))
    floor = F.least(F.greatest(F.floor(0.25 * F.col("middle")), F.col("least")), F.col("middle"))
    return per.select("group_name", "least", "middle", "most", floor.alias("floor"))


def scrubbed_documents(spark: SparkSession, d: str) -> DataFrame:
    """How many personal details of each kind are taken out of every text (the step on digit runs excepted)."""
    s = E.scrub(F.col("text"), digits=False)
    marks = {k: F.regexp_count(F.col("s"), F.lit(rf"\[{k}\]")) for k in ("email", "url", "ip", "wallet")}
    return table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("s")).select("doc_id", *[v.cast("bigint").alias(f"n_{k}") for k, v in marks.items()])


def negotiation_arcs(spark: SparkSession, d: str) -> DataFrame:
    a = E.parse_arc(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null and source = 'negotiation'").select("doc_id", a.alias("a"))
    return rows.select("doc_id", "a.brand", "a.outcome", F.array_join("a.tactics", ",").alias("tactics"), F.size("a.offers").cast("bigint").alias("n_offers"), "a.settlement")


# --- rhythm and timing -------------------------------------------------------------------------------------------


def hourly_rhythm(spark: SparkSession, d: str) -> DataFrame:
    """How alike the hours of day are at which two groups write (cosine of 24 counts, rounded to 3 places)."""
    counts = table(spark, d, "messages").where("group_name is not null and sent_at is not null").groupBy("group_name", F.hour("sent_at").alias("h")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("group_name").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    a, b = counts.select(F.col("group_name").alias("a"), "h", F.col("n").alias("x")), counts.select(F.col("group_name").alias("b"), "h", F.col("n").alias("y"))
    dot = a.join(b, "h").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    full = dot.join(norm.select(F.col("group_name").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("group_name").alias("b"), F.col("norm").alias("nb")), "b")
    return full.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


def timing_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Every two event types' hourly counts, each shifted by up to 8 hours, and the lag at which they agree most."""
    hours = table(spark, d, "events").where("event_type is not null and ts is not null").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("bucket")).agg(F.count("*").alias("n"))
    out = O.lagged_correlations(hours, "event_type", "bucket", "n")
    best = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.round("r", 9)), "lag"))
    return out.withColumn("n", best).select("a", "b", "lag", "pairs", F.round("r", 6).alias("r"), (F.col("n") == 1).alias("best"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events per user in sessions that end after half an hour without one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    rows = table(spark, d, "events").where("user_id is not null and ts is not null").withColumn("new", (F.coalesce(gap, F.lit(10**9)) > 1800).cast("int"))
    return rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


QUERIES = {
    f.__name__: f
    for f in (
        prolific_vendors, vendor_profiles, vendor_concentration, shipping_lanes, multi_origin_vendors, bait_prices, feedback_velocity, listing_revisions, price_texts,
        site_summary, reposts, weekly_bursts, weekly_parity, monthly_growth, victim_taxonomy, feed_stats, lifecycle, repost_verdicts, latest_market_rows, turn_figures, chat_tactics, tactic_frequency,
        demand_staircase, final_bluffs, deadline_theatre, chat_summary, outcome_pivot, group_demands, scrubbed_documents, negotiation_arcs, hourly_rhythm,
        timing_correlation, event_sessions,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------


def _place(c: str) -> str:
    s = rf"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\r\f]+', ' ', 'g'))"
    title = f"array_to_string(list_transform(string_split(lower({s}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
    return f"CASE WHEN lower({s}) IN ('', 'na', 'n/a', 'none', '-') THEN 'Unknown' WHEN lower({s}) IN ('usa', 'eu', 'uk', 'us') THEN upper({s}) ELSE {title} END"


_FIG = r"""list_transform(list_filter(list_transform(regexp_extract_all({t}, '\$?[ \t\n]?[0-9][0-9,.]{{2,}}[ \t\n]*(?:usd|k|mil|million|m|btc)?'),
  lambda m: CASE WHEN ends_with(m, 'btc') THEN NULL ELSE try_cast(replace(regexp_extract(m, '([0-9][0-9,.]{{2,}})', 1), ',', '') AS DOUBLE) *
    CASE WHEN ends_with(m, 'k') THEN 1e3 WHEN ends_with(m, 'mil') OR ends_with(m, 'million') OR ends_with(m, 'm') THEN 1e6 ELSE 1 END END),
  lambda v: v IS NOT NULL AND v >= 1000 AND v <= 100000000), lambda v: floor(v)::BIGINT)"""
_DAYS = r"try_cast(regexp_extract(lower({t}), '(?:^|[^0-9a-z_])([0-9]{{1,2}})[ \t\n]*days?(?:$|[^0-9a-z_])', 1) AS INT)"
_TURNS = (
    r"""WITH m AS (SELECT msg_id, group_name, chat_id, seq, CASE WHEN lower(trim(party)) = 'victim' THEN 'victim' ELSE 'operator' END AS party,
  regexp_replace(content, '^[ \t\n\r\f]*>[ \t]?', '') AS said FROM messages WHERE content IS NOT NULL),
turns AS (SELECT *, list_max("""
    + _FIG.format(t="lower(said)")
    + r""") AS figure, """
    + _DAYS.format(t="said")
    + r""" AS days FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY group_name, chat_id, seq ORDER BY msg_id) = 1) WHERE trim(said) <> '')
"""
)
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, '(?i){p}') THEN '{k}' END" for k, p in sorted(E.TURN_TACTICS.items())) + "], lambda x: x IS NOT NULL)"
_TACTICS = _TURNS + f", tags AS (SELECT group_name, chat_id, tactic, count(*) AS n FROM (SELECT group_name, chat_id, unnest({_TAGS}) AS tactic FROM turns WHERE party = 'operator') GROUP BY ALL)"
_SUMMARY = (
    _TURNS
    + """, sums AS (SELECT group_name, chat_id, count(*) FILTER (party = 'operator') AS operator_turns, count(*) FILTER (party <> 'operator') AS victim_turns,
  list_max(list_slice(list(figure ORDER BY seq) FILTER (party = 'operator' AND figure IS NOT NULL), 1, 3)) AS first_demand, min(figure) FILTER (party = 'operator') AS floor,
  CASE max(CASE WHEN regexp_matches(said, '(?i)settle') THEN 2 WHEN regexp_matches(said, '(?i)publish|page goes up') THEN 1 ELSE 0 END) WHEN 2 THEN 'settled' WHEN 1 THEN 'published' ELSE 'ongoing' END AS outcome
  FROM turns GROUP BY ALL)"""
)
_WEEK = "strftime(captured_at, '{y}-W%V')"
_ARC_OP = r"array_to_string(list_transform(regexp_extract_all(text, '(?i)operator:[ \t\n\r\f]*[^\n]+'), lambda x: regexp_extract(x, '(?i)operator:[ \t\n\r\f]*([^\n]+)', 1)), ' ')"
_ARC_TAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(op, '(?i){p}') THEN '{k}' END" for k, p in sorted(E.ARC_TACTICS.items())) + "], lambda x: x IS NOT NULL), ',')"


def _scrub() -> str:
    s = "text"
    for pattern, mark in E.SCRUBS:
        s = f"regexp_replace({s}, '{pattern}', '{mark}', 'g')"
    return s


SQL = {
    "prolific_vendors": "SELECT vendor_id, count(DISTINCT list_id) AS n_listings FROM market_listings WHERE vendor_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "vendor_profiles": """SELECT vendor_id, count(*) AS n_rows, count(DISTINCT list_id) AS n_listings, count(DISTINCT subcategory) AS n_subcategories,
  array_to_string(list_slice(list_sort(list(DISTINCT origin) FILTER (origin IS NOT NULL)), 1, 6), ',') AS origins, min(list_date) AS first_date, max(list_date) AS last_date,
  sum(n_feedback)::BIGINT AS total_feedback, sum(fb_pos) / nullif(sum(fb_pos) + sum(fb_neg), 0) AS positive_rate FROM market_listings WHERE vendor_id IS NOT NULL GROUP BY 1""",
    "vendor_concentration": """WITH c AS (SELECT vendor_id, count(*) AS n FROM market_listings WHERE vendor_id IS NOT NULL GROUP BY 1)
SELECT vendor_id, n, row_number() OVER w AS rank, round((sum(n) OVER w) / (sum(n) OVER ()), 9) AS share FROM c WINDOW w AS (ORDER BY n DESC, vendor_id ROWS UNBOUNDED PRECEDING)""",
    "shipping_lanes": f"SELECT {_place('origin')} || '->' || {_place('dest')} AS lane, count(*) AS n FROM market_listings GROUP BY 1",
    "multi_origin_vendors": "SELECT vendor_id, count(DISTINCT origin) AS n_origins FROM market_listings WHERE vendor_id IS NOT NULL GROUP BY 1 HAVING n_origins > 1",
    "bait_prices": """WITH g AS (SELECT list_id, category, price_btc_low AS p FROM market_listings WHERE category IS NOT NULL AND price_btc_low IS NOT NULL AND NOT isnan(price_btc_low)),
m AS (SELECT category, median(p) AS median FROM g GROUP BY 1) SELECT category, median, count(*) AS n_rows, count(DISTINCT list_id) AS n_listings FROM g JOIN m USING (category) WHERE p < 0.5 * median GROUP BY 1, 2""",
    "feedback_velocity": """WITH v AS (SELECT vendor_id, min(list_date) AS joined, sum(n_feedback)::BIGINT AS feedback FROM market_listings WHERE vendor_id IS NOT NULL AND list_date IS NOT NULL GROUP BY 1)
SELECT vendor_id, joined, feedback, round(feedback / greatest((2026 - substr(joined, 1, 4)::INT) * 12 + (7 - substr(joined, 6, 2)::INT) + (30 - substr(joined, 9, 2)::INT) / 30.0, 0.5), 6) AS per_month FROM v""",
    "listing_revisions": """SELECT listing_id, rec_id, file_name, count(*) OVER (PARTITION BY listing_id) AS captures FROM listings WHERE listing_id IS NOT NULL
QUALIFY captures > 1 AND row_number() OVER (PARTITION BY listing_id ORDER BY file_name, rec_id) = 1""",
    "price_texts": r"""WITH n AS (SELECT rec_id, price_text, regexp_extract_all(lower(coalesce(price_text, '')), '[-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?') AS x FROM listings)
SELECT rec_id, CASE WHEN len(x) >= 2 THEN try_cast(x[1] AS DOUBLE) END AS low, CASE WHEN len(x) >= 2 THEN try_cast(x[2] AS DOUBLE) END AS high, nullif(regexp_extract(price_text, '([0-9.]+)[ \t]*([A-Z]{3})', 2), '') AS unit FROM n""",
    "site_summary": """SELECT site, count(*) AS n_posts, count(DISTINCT victim_id) AS n_victims, min(captured_at)::DATE AS first_day, max(captured_at)::DATE AS last_day,
  datediff('day', min(captured_at)::DATE, max(captured_at)::DATE) + 1 AS active_days FROM victims WHERE site IS NOT NULL GROUP BY 1""",
    "reposts": "SELECT victim_id, count(*) AS n, count(DISTINCT site) AS n_sites FROM victims WHERE victim_id IS NOT NULL GROUP BY 1 HAVING n > 1",
    "weekly_bursts": f"""WITH w AS (SELECT {_WEEK.format(y="%G")} AS week, count(*) AS n FROM victims WHERE captured_at IS NOT NULL GROUP BY 1), s AS (SELECT avg(n) AS mean, stddev_pop(n) AS sd FROM w)
SELECT week, n, round(mean, 6) AS mean, round(sd, 6) AS sd, n > mean + 2 * sd AS burst FROM w, s""",
    "weekly_parity": f"SELECT {_WEEK.format(y='%Y')} AS week, count(*) AS n FROM victims WHERE captured_at IS NOT NULL GROUP BY 1",
    "monthly_growth": "SELECT month, n, (sum(n) OVER (ORDER BY month))::BIGINT AS total FROM (SELECT strftime(captured_at, '%Y-%m') AS month, count(*) AS n FROM victims WHERE captured_at IS NOT NULL GROUP BY 1)",
    "victim_taxonomy": """SELECT count(*) AS new_items, sum(n - 1)::BIGINT AS reposts, sum(g - 1)::BIGINT AS cross_group
FROM (SELECT victim_id, count(*) AS n, count(DISTINCT site) AS g FROM victims WHERE victim_id IS NOT NULL AND site IS NOT NULL GROUP BY 1)""",
    "feed_stats": """WITH p AS (SELECT victim_id, count(*) AS n, count(DISTINCT site) AS g FROM victims WHERE victim_id IS NOT NULL GROUP BY 1),
m AS (SELECT floor(median(n))::BIGINT AS median_month FROM (SELECT strftime(captured_at, '%Y-%m') AS m, count(*) AS n FROM victims GROUP BY 1)),
t AS (SELECT count(*) AS posts, count(DISTINCT victim_id) AS victims, count(DISTINCT site) AS sites, datediff('day', min(captured_at)::DATE, max(captured_at)::DATE) + 1 AS days FROM victims)
SELECT posts, t.victims, sites, round(posts / days, 6) AS posts_per_day, round((SELECT avg((n > 1)::INT) FROM p), 6) AS repost_rate, round((SELECT avg((g > 1)::INT) FROM p), 6) AS cross_rate, median_month FROM t, m""",
    "lifecycle": r"""WITH v AS (SELECT rec_id, victim_id, site, status, captured_at, try_cast(regexp_extract(trim(deadline), '^(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS day FROM victims WHERE victim_id IS NOT NULL AND site IS NOT NULL),
l AS (SELECT *, lag(status) OVER w AS s0, lag(day) OVER w AS d0, lag(rec_id) OVER w AS r0 FROM v WINDOW w AS (PARTITION BY victim_id, site ORDER BY captured_at, rec_id))
SELECT rec_id, r0 AS before_rec_id, CASE WHEN status = 'published' THEN 'published' WHEN status = 'withdrawn' THEN 'withdrawn' WHEN status IS DISTINCT FROM s0 THEN 'escalated' ELSE 'stable' END AS transition,
  coalesce(day > d0, false) AS deadline_slid FROM l WHERE r0 IS NOT NULL""",
    "repost_verdicts": """WITH o AS (SELECT victim_id, site, list_distinct(string_split(lower(concat_ws(' ', org, sector, country, proof)), ' ')) AS w, claimed_gb AS c FROM victims WHERE victim_id IS NOT NULL AND site IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY victim_id, site ORDER BY captured_at DESC, rec_id DESC) = 1),
p AS (SELECT a.victim_id, a.site AS site_a, b.site AS site_b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j, a.c AS ca, b.c AS cb FROM o a JOIN o b ON a.victim_id = b.victim_id AND a.site < b.site)
SELECT victim_id, site_a, site_b, round(j, 6) AS similarity, CASE WHEN ca IS NOT DISTINCT FROM cb THEN 'mirror' ELSE 'clone' END AS verdict FROM p WHERE j >= 0.5""",
    "latest_market_rows": """SELECT list_id, vendor_id, list_date, count(*) OVER (PARTITION BY list_id) AS n_rows FROM market_listings WHERE list_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY loaded_at DESC, CASE WHEN price_btc_low IS NULL OR isnan(price_btc_low) THEN -1 ELSE price_btc_low END DESC, vendor_id DESC NULLS LAST, list_date DESC NULLS LAST) = 1""",
    "turn_figures": "WITH f AS (SELECT msg_id, " + _FIG.format(t="lower(content)") + " AS f, " + _DAYS.format(t="content") + " AS deadline_days FROM messages WHERE content IS NOT NULL) SELECT msg_id, len(f) AS n_figures, list_max(f) AS top_figure, deadline_days FROM f WHERE len(f) > 0 OR deadline_days IS NOT NULL",
    "chat_tactics": _TACTICS + " SELECT * FROM tags",
    "tactic_frequency": _TACTICS + """, u AS (SELECT group_name, tactic, count(*) AS chats FROM tags GROUP BY ALL), a AS (SELECT group_name, count(DISTINCT chat_id) AS n FROM turns GROUP BY 1)
SELECT group_name, tactic, round(chats / n, 6) AS frequency, row_number() OVER (PARTITION BY group_name ORDER BY chats DESC, tactic) <= 3 AS top3 FROM u JOIN a USING (group_name)""",
    "demand_staircase": _TURNS + """, s AS (SELECT *, min(figure) OVER (PARTITION BY group_name, chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM turns WHERE party = 'operator' AND figure IS NOT NULL)
SELECT group_name, chat_id, seq, figure, row_number() OVER (PARTITION BY group_name, chat_id ORDER BY seq) AS step FROM s WHERE low IS NULL OR figure < low""",
    "final_bluffs": _TURNS + f""", o AS (SELECT * FROM turns WHERE party = 'operator' AND figure IS NOT NULL),
f AS (SELECT group_name, chat_id, min(seq) AS final_at, arg_min(figure, seq) AS final_value FROM o WHERE regexp_matches(said, '{FINAL}') GROUP BY ALL)
SELECT group_name, chat_id, final_at, final_value, min(seq) AS lower_at, arg_min(figure, seq) AS lower_value FROM o JOIN f USING (group_name, chat_id) WHERE seq > final_at AND figure < final_value GROUP BY ALL""",
    "deadline_theatre": _TURNS + """, f AS (SELECT group_name, chat_id, min(seq) AS first_at FROM turns WHERE party = 'operator' AND days IS NOT NULL GROUP BY ALL)
SELECT group_name, chat_id, first_at AS at, count(*) AS after FROM turns JOIN f USING (group_name, chat_id) WHERE seq > first_at GROUP BY ALL HAVING count(*) >= 3""",
    "chat_summary": _SUMMARY + " SELECT *, operator_turns < 4 AS thin FROM sums",
    "outcome_pivot": _SUMMARY + """ SELECT group_name, count(*) FILTER (outcome = 'settled') AS settled, count(*) FILTER (outcome = 'published') AS published, count(*) FILTER (outcome = 'ongoing') AS ongoing,
  round(count(*) FILTER (outcome = 'settled') / count(*), 6) AS settled_share FROM sums GROUP BY 1""",
    "group_demands": _SUMMARY + """, g AS (SELECT group_name, min(first_demand) AS least, floor(median(first_demand))::BIGINT AS middle, max(first_demand) AS most FROM sums WHERE first_demand IS NOT NULL GROUP BY 1)
SELECT *, least(greatest(floor(0.25 * middle)::BIGINT, least), middle) AS floor FROM g""",
    "scrubbed_documents": f"""WITH s AS (SELECT doc_id, {_scrub()} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(regexp_extract_all(s, '\\[email\\]')) AS n_email, len(regexp_extract_all(s, '\\[url\\]')) AS n_url, len(regexp_extract_all(s, '\\[ip\\]')) AS n_ip, len(regexp_extract_all(s, '\\[wallet\\]')) AS n_wallet FROM s""",
    "negotiation_arcs": rf"""WITH a AS (SELECT doc_id, text, {_ARC_OP} AS op FROM documents WHERE text IS NOT NULL AND source = 'negotiation')
SELECT doc_id, nullif(trim(regexp_extract(text, '(?im)^brand:[ \t]*([^\n]+)$', 1), ' '), '') AS brand,
  CASE WHEN regexp_matches(text, '(?i)\[settlement\]|settled') THEN 'settled' WHEN regexp_matches(text, '(?i)published') THEN 'published' WHEN regexp_matches(text, '(?i)ongoing') THEN 'ongoing' ELSE 'unknown' END AS outcome,
  {_ARC_TAGS} AS tactics, len(regexp_extract_all(text, '[0-9]+[ \t\n\r\f]*BTC')) AS n_offers, try_cast(regexp_extract(text, '(?i)\[settlement\][ \t\n]*([0-9]+)[ \t\n]*BTC', 1) AS INT) AS settlement FROM a""",
    "hourly_rhythm": """WITH c AS (SELECT group_name, hour(sent_at) AS h, count(*) AS n FROM messages WHERE group_name IS NOT NULL AND sent_at IS NOT NULL GROUP BY ALL), m AS (SELECT group_name, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT a.group_name AS a, b.group_name AS b, round(sum(a.n * b.n) / (any_value(ma.norm) * any_value(mb.norm)), 6) AS similarity FROM c a JOIN c b ON a.h = b.h AND a.group_name < b.group_name
JOIN m ma ON a.group_name = ma.group_name JOIN m mb ON b.group_name = mb.group_name GROUP BY 1, 2""",
    "timing_correlation": """WITH h AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT event_type FROM h), s AS (SELECT DISTINCT bucket FROM h), f AS (SELECT k.event_type, s.bucket, coalesce(h.n, 0) AS n FROM k CROSS JOIN s LEFT JOIN h ON h.event_type = k.event_type AND h.bucket = s.bucket),
p AS (SELECT a.event_type AS a, b.event_type AS b, lag, count(*) AS pairs, sum(a.n) AS sx, sum(b.n) AS sy, sum(a.n * b.n) AS sxy, sum(a.n * a.n) AS sxx, sum(b.n * b.n) AS syy
  FROM f a, (SELECT unnest(range(-8, 9))::INT AS lag) l, f b WHERE b.bucket = a.bucket + lag AND a.event_type < b.event_type GROUP BY ALL),
r AS (SELECT a, b, lag, pairs, CASE WHEN pairs * sxx > sx * sx AND pairs * syy > sy * sy THEN (pairs * sxy - sx * sy) / (sqrt((pairs * sxx - sx * sx)::DOUBLE) * sqrt((pairs * syy - sy * sy)::DOUBLE)) ELSE 0 END AS r FROM p WHERE pairs >= 4)
SELECT a, b, lag, pairs, round(r, 6) AS r, row_number() OVER (PARTITION BY a, b ORDER BY round(r, 9) DESC, lag) = 1 AS best FROM r""",
    "event_sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) <= 1800 THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""",
}
