"""Queries of the general record problems: quantities in common units (3) and snapshot differences (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.operators.snapshot_diff import canonical_map, snapshot_diff
from corroborate.operators.units import quantities, unit_report
from corroborate.sources.tables import table


#: Words of scale and other currencies, where a figure isn't plain.
WORDY = "(?i)thousand|million|billion|hundred|dollar|euro|pound|bitcoin|monero|btc|xmr|eur|gbp|[$€£₿]"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities(table(spark, d, "messages"), table(spark, d, "victims"), table(spark, d, "unit_rates"), table(spark, d, "source_units"))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return unit_report(table(spark, d, "messages"), table(spark, d, "victims"), table(spark, d, "unit_rates"), table(spark, d, "source_units"))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """The quantities of rows that state them as plain as can be: one figure of US dollars, or one number of GB."""
    plain = table(spark, d, "messages").where(F.col("content").rlike(r"^[^0-9]*[0-9]{5,8} USD[^0-9a-zA-Z]*[a-zA-Z ,.!?]*$") & ~F.col("content").rlike(WORDY)).select(F.lit("messages").alias("src"), F.col("msg_id").alias("rec_id"))
    gb = table(spark, d, "victims").where(F.col("claim_text").rlike("^[0-9]{1,4} GB$")).select(F.lit("victims").alias("src"), "rec_id")
    return p3_found(spark, d).join(plain.unionByName(gb), ["src", "rec_id"], "left_semi")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snapshots").withColumn("site", F.coalesce("site", F.lit("")))
    return snapshot_diff(rows, ["section", "name", "site"], canonical_map(F.col("attrs")))


def p4_alert_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of snapshots and kind of change, how many changed records some alert names."""
    named = table(spark, d, "alerts").where("t_to is not null and name is not null").select("t_to", "name").distinct().withColumn("alerted", F.lit(1))
    found = p4_found(spark, d)
    return (
        found.join(named, ["t_to", "name"], "left")
        .groupBy("t_from", "t_to", "change")
        .agg(F.count("*").alias("n_changes"), F.coalesce(F.sum("alerted"), F.lit(0)).alias("n_alerted"))
    )


QUERIES = {"p3_found": p3_found, "p3_plain": p3_plain, "p3_units": p3_units, "p4_found": p4_found, "p4_alert_coverage": p4_alert_coverage}

_P4 = """
WITH clean AS (
  SELECT t, taken_at, section, name, coalesce(site, '') AS site, loaded_at,
         list_sort(list_filter(map_entries(attrs), lambda e: e.value IS NOT NULL AND e.value NOT IN ('-', '—')))::VARCHAR AS state
  FROM snapshots WHERE t IS NOT NULL),
last AS (
  SELECT t, section, name, site, state FROM clean
  QUALIFY row_number() OVER (PARTITION BY t, section, name, site ORDER BY loaded_at DESC, state DESC) = 1),
steps AS (
  SELECT t AS t_from, lead(t) OVER (ORDER BY first_at, t) AS t_to FROM (SELECT t, min(taken_at) AS first_at FROM snapshots WHERE t IS NOT NULL GROUP BY t)),
old AS (SELECT s.t_from, s.t_to, l.* EXCLUDE (t) FROM last l JOIN steps s ON l.t = s.t_from WHERE s.t_to IS NOT NULL),
new AS (SELECT s.t_from, s.t_to, l.* EXCLUDE (t) FROM last l JOIN steps s ON l.t = s.t_to),
found AS (
  SELECT coalesce(o.t_from, n.t_from) AS t_from, coalesce(o.t_to, n.t_to) AS t_to, coalesce(o.section, n.section) AS section,
         coalesce(o.name, n.name) AS name, coalesce(o.site, n.site) AS site,
         CASE WHEN o.state IS NULL THEN 'added' WHEN n.state IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM old o FULL JOIN new n ON o.t_from = n.t_from AND o.section IS NOT DISTINCT FROM n.section
       AND o.name IS NOT DISTINCT FROM n.name AND o.site = n.site
  WHERE o.state IS DISTINCT FROM n.state)
"""

SQL = {
    "p3_plain": rf"""SELECT 'messages' AS src, msg_id AS rec_id, regexp_extract(content, '([0-9]{{5,8}}) USD', 1)::BIGINT AS qty FROM messages
WHERE regexp_matches(content, '^[^0-9]*[0-9]{{5,8}} USD[^0-9a-zA-Z]*[a-zA-Z ,.!?]*$') AND NOT regexp_matches(content, '{WORDY}')
UNION ALL SELECT 'victims', rec_id, regexp_extract(claim_text, '^([0-9]+)', 1)::BIGINT * 1000 FROM victims WHERE regexp_matches(claim_text, '^[0-9]{{1,4}} GB$')""",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_alert_coverage": _P4
    + """, named AS (SELECT DISTINCT t_to, name FROM alerts WHERE t_to IS NOT NULL AND name IS NOT NULL)
SELECT f.t_from, f.t_to, f.change, count(*) AS n_changes, count(a.name) AS n_alerted
FROM found f LEFT JOIN named a ON f.t_to = a.t_to AND f.name = a.name GROUP BY ALL""",
}
