"""Queries that link profiles, watch snapshots, grade results and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.names import plain_handle
from corroborate.operators import changefeed as C
from corroborate.operators import evidence as V
from corroborate.operators import report as R
from corroborate.operators import scoring as S
from corroborate.operators.components import solve_components
from corroborate.operators.ranking import nearest_by_xor
from corroborate.operators.simjoin import similar_texts
from corroborate.plans.pages import exact_mirrors, near_duplicates
from corroborate.session import cut, spread
from corroborate.sources.tables import table


def _watch(spark: SparkSession, d: str) -> DataFrame:
    """What is watched: keys and wallets of the personas of the first snapshot, and the operators of its sites that are
    down."""
    s = table(spark, d, "snapshots")
    first = s.groupBy("t").agg(F.min("taken_at").alias("at")).orderBy("at", "t").limit(1).select("t")
    rows = s.join(F.broadcast(first), "t", "left_semi")
    p = rows.where("section = 'personas'")
    key = p.select(F.lit("key").alias("kind"), C.attr(F.col("attrs"), "signed_key").alias("value"))
    wallet = p.select(F.lit("wallet").alias("kind"), C.attr(F.col("attrs"), "wallet").alias("value"))
    down = rows.where("section = 'sites'").where(C.attr(F.col("attrs"), "state") == "down").select(F.lit("handle").alias("kind"), C.attr(F.col("attrs"), "operator").alias("value"))
    return key.unionByName(wallet).unionByName(down).where("value is not null and value not in ('-', '—')").distinct()


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return C.change_events(table(spark, d, "snapshots")).select("t_from", "t_to", "klass", "name", "surface")


def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    return C.alerts(table(spark, d, "snapshots"), _watch(spark, d)).orderBy(F.desc("rank"), "t_to", "name")


def alert_grades(spark: SparkSession, d: str) -> DataFrame:
    """The alerts some monitor raised, graded against the alert feed."""
    told = table(spark, d, "alerts").where("t_to is not null and type is not null and name is not null")
    return S.set_scores(C.alerts(table(spark, d, "snapshots"), _watch(spark, d)), told, ["t_to", "type", "name"])


def alert_overclaims(spark: SparkSession, d: str) -> DataFrame:
    """Severities of raised alerts above those of the feed, per alert (its highest where it was raised again)."""
    key = F.concat_ws("|", "t_to", "type", "name").alias("id")
    levels = ["info", "low", "medium", "high", "critical"]
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, i)])
    truth = C.alerts(table(spark, d, "snapshots"), _watch(spark, d)).select(key, F.col("severity").alias("level"), F.try_element_at(rank, F.col("severity")).alias("r")).groupBy("id").agg(F.max_by("level", "r").alias("level"))
    told = table(spark, d, "alerts").where("t_to is not null and type is not null and name is not null and severity is not null").select(key, F.col("severity").alias("level"), F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(-1)).alias("r"))
    return S.overclaims(truth, told.groupBy("id").agg(F.max_by("level", F.struct("r", "level")).alias("level")), levels)


def evidence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.pair_weights(table(spark, d, "edges"))


def framing_flags(spark: SparkSession, d: str) -> DataFrame:
    return V.framing_pairs(V.pair_weights(table(spark, d, "edges")))


def _handles(spark, d):
    return table(spark, d, "edges").select(F.explode(F.array("a", "b")).alias("handle")).where("handle is not null").distinct()


def operator_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.fuse(V.pair_weights(table(spark, d, "edges")), _handles(spark, d))


def linkage_grades(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by hard identifiers alone, graded against those of all evidence."""
    pairs = cut(V.pair_weights(table(spark, d, "edges")))
    handles = cut(_handles(spark, d))
    full = V.fuse(pairs, handles).select(F.col("handle").alias("id"), F.col("cluster").alias("group"))
    hard = V.fuse(pairs.where("hard"), handles).select(F.col("handle").alias("id"), F.col("cluster").alias("group"))
    return S.pair_scores(full, hard)


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every name someone goes by: handles, sellers, authors, parties of chats and personas."""
    by = {"listings": "vendor", "documents": "author", "messages": "party"}
    out = _handles(spark, d)
    for t, c in by.items():
        out = out.unionByName(table(spark, d, t).select(F.col(c).alias("handle")))
    personas = table(spark, d, "snapshots").where("section = 'personas'").select(F.col("name").alias("handle"))
    return out.unionByName(personas).where("handle is not null").distinct()


def handle_twins(spark: SparkSession, d: str) -> DataFrame:
    return V.handle_edges(_names(spark, d)).select("a", "b")


def handle_lookalikes(spark: SparkSession, d: str) -> DataFrame:
    return V.lookalike_handles(_names(spark, d)).select("a", "b")


def plain_handles(spark: SparkSession, d: str) -> DataFrame:
    return _handles(spark, d).select("handle", plain_handle(F.col("handle")).alias("plain"))


def persona_links(spark: SparkSession, d: str) -> DataFrame:
    """Whatever is named in any snapshot beside the least name with the same key, wallet or operator."""
    s = table(spark, d, "snapshots").where("name is not null")
    value = lambda k: F.array_compact(F.array(F.when(~C.attr(F.col("attrs"), k).isin("-", "—"), C.attr(F.col("attrs"), k))))
    p = cut(s.select(F.col("name").alias("handle"), *[value(k).alias(k) for k in ("signed_key", "wallet", "operator")]).where("size(signed_key) + size(wallet) + size(operator) > 0").distinct())
    return V.item_stars(p, "signed_key", "shared_signed_key", 1.0).unionByName(V.item_stars(p, "wallet", "shared_wallet", 1.0)).unionByName(V.item_stars(p, "operator", "shared_operator", 0.8))


def source_style(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null").select("source", "text")
    return V.style_similarity(spread(docs), "source", "text")


def capture_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many fields of a listing's last capture its first one already had right."""
    rows = table(spark, d, "listings").where("listing_id is not null")
    fields = ["title", "vendor", "category", "price", "currency", "ships_from", "ships_to", "terms"]
    pick = lambda f: rows.groupBy("listing_id").agg(f(F.struct(*fields), F.col("rec_id")).alias("r")).select("listing_id", "r.*")
    return S.field_recall(pick(F.max_by), pick(F.min_by), "listing_id", fields)


def duplicate_grades(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies graded against near-duplicate classes, by pairs counted from sizes."""
    near = near_duplicates(spark, d).select(F.col("doc_id").alias("id"), F.col("class_id").alias("group"))
    return S.pair_scores(near, exact_mirrors(spark, d).select("id", F.col("canonical").alias("group")))


def resale_rings(spark: SparkSession, d: str) -> DataFrame:
    """Titles at least 0.8 alike in runs of four characters, offered by more than one vendor."""
    rows = table(spark, d, "listings").where("title is not null and vendor is not null and length(title) >= 8").select(F.lower("title").alias("title"), "vendor")
    seller = F.xxhash64("vendor")
    titles = cut(rows.groupBy("title").agg((F.min(seller) < F.max(seller)).alias("several")).withColumn("id", F.monotonically_increasing_id()))
    pairs = similar_texts(titles.select("id", F.col("title").alias("text")), 0.8)
    roots = cut(solve_components(pairs.select(F.col("x").alias("u"), F.col("y").alias("v"))))
    # a title without a like of it is a ring if it has several vendors; no other titles are looked at again
    members = titles.join(roots, "id", "left").where("several or root is not null").select("id", "title", F.coalesce("root", "id").alias("component"))
    # listings are taken for far smaller than they are and would be broadcast
    named = rows.hint("merge").join(members, "title")
    return named.groupBy("component").agg(F.min("title").alias("ring"), F.count_distinct("vendor").alias("n_vendors"), F.count_distinct("id").alias("n_titles"), F.count("*").alias("n_listings")).where("n_vendors > 1").drop("component")


def nearest_handles(spark: SparkSession, d: str) -> DataFrame:
    return nearest_by_xor(_handles(spark, d), "handle", "corroborate", 20)


def cluster_claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim per cluster of several handles, its basis told from the evidence inside."""
    pairs = cut(V.pair_weights(table(spark, d, "edges")))
    clusters = cut(V.fuse(pairs, _handles(spark, d)).where("size > 1"))
    inside = pairs.join(clusters.select(F.col("handle").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("handle").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    counts = inside.groupBy(F.col("ca").alias("id")).agg(F.count_if("hard").alias("hard"), F.count_if(~F.col("hard") & (F.col("weight") > 0)).alias("soft"))
    basis = R.basis_of(F.col("hard"), F.lit(0), F.col("soft"))
    return counts.select("id", "hard", "soft", basis.alias("basis"), R.confidence(basis).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        change_feed, alert_feed, alert_grades, alert_overclaims, evidence_pairs, framing_flags, operator_clusters, linkage_grades, handle_twins, handle_lookalikes,
        plain_handles, persona_links, source_style, capture_fields, duplicate_grades, resale_rings, nearest_handles, cluster_claims,
    )
}

_EVENTS = """
clean AS (SELECT t, section, name, coalesce(site, '') AS site, loaded_at, list_sort(list_filter(map_entries(attrs), lambda e: e.value IS NOT NULL AND e.value NOT IN ('-', '—'))) AS st FROM snapshots WHERE t IS NOT NULL),
last AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY t, section, name, site ORDER BY loaded_at DESC, st DESC) = 1),
steps AS (SELECT t AS t_from, lead(t) OVER (ORDER BY a, t) AS t_to FROM (SELECT t, min(taken_at) AS a FROM snapshots WHERE t IS NOT NULL GROUP BY t)),
old AS (SELECT t_from, t_to, section, name, site, map_from_entries(st) AS m FROM last JOIN steps ON t = t_from WHERE t_to IS NOT NULL),
new AS (SELECT t_from, t_to, section, name, site, map_from_entries(st) AS m FROM last JOIN steps ON t = t_to),
b AS (SELECT coalesce(o.t_from, n.t_from) AS t_from, coalesce(o.t_to, n.t_to) AS t_to, coalesce(o.section, n.section) AS section, coalesce(o.name, n.name) AS name, coalesce(o.site, n.site) AS site, o.m AS b, n.m AS a
  FROM old o FULL JOIN new n ON o.t_from = n.t_from AND o.section = n.section AND o.name = n.name AND o.site = n.site),
ev AS (SELECT t_from, t_to, CASE section WHEN 'victims' THEN 'victim' WHEN 'sites' THEN 'site' WHEN 'mirrors' THEN 'mirror' WHEN 'clones' THEN 'clone' WHEN 'personas' THEN 'persona' ELSE 'page' END AS klass, name,
  CASE WHEN section = 'victims' THEN site ELSE name END AS surface, b, a FROM b WHERE CASE section
  WHEN 'victims' THEN b IS NULL OR a IS NULL OR b['status'] IS DISTINCT FROM a['status'] OR b['deadline'] IS DISTINCT FROM a['deadline']
  WHEN 'sites' THEN b IS NOT NULL AND a IS NOT NULL AND b['state'] IS DISTINCT FROM a['state'] WHEN 'pages' THEN b IS NOT NULL AND a IS NOT NULL AND b <> a ELSE b IS NULL END)"""
_ALERTS = (
    "WITH "
    + _EVENTS
    + """, f AS (SELECT s.* FROM snapshots s WHERE t = (SELECT t FROM snapshots WHERE t IS NOT NULL GROUP BY t ORDER BY min(taken_at), t LIMIT 1)),
wk AS (SELECT DISTINCT attrs['signed_key'] AS v FROM f WHERE section = 'personas' AND attrs['signed_key'] NOT IN ('-', '—')),
ww AS (SELECT DISTINCT attrs['wallet'] AS v FROM f WHERE section = 'personas' AND attrs['wallet'] NOT IN ('-', '—')),
wh AS (SELECT DISTINCT attrs['operator'] AS v FROM f WHERE section = 'sites' AND attrs['state'] = 'down' AND attrs['operator'] NOT IN ('-', '—')),
ty AS (SELECT *, CASE klass
  WHEN 'victim' THEN CASE WHEN a IS NULL THEN CASE WHEN b['status'] = 'published' THEN 'victim_removed' ELSE 'withdrawal' END WHEN b IS NULL THEN 'new_victim'
    WHEN a['status'] = 'published' AND b['status'] IS DISTINCT FROM 'published' THEN 'publication' WHEN a['deadline'] > b['deadline'] THEN 'deadline_slip' ELSE 'status_change' END
  WHEN 'site' THEN CASE WHEN a['state'] = 'down' THEN 'market_down' ELSE 'site_restored' END WHEN 'mirror' THEN 'new_mirror' WHEN 'clone' THEN 'new_clone'
  WHEN 'persona' THEN CASE WHEN a['signed_key'] IN (SELECT v FROM wk) OR a['wallet'] IN (SELECT v FROM ww) THEN 'operator_resurface' ELSE 'new_persona' END
  ELSE CASE WHEN b['content_id'] IS NOT DISTINCT FROM a['content_id'] THEN 'cosmetic_churn' ELSE 'content_change' END END AS type FROM ev),
sc AS (SELECT *, type = 'operator_resurface' OR coalesce(coalesce(a['operator'], b['operator']) IN (SELECT v FROM wh), false) AS watched,
  CASE WHEN type IN ('operator_resurface', 'new_clone') THEN 4 WHEN type IN ('publication', 'new_victim') THEN 3 WHEN type IN ('withdrawal', 'deadline_slip', 'market_down', 'content_change') THEN 2 WHEN type = 'cosmetic_churn' THEN 0 ELSE 1 END AS r0 FROM ty),
sd AS (SELECT *, CASE WHEN watched AND type = 'market_down' THEN least(4, r0 + 1) ELSE r0 END AS rank FROM sc),
og AS (SELECT name AS s, attrs['of'] AS o FROM snapshots WHERE section = 'mirrors' AND attrs['of'] IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY taken_at DESC, loaded_at DESC, attrs['of'] DESC) = 1),
cn AS (SELECT sd.*, coalesce(o, surface) AS origin FROM sd LEFT JOIN og ON surface = s),
co AS (SELECT *, row_number() OVER (PARTITION BY name, origin, t_to ORDER BY (surface = origin) DESC, rank DESC, surface, type) AS n, count(*) OVER (PARTITION BY name, origin, t_to) AS size,
  len(list(DISTINCT surface) OVER (PARTITION BY name, origin, t_to)) AS seen FROM cn),
al AS (SELECT t_from, t_to, type, name, origin AS surface, CASE rank WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity, rank::INT AS rank, watched,
  CASE WHEN type IN ('operator_resurface', 'new_clone') THEN 'high' ELSE 'medium' END AS confidence, (CASE WHEN size > 1 THEN seen ELSE 0 END)::INT AS n_seen_on FROM co WHERE n = 1 AND rank > 0)
"""
)
_PW = """e0 AS (SELECT least(a, b) AS a, greatest(a, b) AS b, signal, max(CASE WHEN weight > 0 AND NOT isnan(weight) THEN weight ELSE 0 END::DECIMAL(10,4)) AS w FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY ALL),
pw AS (SELECT a, b, sum(w) AS weight, string_agg(signal, ',' ORDER BY signal) AS signals, bool_or(coalesce(signal IN ('shared_signed_key', 'shared_wallet'), false)) AS hard, bool_or(coalesce(signal = 'displayed_only_key', false)) AS displayed FROM e0 GROUP BY a, b)"""
_HANDLES = "hd AS (SELECT DISTINCT handle FROM (SELECT a AS handle FROM edges UNION ALL SELECT b FROM edges) WHERE handle IS NOT NULL)"
_NAMES = """hd AS (SELECT DISTINCT handle FROM (SELECT a AS handle FROM edges UNION ALL SELECT b FROM edges UNION ALL SELECT vendor FROM listings UNION ALL SELECT author FROM documents
  UNION ALL SELECT party FROM messages UNION ALL SELECT name FROM snapshots WHERE section = 'personas') WHERE handle IS NOT NULL)"""
_CL = (
    "WITH RECURSIVE " + _PW + ", " + _HANDLES + """, s AS (SELECT a AS x, b AS y, hard FROM pw WHERE weight >= 0.8 UNION ALL SELECT b, a, hard FROM pw WHERE weight >= 0.8),
ra AS (SELECT handle, handle AS o FROM hd UNION SELECT r.handle, s.y FROM ra r JOIN s ON r.o = s.x), rh AS (SELECT handle, handle AS o FROM hd UNION SELECT r.handle, s.y FROM rh r JOIN s ON r.o = s.x WHERE s.hard),
ca AS (SELECT handle, min(o) AS c FROM ra GROUP BY 1), ch AS (SELECT handle, min(o) AS c FROM rh GROUP BY 1)"""
)
_PLAIN = r"regexp_replace(translate(lower(handle), '130457', 'ieoast'), '[^\p{L}\p{N}]', '', 'g')"
_SCORES = """SELECT t AS true_pairs, p AS found_pairs, r AS right_pairs, p - r AS false_merges, CASE WHEN t = 0 THEN 1 ELSE r / t END AS recall, CASE WHEN p = 0 THEN 1 ELSE r / p END AS precision FROM
(SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS t FROM (SELECT count(*) AS n FROM bo WHERE g IS NOT NULL GROUP BY g)), (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS p FROM (SELECT count(*) AS n FROM bo WHERE f IS NOT NULL GROUP BY f)),
(SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS r FROM (SELECT count(*) AS n FROM bo WHERE g IS NOT NULL AND f IS NOT NULL GROUP BY g, f))"""


def _style() -> str:
    words = ", ".join(f"'{w}'" for w in V.FUNCTION_WORDS)
    return rf"""WITH d AS (SELECT source AS id, replace(text, 'İ', 'i' || chr(775)) AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
wc AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM d) GROUP BY ALL), wt AS (SELECT id, sum(n) AS t FROM wc GROUP BY 1),
fw AS (SELECT id, w AS dim, n / t AS x FROM wc JOIN wt USING (id) WHERE w IN ({words})),
ss AS (SELECT id, regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g') AS s FROM d),
tc AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM ss WHERE length(s) >= 3) GROUP BY ALL), tt AS (SELECT id, sum(n) AS t FROM tc GROUP BY 1),
tr AS (SELECT id, g AS dim, n / t AS x FROM tc JOIN tt USING (id)),
c1 AS (SELECT a.id AS a, b.id AS b, sum(a.x * b.x) AS dot FROM fw a JOIN fw b ON a.dim = b.dim AND a.id < b.id GROUP BY 1, 2), n1 AS (SELECT id, sqrt(sum(x * x)) AS n FROM fw GROUP BY 1),
c2 AS (SELECT a.id AS a, b.id AS b, sum(a.x * b.x) AS dot FROM tr a JOIN tr b ON a.dim = b.dim AND a.id < b.id GROUP BY 1, 2), n2 AS (SELECT id, sqrt(sum(x * x)) AS n FROM tr GROUP BY 1),
f AS (SELECT a, b, dot / (x.n * y.n) AS v FROM c1 JOIN n1 x ON a = x.id JOIN n1 y ON b = y.id), t AS (SELECT a, b, dot / (x.n * y.n) AS v FROM c2 JOIN n2 x ON a = x.id JOIN n2 y ON b = y.id)
SELECT coalesce(f.a, t.a) AS a, coalesce(f.b, t.b) AS b, round(0.5 * coalesce(f.v, 0) + 0.5 * coalesce(t.v, 0), 3) AS sim FROM f FULL JOIN t ON f.a = t.a AND f.b = t.b"""


_CAP = ["title", "vendor", "category", "price", "currency", "ships_from", "ships_to", "terms"]
SQL = {
    "change_feed": "WITH " + _EVENTS + " SELECT t_from, t_to, klass, name, surface FROM ev",
    "alert_feed": _ALERTS + "SELECT * FROM al",
    "alert_grades": _ALERTS + """, k AS (SELECT DISTINCT t_to, type, name FROM al), g AS (SELECT t_to, type, name FROM alerts WHERE t_to IS NOT NULL AND type IS NOT NULL AND name IS NOT NULL),
x AS (SELECT (SELECT count(*) FROM k) AS true_rows, (SELECT count(*) FROM g) AS found_rows, (SELECT count(*) FROM k SEMI JOIN g USING (t_to, type, name)) AS matched, (SELECT count(*) FROM g ANTI JOIN k USING (t_to, type, name)) AS false_rows)
SELECT *, CASE WHEN true_rows = 0 THEN 1 ELSE matched / true_rows END AS recall, CASE WHEN found_rows = 0 THEN 1 ELSE matched / found_rows END AS precision FROM x""",
    "alert_overclaims": _ALERTS + """, lv AS (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS v, unnest(range(5)) AS r),
tr AS (SELECT t_to || '|' || type || '|' || name AS id, max(r) AS r FROM al JOIN lv ON severity = v GROUP BY 1),
fo AS (SELECT id, arg_max(coalesce(r, 0), coalesce(r, -1)) AS r FROM (SELECT t_to || '|' || type || '|' || name AS id, r FROM alerts LEFT JOIN lv ON severity = v WHERE t_to IS NOT NULL AND type IS NOT NULL AND name IS NOT NULL AND severity IS NOT NULL) GROUP BY 1)
SELECT count(*) AS claims, count(fo.r) AS covered, count(*) FILTER (fo.r = tr.r) AS calibrated, count(*) FILTER (fo.r > tr.r) AS overclaimed FROM tr LEFT JOIN fo USING (id)""",
    "evidence_pairs": "WITH " + _PW + " SELECT * FROM pw",
    "framing_flags": "WITH " + _PW + " SELECT a, b FROM pw WHERE displayed AND weight < 0.8",
    "operator_clusters": _CL + """, z AS (SELECT c, count(*) AS size FROM ca GROUP BY 1), q AS (SELECT ca.c, count(DISTINCT ch.c) AS parts FROM ca JOIN ch USING (handle) GROUP BY 1)
SELECT handle, ca.c AS cluster, size, CASE WHEN size = 1 THEN 'single' WHEN parts = 1 THEN 'high' ELSE 'medium' END AS confidence FROM ca JOIN z ON ca.c = z.c JOIN q ON ca.c = q.c""",
    "linkage_grades": _CL + ", bo AS (SELECT ca.c AS g, ch.c AS f FROM ca JOIN ch USING (handle)) " + _SCORES,
    "plain_handles": f"WITH {_HANDLES} SELECT handle, {_PLAIN} AS plain FROM hd",
    "handle_twins": f"WITH {_NAMES}, p AS (SELECT handle, {_PLAIN} AS p FROM hd) SELECT a.handle AS a, b.handle AS b FROM p a JOIN p b ON a.p = b.p AND a.handle < b.handle WHERE a.p <> ''",
    "handle_lookalikes": f"""WITH {_NAMES}, p AS (SELECT handle, {_PLAIN} AS p FROM hd), x AS (SELECT DISTINCT handle, p, unnest(list_append(list_transform(range(1, length(p) + 1), lambda i: substr(p, 1, i - 1) || substr(p, i + 1)), p)) AS k FROM p WHERE p <> '')
SELECT DISTINCT a.handle AS a, b.handle AS b FROM x a JOIN x b ON a.k = b.k AND a.handle < b.handle WHERE levenshtein(a.p, b.p) <= 1""",
    "persona_links": "WITH p AS (SELECT DISTINCT name, unnest(['signed_key', 'wallet', 'operator']) AS k, unnest([attrs['signed_key'], attrs['wallet'], attrs['operator']]) AS v FROM snapshots WHERE name IS NOT NULL),"
    + """ l AS (SELECT k, v, min(name) AS a FROM p WHERE v NOT IN ('', '-', '—') GROUP BY 1, 2)
SELECT DISTINCT a, name AS b, 'shared_' || k AS signal, CASE k WHEN 'operator' THEN 0.8 ELSE 1.0 END::DOUBLE AS weight FROM p JOIN l USING (k, v) WHERE a <> name""",
    "source_style": _style(),
    "capture_fields": "WITH lo AS (SELECT * FROM listings WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY rec_id) = 1), hi AS (SELECT * FROM listings WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY rec_id DESC) = 1)\n"
    + "\nUNION ALL ".join(f"SELECT '{f}' AS field, count(hi.{f}) AS n, count(*) FILTER (hi.{f} = lo.{f}) AS \"right\", count(*) FILTER (hi.{f} = lo.{f}) / count(hi.{f}) AS recall FROM hi JOIN lo USING (listing_id)" for f in _CAP),
    "resale_rings": """WITH RECURSIVE r AS (SELECT lower(title) AS t, vendor FROM listings WHERE title IS NOT NULL AND vendor IS NOT NULL AND length(title) >= 8), d AS (SELECT DISTINCT t FROM r),
g AS (SELECT t, list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS s FROM d), u AS (SELECT t, len(s) AS n, unnest(s) AS x FROM g),
c AS (SELECT a.t AS a, b.t AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.t < b.t GROUP BY ALL), e AS (SELECT a, b FROM c WHERE c >= 0.8 * (na + nb - c) - 1e-9 UNION SELECT b, a FROM c WHERE c >= 0.8 * (na + nb - c) - 1e-9),
k AS (SELECT t, t AS o FROM d UNION SELECT k.t, e.b FROM k JOIN e ON k.o = e.a), m AS (SELECT t, min(o) AS ring FROM k GROUP BY 1)
SELECT ring, count(DISTINCT vendor) AS n_vendors, count(DISTINCT r.t) AS n_titles, count(*) AS n_listings FROM r JOIN m USING (t) GROUP BY 1 HAVING n_vendors > 1""",
    "cluster_claims": _CL + """, z AS (SELECT c FROM ca GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT x.c AS id, count(*) FILTER (hard) AS hard, count(*) FILTER (NOT hard AND weight > 0) AS soft FROM pw JOIN ca x ON a = x.handle JOIN ca y ON b = y.handle JOIN z ON x.c = z.c WHERE x.c = y.c GROUP BY 1)
SELECT *, CASE WHEN hard > 0 THEN 'hard_identifier' WHEN soft > 1 THEN 'indirect_signals' ELSE 'single_soft_signal' END AS basis, CASE WHEN hard > 0 THEN 'high' WHEN soft > 1 THEN 'moderate' ELSE 'low' END AS confidence FROM n""",
}
from corroborate.plans.pages import SQL as _PAGES_SQL  # noqa: E402

SQL["duplicate_grades"] = (
    "WITH ne AS (" + _PAGES_SQL["near_duplicates"] + "), ex AS (" + _PAGES_SQL["exact_mirrors"] + "), bo AS (SELECT class_id AS g, canonical AS f FROM ne FULL JOIN ex ON ne.doc_id = ex.id) " + _SCORES
)
SQL["nearest_handles"] = (
    "WITH " + _HANDLES + ", x AS (SELECT handle, " + ", ".join(f"xor(('0x' || substr(sha256(handle), {1 + 8 * i}, 8))::BIGINT, ('0x' || substr(sha256('corroborate'), {1 + 8 * i}, 8))::BIGINT) AS d{i}" for i in range(8))
    + " FROM hd) SELECT handle, (row_number() OVER (ORDER BY " + ", ".join(f"d{i}" for i in range(8)) + ", handle))::INT AS place FROM x QUALIFY place <= 20"
)
