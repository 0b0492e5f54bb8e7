"""Queries over pages: addresses, keys, hashes, structure, duplicates and their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import address as A
from corroborate.functions import text as X
from corroborate.operators import pages as P
from corroborate.operators.simjoin import near_duplicate_classes, similar_pairs, structural_pairs
from corroborate.session import cut
from corroborate.sources.tables import table

K, T = 5, 0.8


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def address_networks(spark: SparkSession, d: str) -> DataFrame:
    """Network and host of the addresses of watched sections, as snapshots name them."""
    suffix = F.create_map(*[F.lit(x) for kv in {"victims": ".onion/entry", "sites": ".b32.i2p:80/", "mirrors": ".Example.org/a#top", "clones": "", "pages": "@USK@x/1"}.items() for x in kv])
    scheme = F.when(F.col("section").isin("victims", "sites", "mirrors"), "http://").otherwise("")
    at = F.concat(scheme, F.replace(F.coalesce("site", "name"), F.lit(" "), F.lit("")), F.coalesce(F.try_element_at(suffix, F.col("section")), F.lit("/")))
    rows = table(spark, d, "snapshots").select("section", at.alias("addr"))
    return rows.groupBy("section", A.classify_network(F.col("addr")).alias("network")).agg(F.count("*").alias("n"), F.count_distinct(A.host_of(F.col("addr"))).alias("n_hosts"))


def page_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", A.pgp_key(t).alias("pgp"), A.btc_wallet(t).alias("btc"), A.content_hash(t).alias("content_hash"), A.structural_hash(t).alias("structural_hash"), A.keymask_hash(t).alias("keymask_hash"))


def borrowed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that pages of several authors show, with the authors."""
    keys = _docs(spark, d).select(A.pgp_key(F.col("text")).alias("pgp"), "author").where("pgp is not null and author is not null").distinct()
    return keys.groupBy("pgp").agg(F.count("*").alias("n_authors"), F.array_join(F.array_sort(F.collect_list("author")), ",").alias("authors")).where("n_authors > 1")


def exact_mirrors(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_groups(_docs(spark, d), "doc_id", A.content_hash(F.col("text")))


def masked_clones(spark: SparkSession, d: str) -> DataFrame:
    """Records of the watched world alike but for their keys: the same hash with keys masked, other content."""
    entries = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    rows = table(spark, d, "snapshots").where("name is not null and attrs is not null").select("name", F.concat_ws(";", "section", F.array_join(entries, ";")).alias("text"))
    hashed = rows.select("name", A.keymask_hash(F.col("text")).alias("masked"), A.content_hash(F.col("text")).alias("content"))
    groups = hashed.groupBy("masked").agg(F.count_distinct("content").alias("n_contents"), F.count("*").alias("n_records"), F.min("name").alias("first_name"))
    return groups.where("n_contents > 1").select("masked", "n_contents", "n_records", "first_name")


def page_structure(spark: SparkSession, d: str) -> DataFrame:
    """Tags, distinct tag trigrams and the structure hash of every page that has tags."""
    feats = X.tag_features(F.col("text"))
    rows = _docs(spark, d).where(F.col("text").rlike("<[a-zA-Z]")).select("doc_id", X.skeleton(F.col("text")).alias("tags"), feats.alias("f"))
    return rows.select("doc_id", F.size("tags").cast("bigint").alias("n_tags"), F.size(F.array_distinct("f")).cast("bigint").alias("n_features"), X.simhash_bits(F.col("f")).alias("s")).select("doc_id", "n_tags", "n_features", "s.hi", "s.lo")


def structural_twins(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one title (as a shared asset) whose structure is at least 0.85 alike."""
    rows = _docs(spark, d).where(F.col("text").rlike("<title>")).select(F.col("doc_id").alias("id"), X.simhash_bits(X.tag_features(F.col("text"))).alias("s"), F.regexp_extract("text", "<title>([^<]*)</title>", 1).alias("asset"))
    return structural_pairs(rows.select("id", "s.hi", "s.lo", "asset"), 9)


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.size(F.array_distinct(X.windows(F.col("w"), K))).cast("bigint").alias("n_shingles"))


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_id", X.shingles(F.col("text"), K).alias("s"))
    return s.select("doc_id", F.posexplode(X.minhash(F.col("s"), 8))).select("doc_id", F.col("pos").cast("int").alias("place"), F.col("col").alias("least"))


def _shingled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "text")
    items = docs.groupBy("digest").agg(F.any_value("text").alias("text")).select("digest", X.shingles(F.col("text"), K).alias("items"))
    return docs.select("id", "digest"), items


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _shingled(spark, d)
    return near_duplicate_classes(docs, items, T).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts, each named by its least document."""
    docs, items = _shingled(spark, d)
    first = cut(docs.groupBy("digest").agg(F.min("id").alias("id")))
    pairs = similar_pairs(items, T, "digest", "items")
    both = pairs.join(first.select(F.col("digest").alias("x"), F.col("id").alias("i")), "x").join(first.select(F.col("digest").alias("y"), F.col("id").alias("j")), "y")
    return both.select(F.least("i", "j").alias("doc_a"), F.greatest("i", "j").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))


def duplicate_roles(spark: SparkSession, d: str) -> DataFrame:
    """Every near-duplicate class of several documents: its canonical page and the others' roles, by their keys, the
    likeness to the canonical page and a title they share with it. Words are compared once per pair of page and
    canonical page, and only in classes of several."""
    t = F.col("text")
    info = _docs(spark, d).select(F.col("doc_id").alias("id"), A.pgp_key(t).alias("pgp"), A.btc_wallet(t).alias("btc"), (F.col("source") == "listing_page").alias("l")).withColumn("listed", F.coalesce("l", F.lit(False))).drop("l")
    classes = near_duplicates(spark, d).where("n_links > 0").select(F.col("doc_id").alias("id"), "class_id")
    members = cut(classes.join(info, "id").withColumn("keyed", F.col("pgp").isNotNull() | F.col("btc").isNotNull()))
    top = P.canonical(members).join(members.select(F.col("id").alias("canonical"), F.col("pgp").alias("pgp0"), F.col("btc").alias("btc0")), "canonical")
    both = members.join(top, "class_id")
    both_pay = F.col("btc").isNotNull() & F.col("btc0").isNotNull()
    keyless = ~F.col("keyed")
    rule = P.intent(P.same_keys(F.col("pgp"), F.col("btc"), F.col("pgp0"), F.col("btc0")), both_pay, ~F.col("btc").eqNullSafe(F.col("btc0")), keyless, F.col("similarity"), F.col("asset"), F.col("listed"))
    title = F.regexp_extract("text", "<title>([^<]*)</title>", 1)
    shown = cut(_docs(spark, d).select(F.col("doc_id").alias("id"), X.shingles(t, K).alias("w"), title.alias("t")).join(members.select("id"), "id", "left_semi"))
    own = both.select("id", "canonical").where("id <> canonical").join(shown, "id").join(shown.select(F.col("id").alias("canonical"), F.col("w").alias("w0"), F.col("t").alias("t0")), "canonical")
    told = own.select("id", X.jaccard(F.col("w"), F.col("w0")).alias("similarity"), ((F.col("t") != "") & (F.col("t") == F.col("t0"))).alias("asset"))
    both = both.join(told, "id", "left")
    role = F.when(F.col("id") == F.col("canonical"), F.struct(F.lit("canonical").alias("role"), F.lit("").alias("reason"))).otherwise(rule)
    return both.withColumn("r", role).select(F.col("id").alias("doc_id"), "class_id", "canonical", "r.role", "r.reason")


QUERIES = {f.__name__: f for f in (address_networks, page_keys, borrowed_keys, exact_mirrors, masked_clones, page_structure, structural_twins, token_stats, minhash_signatures, near_duplicates, near_duplicate_pairs, duplicate_roles)}

_PGP = r"nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])([0-9A-Z]{14,40})(?:$|[^0-9A-Za-z_])', 1), '')"
_BTC = r"nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])(bc1q[a-z0-9_]+)', 1), '')"
_HASH = "substr(sha256({}), 1, 16)"
_MASK = r"regexp_replace(text, '(?:[0-9A-Z]{14,40}|bc1q[a-z0-9_]+)', 'K', 'g')"
_WORDS = r"""w AS (SELECT doc_id, source, text, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(replace(text, 'İ', 'i' || chr(775)), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))), ' '), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, source, text, w, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS sh FROM w)"""
_FEATS = r"""t AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '<[ \t\n]*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS tags FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, text, tags, CASE WHEN len(tags) = 0 THEN []::VARCHAR[] WHEN len(tags) < 3 THEN [array_to_string(tags, ' ')]
  ELSE list_transform(range(0, len(tags) - 2), lambda i: array_to_string(tags[i + 1:i + 3], ' ')) END AS f FROM t),
h AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h0, ('0x' || substr(md5(x), 9, 8))::BIGINT AS h1 FROM (SELECT doc_id, unnest(f) AS x FROM f)),
b AS (SELECT doc_id, i, sum((h0 >> i) & 1) * 2 > count(*) AS b0, sum((h1 >> i) & 1) * 2 > count(*) AS b1 FROM h, (SELECT unnest(range(32)) AS i) GROUP BY ALL),
sim AS (SELECT doc_id, sum(CASE WHEN b0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN b1 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS lo FROM b GROUP BY doc_id)"""
_PAIRS = (
    "WITH RECURSIVE "
    + _WORDS
    + """, u AS (SELECT doc_id, text, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT x, y, c / (nx + ny - c) AS j FROM c WHERE c >= 0.8 * (nx + ny - c) - 1e-9
      UNION SELECT a.doc_id, b.doc_id, 1.0 FROM s a JOIN s b ON a.text = b.text AND a.doc_id < b.doc_id),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
reach AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.o = e.x),
classes AS (SELECT doc_id, min(o) AS class_id FROM reach GROUP BY doc_id),
links AS (SELECT x, count(*) AS n FROM e GROUP BY x)
"""
)

SQL = {
    "address_networks": r"""
WITH a AS (SELECT section, (CASE WHEN section IN ('victims', 'sites', 'mirrors') THEN 'http://' ELSE '' END) || replace(coalesce(site, name), ' ', '') ||
  CASE section WHEN 'victims' THEN '.onion/entry' WHEN 'sites' THEN '.b32.i2p:80/' WHEN 'mirrors' THEN '.Example.org/a#top' WHEN 'clones' THEN '' WHEN 'pages' THEN '@USK@x/1' ELSE '/' END AS addr FROM snapshots),
h AS (SELECT section, addr, regexp_matches(addr, '(?i)(?:^|[^0-9A-Za-z_])(?:USK|SSK|CHK|KSK)@') AS k, regexp_extract(addr, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS hh FROM a),
g AS (SELECT section, addr, k, CASE WHEN k THEN regexp_extract(addr, '(?i)((?:USK|SSK|CHK|KSK)@[^/]*)', 1) WHEN hh <> '' THEN lower(hh) ELSE lower(addr) END AS host FROM h)
SELECT section, CASE WHEN k THEN 'hyphanet' WHEN ends_with(host, '.i2p') THEN 'i2p' WHEN regexp_matches(host, '[a-z2-7]{56}\.onion') OR ends_with(host, '.onion') THEN 'tor'
  WHEN regexp_matches(addr, '^https?://') OR contains(host, '.') THEN 'clearnet' ELSE 'unknown' END AS network, count(*) AS n, count(DISTINCT host) AS n_hosts FROM g GROUP BY ALL""",
    "page_keys": f"""
WITH k AS (SELECT doc_id, text, {_PGP} AS pgp, {_BTC} AS btc FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, CASE WHEN pgp IS NULL THEN text ELSE replace(text, pgp, 'PGP') END AS m1 FROM k)
SELECT doc_id, pgp, btc, {_HASH.format("text")} AS content_hash, {_HASH.format("CASE WHEN btc IS NULL THEN m1 ELSE replace(m1, btc, 'BTC') END")} AS structural_hash, {_HASH.format(_MASK)} AS keymask_hash FROM m""",
    "borrowed_keys": f"""
WITH k AS (SELECT DISTINCT {_PGP} AS pgp, author FROM documents WHERE text IS NOT NULL AND author IS NOT NULL)
SELECT pgp, count(*) AS n_authors, string_agg(author, ',' ORDER BY author) AS authors FROM k WHERE pgp IS NOT NULL GROUP BY pgp HAVING count(*) > 1""",
    "exact_mirrors": f"""
WITH h AS (SELECT doc_id AS id, {_HASH.format("text")} AS digest FROM documents WHERE text IS NOT NULL)
SELECT id, digest, min(id) OVER (PARTITION BY digest) AS canonical, count(*) OVER (PARTITION BY digest) AS copies FROM h QUALIFY copies > 1""",
    "masked_clones": f"""
WITH r AS (SELECT name, section || ';' || array_to_string(list_sort(list_transform(map_entries(attrs), lambda e: e.key || coalesce('=' || e.value, ''))), ';') AS text FROM snapshots WHERE name IS NOT NULL AND attrs IS NOT NULL),
h AS (SELECT name, {_HASH.format(_MASK)} AS masked, {_HASH.format("text")} AS content FROM r)
SELECT masked, count(DISTINCT content) AS n_contents, count(*) AS n_records, min(name) AS first_name FROM h GROUP BY masked HAVING count(DISTINCT content) > 1""",
    "page_structure": "WITH " + _FEATS + """
SELECT f.doc_id, len(tags) AS n_tags, len(list_distinct(f)) AS n_features, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM f LEFT JOIN sim USING (doc_id) WHERE regexp_matches(text, '<[a-zA-Z]')""",
    "structural_twins": "WITH " + _FEATS + """, a AS (SELECT f.doc_id AS id, hi, lo, regexp_extract(text, '<title>([^<]*)</title>', 1) AS asset FROM f JOIN sim USING (doc_id) WHERE contains(text, '<title>'))
SELECT DISTINCT a.id AS x, b.id AS y, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS bits FROM a JOIN a b ON a.asset = b.asset AND a.id < b.id
WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 9""",
    "token_stats": "WITH " + _WORDS + " SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, len(sh) AS n_shingles FROM s",
    "minhash_signatures": "WITH " + _WORDS + f""", p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(X.permutations(8)))}) t(place, a, b)),
u AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 2147483647 AS h FROM (SELECT doc_id, unnest(sh) AS g FROM s))
SELECT s.doc_id, place::INT AS place, coalesce(m, 0)::BIGINT AS least FROM s CROSS JOIN p LEFT JOIN (SELECT doc_id, place, min((h * a + b) % 2147483647) AS m FROM u, p GROUP BY ALL) q USING (doc_id, place)""",
    "near_duplicates": _PAIRS + "SELECT c.doc_id, c.class_id, coalesce(l.n, 0) AS n_links FROM classes c LEFT JOIN links l ON c.doc_id = l.x",
    "near_duplicate_pairs": _PAIRS + """, f AS (SELECT text, min(doc_id) AS d FROM s GROUP BY text)
SELECT DISTINCT least(fa.d, fb.d) AS doc_a, greatest(fa.d, fb.d) AS doc_b, round(p.j, 6) AS jaccard FROM p JOIN s a ON p.x = a.doc_id JOIN s b ON p.y = b.doc_id JOIN f fa ON a.text = fa.text JOIN f fb ON b.text = fb.text WHERE fa.d <> fb.d""",
    "duplicate_roles": _PAIRS + f""", i AS (SELECT doc_id, {_PGP} AS pgp, {_BTC} AS btc, coalesce(source = 'listing_page', false) AS listed FROM s),
m AS (SELECT c.doc_id, c.class_id, i.* EXCLUDE (doc_id) FROM classes c JOIN links l ON c.doc_id = l.x JOIN i ON c.doc_id = i.doc_id),
top AS (SELECT class_id, doc_id AS canonical, pgp AS pgp0, btc AS btc0 FROM m QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY CASE WHEN listed THEN 0 WHEN pgp IS NOT NULL OR btc IS NOT NULL THEN 1 ELSE 2 END, doc_id) = 1),
sims AS (SELECT m.doc_id, len(list_intersect(a.sh, b.sh)) / greatest(1, len(list_distinct(list_concat(a.sh, b.sh)))) AS sim, len(a.sh) + len(b.sh) AS n,
  regexp_extract(a.text, '<title>([^<]*)</title>', 1) AS t, regexp_extract(b.text, '<title>([^<]*)</title>', 1) AS t0 FROM m JOIN top USING (class_id) JOIN s a ON a.doc_id = m.doc_id JOIN s b ON b.doc_id = canonical WHERE m.doc_id <> canonical),
r AS (SELECT m.doc_id, m.class_id, canonical, CASE WHEN m.doc_id = canonical THEN 'canonical|' WHEN btc = btc0 AND pgp IS NOT DISTINCT FROM pgp0 THEN 'mirror|shared_payment' WHEN btc <> btc0 THEN 'clone|payment_swap'
  WHEN pgp IS NULL AND btc IS NULL AND (n = 0 OR sim >= 0.5) THEN 'mirror|benign_copy' WHEN pgp IS NULL AND btc IS NULL AND t <> '' AND t = t0 AND NOT listed THEN 'clone|keyless_copy' ELSE 'mirror|benign_copy' END AS r FROM m JOIN top USING (class_id) LEFT JOIN sims USING (doc_id))
SELECT doc_id, class_id, canonical, split_part(r, '|', 1) AS role, split_part(r, '|', 2) AS reason FROM r""",
}
