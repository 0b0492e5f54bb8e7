"""Whole analyses on small fixtures, the plain way beside the full one."""

import pytest
from pyspark.sql import functions as F

from corroborate.operators import pipelines as L
from corroborate.operators import scoring as S
from corroborate.operators.ranking import numbered

WORDS = "welcome to the old harbour market where sellers of tea and rope have met since the first tide and every trade is kept in escrow until both sides agree".split()


def page(text, key="", wallet="", extra=""):
    return f"<html><body><div><h1>t</h1><p>{text}</p><p>{key} {wallet}</p>{extra}<ul><li>a</li><li>b</li></ul></div></body></html>"


def test_dedup(spark):
    k1, k2, w1, w2 = "A" * 20, "B" * 20, "bc1q" + "x" * 20, "bc1q" + "z" * 20
    text = " ".join(WORDS)
    other = "a quite different page about nothing but ships and their names in harbours far away from any of these markets"
    logo = '<img src="/logo-77.png">'
    rows = [
        (1, page(text, k1, w1), True),
        (2, page(text, k1, w1), False),  # the same page
        (3, page(text + " today", k1, w1), False),  # a mirror with another word
        (4, page(text, k1, w2), False),  # its wallet swapped
        (5, page(" ".join(WORDS[:-2])), False),  # a copy without keys
        (6, page(other, k2, "", logo), True),
        (7, page("wholly other words stand here but the frame is the one of that page and so is the picture shown", "", "", logo), False),
        (8, "<p>alone</p>", False),
    ]
    df = spark.createDataFrame(rows, "id int, html string, listed boolean")
    full = {r.id: (r.canonical, r.role, r.reason) for r in L.dedup(df, likeness=0.7).collect()}
    assert full == {1: (1, "canonical", ""), 2: (1, "mirror", "shared_payment"), 3: (1, "mirror", "shared_payment"), 4: (1, "clone", "payment_swap"), 5: (1, "mirror", "benign_copy"), 6: (6, "canonical", ""), 7: (6, "clone", "keyless_copy"), 8: (8, "canonical", "")}
    truth = spark.createDataFrame([(2, 1, "mirror"), (3, 1, "mirror"), (5, 1, "mirror"), (4, 1, "clone"), (7, 6, "clone")], "id int, canonical int, role string")
    score = lambda found, role: S.role_recall(truth, found.withColumnRenamed("canonical", "cluster"), role).first().recall
    plain = L.dedup(df, naive=True).drop("reason")
    assert (round(score(plain, "mirror"), 2), score(plain, "clone")) == (0.33, 0.5)
    assert (score(L.dedup(df, likeness=0.7), "mirror"), score(L.dedup(df, likeness=0.7), "clone")) == (1.0, 1.0)


def listing(i, title, vendor, price, terms="escrow"):
    return f'<div data-id="{i}"><h1 class="listing-title">{title}</h1><span class="f-vendor">{vendor}</span><span class="f-category">tea</span><span class="f-price">{price} BTC</span><span class="f-terms">{terms}</span></div>'


def test_market(spark):
    same = " ".join(WORDS)
    pages = [("a.html", listing(1, same, "Ann", 2.0), 200), ("b.html", listing(2, same, "Bob", 2.0), 200), ("c-v2.html", listing(3, "tin", "Ann", 0.1) + '<a href="/trap" style="display: none">x</a>', 200), ("c.html", listing(3, "tin again", "Ann", 3.0), 200),
             ("d.html", "Too many requests", 429), ("e.html", "prove you are human", 200), ("f.html", listing(9, "x", "Eve", 1.0) + "this account has been flagged", 200), ("g.html", listing(4, "rope", "Ann", 2.2), 200)]
    vendors = [("v1.html", '<h1 class="vendor-handle">Ann</h1><span class="v-rating">4.5</span>')]
    got = L.market(spark.createDataFrame(pages, "file string, html string, status int"), spark.createDataFrame(vendors, "file string, html string"))
    assert {(r.listing_id, r.title) for r in got["listings"].collect()} == {(1, same), (2, same), (3, "tin"), (4, "rope")}
    assert {(r.file, r.defence, r.action) for r in got["defences"].collect()} == {("d.html", "rate_limited", "backoff"), ("e.html", "captcha", "queue"), ("f.html", "poisoned", "skip")}
    assert [tuple(r) for r in got["honeypots"].collect()] == [("c-v2.html", "/trap")] and [r.file for r in got["poisoned"].collect()] == ["f.html"]
    assert {tuple(r) for r in got["flags"].collect()} == {("prolific", "Ann"), ("bait", "3"), ("ring", "Ann,Bob")}
    assert [(r.handle, r.rating) for r in got["vendors"].collect()] == [("Ann", 4.5)]


def victim(i, org, status, deadline, gb, proof="files"):
    return f'<div data-id="{i}"><h1 class="v-org">{org}</h1><span class="f-sector">retail</span><span class="f-country">NO</span><span class="f-volume">{gb} GB</span><span class="f-proof">{proof}</span><span class="f-status">{status}</span><span class="f-deadline">{deadline}</span></div>'


def test_leak(spark):
    rows = [("t1", "s1", "1", victim(1, "Acme", "listed", "2024-01-01", 100)), ("t2", "s1", "1", victim(1, "Acme", "listed", "2024-01-09", 100)), ("t2", "s2", "1", victim(1, "Acme", "listed", "2024-01-01", 100)), ("t1", "s1", "2", victim(2, "Bolt", "listed", "2024-01-01", 9)), ("t2", "s1", "2", victim(2, "Bolt", "published", "2024-01-01", 9))]
    talks = [(1, "victim: Acme\n[1] operator: 40 BTC or we publish, proof 12 GB\n[2] operator: we will delete all\nongoing")]
    got = L.leak(spark.createDataFrame(rows, "t string, site string, file string, html string"), spark.createDataFrame(talks, "victim_id int, text string"))
    assert got["victims"].count() == 3
    assert {(r.victim_id, r.site, r.transition, r.deadline_slid) for r in got["lifecycle"].collect()} == {(1, "s1", "stable", True), (2, "s1", "published", False)}
    assert [(r.victim_id, r.verdict) for r in got["reposts"].collect()] == [(1, "mirror")]
    assert [(r.victim_id, r.bluffs) for r in got["bluffs"].collect()] == [(1, ["deadline_bluff", "volume_bluff", "deletion_bluff"])]
    truth = spark.createDataFrame([(1, ["deadline_bluff", "volume_bluff", "sold_bluff"])], "victim_id int, bluffs array<string>")
    assert tuple(S.label_recall(truth, got["bluffs"], "victim_id", "bluffs").first()) == (3, 2, pytest.approx(2 / 3))


def test_personas(spark):
    mk = lambda h, dk=(), sk=(), w=(), hours=(), posts="", t=(): (h, list(dk), list(sk), list(w), list(hours), posts, list(t))
    rows = [mk("jay", sk=["K1"], posts="please kindly send the funds at once"), mk("raven", sk=["K1"], posts="moreover we shall wait"), mk("fox", w=["W"], posts="ok u gonna pay"), mk("f0x", w=["W"], posts="thats it"), mk("thief", dk=["K1"], posts="buy my stuff"), mk("alone", posts="zzz")]
    df = spark.createDataFrame(rows, "handle string, displayed_keys array<string>, signed_keys array<string>, wallets array<string>, active_hours array<int>, posts string, tactics array<string>")
    df = df.withColumn("displayed_keys", F.when(F.col("handle").isin("jay", "raven"), F.array(F.lit("K1"))).otherwise(F.col("displayed_keys")))
    got = L.personas(df)
    assert [(r.op, r.cluster, r.size, r.confidence) for r in got["clusters"].orderBy("cluster").collect()] == [("op-1", "alone", 1, "single"), ("op-2", "f0x", 2, "high"), ("op-3", "jay", 2, "high"), ("op-4", "thief", 1, "single")]
    assert {tuple(r) for r in got["framing_flags"].collect()} == {("jay", "thief"), ("raven", "thief")}
    truth = spark.createDataFrame([("jay", 1, "high"), ("raven", 1, "high"), ("fox", 2, "medium"), ("f0x", 2, "medium"), ("thief", 3, "single"), ("alone", 4, "single")], "id string, group int, confidence string")
    found = got["personas"].select(F.col("handle").alias("id"), F.col("cluster").alias("group"), "confidence")
    assert tuple(S.calibration(truth, found).first()) == (2, 2, 1)
    full, plain = (S.pair_scores(truth, L.personas(df, naive)["personas"].select(F.col("handle").alias("id"), F.col("cluster").alias("group"))).first() for naive in (False, True))
    assert (full.recall, full.false_merges) == (1.0, 0) and plain.false_merges == 2


def test_report(spark):
    claims = spark.createDataFrame([("c1", "one hand", "a second key"), ("c2", "same hours", "a key"), ("c3", "rumour", "anything")], "id string, statement string, upgrade string")
    evidence = spark.createDataFrame([("c1", "hard", "k"), ("c2", "soft", "x"), ("c2", "soft", "y")], "id string, kind string, source string")
    got = L.report(claims, evidence)
    assert [(r.finding, r.id, r.basis, r.confidence) for r in got["findings"].orderBy("finding").collect()] == [(1, "c1", "hard_identifier", "high"), (2, "c2", "indirect_signals", "moderate"), (3, "c3", "single_soft_signal", "low")]
    assert got["bluf"].first().id == "c1" and {r.id for r in got["what_would_change"].collect()} == {"c2", "c3"} and got["annex"].count() == 3
    sourced = got["annex"].groupBy("id").agg(F.collect_list("source").alias("evidence"))
    assert tuple(S.provenance(claims.join(sourced, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))).first()) == (3, 2)


def test_scores(spark):
    truth = spark.createDataFrame([("a", "service", None), ("b", "service", None), ("c", "mirror", "a"), ("d", "clone", "a"), ("e", "clone", "a")], "host string, role string, original string")
    found = spark.createDataFrame([("a", "service", None), ("c", "mirror", "a"), ("d", "service", None), ("e", "clone", None), ("x", "service", None)], "host string, role string, same_as string")
    r = S.crawl_scores(truth, found).first()
    assert (r.recall, r.precision, r.mirrors_collapsed, r.clones_caught, r.clones_believed) == (0.5, 0.8, 1, 1, 1)
    assert tuple(S.crawl_scores(truth.limit(0), found.limit(0)).select("recall", "precision").first()) == (0.0, 0.0)
    a = spark.createDataFrame([("x", "critical"), ("y", "critical"), ("z", "low")], "k string, severity string")
    assert tuple(S.at_level(a, a.where("k <> 'y'"), ["k"], "critical").first()) == (2, 1)


def test_numbered(spark):
    df = spark.range(1000).select(F.format_string("%04d", "id").alias("k")).repartition(7)
    assert [(r.k, r.n) for r in numbered(df, "k").orderBy("n").collect()] == [(f"{i:04d}", i + 1) for i in range(1000)]
    assert numbered(df.limit(0), "k").count() == 0
