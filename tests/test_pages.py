"""Addresses, page fields, mirrors and clones, crawls."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corroborate.functions import address as A
from corroborate.functions import fields as E
from corroborate.functions import names as N
from corroborate.functions import text as X
from corroborate.operators import pages as P

ONION = "a" * 56 + ".onion"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "addr,net,host",
    [
        ("USK@abc/site/3", "hyphanet", "USK@abc"),
        (f"http://{ONION.upper()}/x", "tor", ONION),
        ("http://Foo.i2p:80/", "i2p", "foo.i2p"),
        ("https://u@Example.org/", "clearnet", "example.org"),
        ("plain", "unknown", "plain"),
        ("", "unknown", ""),
        (None, "unknown", None),
    ],
)
def test_address(spark, addr, net, host):
    df = spark.createDataFrame([(addr,)], "a string").select(A.classify_network(F.col("a")).alias("n"), A.host_of(F.col("a")).alias("h"))
    assert tuple(df.first()) == (net, host)


def test_normalize_and_links(spark):
    assert A.normalized("../b/?q=1#x", "http://Host.onion:80/a/c/") == "http://host.onion/a/b?q=1"
    assert A.normalized("https://H.org:8443") == "https://h.org:8443/"
    html = f'<a href="/in/">x</a><a href="/in">y</a> see {ONION}/z and CHK@k/1 <a href="http://clear.net">c</a>'
    df = spark.createDataFrame([(html, "http://h.onion/"), (None, None)], "h string, b string").select(A.links_of(F.col("h"), F.col("b")).alias("l"))
    got = df.collect()
    assert got[0].l == ["http://h.onion/in", "http://clear.net/", f"http://{ONION}/z", "CHK@k/1"] and got[1].l == []
    assert spark.createDataFrame([("HTTP://A.b/#f",), (None,)], "u string").select(A.normalize_url(F.col("u")).alias("r")).collect()[0].r == "http://a.b/"


def test_keys_and_hashes(spark):
    a, b = "id ABCDEFGHIJKLMN12 pay bc1qaaa end", "id ZZZZZZZZZZZZZZ99 pay bc1qbbb end"
    df = spark.createDataFrame([(a,), (b,), ("no keys",)], "t string").select(A.pgp_key(F.col("t")).alias("p"), A.btc_wallet(F.col("t")).alias("w"), A.content_hash(F.col("t")).alias("c"), A.structural_hash(F.col("t")).alias("s"), A.keymask_hash(F.col("t")).alias("k")).collect()
    assert (df[0].p, df[0].w, df[2].p, df[2].w) == ("ABCDEFGHIJKLMN12", "bc1qaaa", None, None)
    assert df[0].c == hashlib.sha256(a.encode()).hexdigest()[:16]
    assert df[0].s == df[1].s and df[0].k == df[1].k and df[0].c != df[1].c
    assert one(spark, A.assets(F.col("h")), h='<img src="/x/assets/a.png"><link href=/assets/b.css><img src="/assets/a.png">') == ["a.png", "b.css"]


LISTING = '<div data-id="42"><h1>Old</h1><span class="listing-title">Tea <b>box</b></span><b class=f-price>12.5 USD</b><i class="f-vendor">Mia</i></div>'
DRIFT = "<h2>Tea</h2><p>Listing # 43</p><table><tr><td>Price</td><td>9 EUR</td></tr></table><dl><dt>Vendor</dt><dd>Bo</dd></dl>"


def test_fields(spark):
    full = spark.createDataFrame([(LISTING,), (DRIFT,), ("",), (None,)], "h string").select(E.parse_listing(F.col("h")).alias("r"), E.parse_listing(F.col("h"), True).alias("n")).collect()
    assert (full[0].r.listing_id, full[0].r.title, full[0].r.price, full[0].r.currency, full[0].r.vendor) == (42, "Tea box", 12.5, "USD", "Mia")
    assert (full[1].r.listing_id, full[1].r.title, full[1].r.price, full[1].r.vendor) == (43, "Tea", 9.0, "Bo")
    assert full[1].n.price is None and full[2].r.title is None and full[3].r.listing_id is None
    v = one(spark, E.parse_victim(F.col("h")), h='<h1 class="v-org">Acme</h1>Entry #7<b class="f-volume">1.5 TB</b><td>Status</td><td>sold</td>')
    assert (v.victim_id, v.org, v.claimed_gb, v.status) == (7, "Acme", 1500.0, "sold")
    w = one(spark, E.parse_vendor(F.col("h")), h='<h1>Bo</h1><b class="v-rating">4.5</b><b class="v-feedback">x1</b><span class="fb-date">2024-01-02</span><span class=fb-date>2024-02</span>')
    assert (w.handle, w.rating, w.feedback_count, w.feedback_dates) == ("Bo", 4.5, None, ["2024-01-02", "2024-02"])
    df = spark.createDataFrame([(LISTING,)], "h string").select(E.parse_listing(F.col("h")).alias("r")).select(E.complete(F.col("r"), ["title", "price"]).alias("a"), E.complete(F.col("r"), ["title", "terms"]).alias("b")).first()
    assert (df.a, df.b) == (True, False)


def test_text_records(spark):
    p = one(spark, E.parse_persona(F.col("t")), t="=== profile ===\npersona: Jay\nsurface: market\nsigned_keys: K1, K2,\nactive_hours: 1, x, 23\n--- posts ---\nhello: there\nbye")
    assert (p.handle, p.signed_keys, p.wallets, p.active_hours, p.posts) == ("Jay", ["K1", "K2"], [], [1, 23], "hello: there\nbye")
    a = one(spark, E.parse_arc(F.col("t")), t="victim: Acme\nbrand: Red\n[1] operator: 40 BTC or we publish, proof 12 GB\n[2] victim: 10 BTC\n[3] operator: We will delete all\n[settlement] 20 BTC")
    assert (a.victim, a.offers, a.settlement, a.proof_gb, a.outcome, a.tactics) == ("Acme", [40, 10, 20], 20, 12.0, "settled", ["deletion_promise", "proof_offered", "threat_leak"])
    s = spark.createDataFrame([("snapshot: t1\n--- victims ---\nAcme | site=x | status=sold\n--- pages ---\npg | banner=B\nnoise",)], "text string")
    got = {(r.t, r.section, r.name, r.site, tuple(sorted(r.attrs.items()))) for r in E.parse_snapshots(s).collect()}
    assert got == {("t1", "victims", "Acme", "x", (("site", "x"), ("status", "sold"))), ("t1", "pages", "pg", None, (("banner", "B"),))}
    dirty = "mail a.b@c.org or http://x.y/z at 10.0.0.1, bc1" + "q" * 30 + " case 12345678, $12345678, 12345678 usd"
    assert one(spark, E.scrub(F.col("t")), t=dirty) == "mail [email] or [url] at [ip], [wallet] case [num], $12345678, 12345678 usd"
    assert one(spark, E.figures(F.col("t")), t="$80k then 120k, 1,250,000 usd, 3.45 million, 2 btc 100 btc 1.2.3") == [120000, 1250000, 3450000]
    assert one(spark, E.deadline_days(F.col("t")), t="in 14 days") == 14


def test_defences(spark):
    rows = [("<b class='captcha'>", 200, "captcha"), ("captcha slow down", 429, "rate_limited"), ("Too <i>many</i> requests", 200, "rate_limited"), ("your account has been flagged", 200, "poisoned"), ("hello", 200, "ok"), (None, None, "ok")]
    df = spark.createDataFrame(rows, "h string, s int, want string").select(E.defence(F.col("h"), F.col("s")).alias("k"), "want").withColumn("a", E.action(F.col("k")))
    assert all(r.k == r.want and r.a == E.ACTIONS[r.k] for r in df.collect())
    html = '<a href="/a" style="display: none">x</a><a href="/b">do not click</a><a class="hp" href="/c">y</a><a href="/d">fine</a><a style="visibility:hidden">no link</a>'
    assert one(spark, E.hidden_links(F.col("h")), h=html) == ["/a", "/b", "/c"]


def test_names(spark):
    df = spark.createDataFrame([(" usa ",), ("new  york",), (None,), ("N/A",)], "p string").select(N.clean_place(F.col("p")).alias("r"))
    assert [r.r for r in df.collect()] == ["USA", "New York", "Unknown", "Unknown"]
    assert one(spark, N.plain_handle(F.col("h")), h="N1ght_J4r!") == "nightjar"
    day = spark.createDataFrame([("2021-01-01",), ("2024-12-30",)], "d string").select(N.week_label(F.to_date("d")).alias("a"), N.week_label(F.to_date("d"), True).alias("b")).collect()
    assert [(r.a, r.b) for r in day] == [("2020-W53", "2021-W53"), ("2025-W01", "2024-W01")]
    p = one(spark, N.price_range(F.col("t")), t="from 1.5e-3 to .25 BTC")
    assert (p.low, p.high) == (0.0015, 0.25)
    assert one(spark, N.norm_group(F.col("t")), t=" Red-Lattice 2! ") == "redlattice2" and one(spark, N.norm_group(F.col("t")), t="--") == "unknown"
    assert str(one(spark, N.parse_day(F.col("t")), t="2024-02-03 04:05:06.7")) == "2024-02-03" and one(spark, N.parse_day(F.col("t")), t="2024-13-40") is None
    assert one(spark, N.pseudonym(F.col("t"), "v-", "s", 6), t=" Acme") == "v-" + hashlib.sha256(b"s|acme").hexdigest()[:6]


def test_text_units(spark):
    df = spark.createDataFrame([("",), ("<b>One</b>",), ("a b c d e f",), ("É è",)], "t string").select(X.tokens(F.col("t")).alias("w"), X.shingles(F.col("t"), 3).alias("s")).collect()
    assert [r.w for r in df] == [[], ["one"], list("abcdef"), ["é", "è"]]
    assert [r.s for r in df] == [[], ["one"], ["a b c", "b c d", "c d e", "d e f"], ["é è"]]
    a = F.array(*[F.lit(x) for x in "abc"])
    e = F.array().cast("array<string>")
    r = spark.range(1).select(X.jaccard(a, a).alias("x"), X.jaccard(e, e).alias("y"), X.jaccard(a, e).alias("z")).first()
    assert tuple(r) == (1.0, 1.0, 0.0)
    html = "<html><body><p>x</p></body></html>"
    assert one(spark, X.skeleton(F.col("h")), h=html) == ["html", "body", "p"]

    def bits(features):
        n = [0] * 64
        for f in features:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            for i in range(64):
                n[i] += 1 if h >> i & 1 else -1
        return sum(1 << i for i in range(64) if n[i] > 0)

    assert one(spark, X.structure_hash_blake(F.col("h")), h=html) % (1 << 64) == bits(["html body p"])
    s = one(spark, X.simhash_bits(X.tag_features(F.col("h"))), h=html)
    assert s.hi == int(hashlib.md5(b"html body p").hexdigest()[:8], 16) and s.lo == int(hashlib.md5(b"html body p").hexdigest()[8:16], 16)
    sim = spark.range(1).select(X.structure_similarity(F.struct(F.lit(1).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo")), F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(3).cast("bigint").alias("lo"))).alias("r")).first().r
    assert sim == 1 - 3 / 64
    m = one(spark, X.minhash(X.shingles(F.col("t"), 2), 8), t="a b c d")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % X.PRIME for x in ("a b", "b c", "c d")]
    assert m == [min((y * a + b) % X.PRIME for y in h) for a, b in X.permutations(8)]
    same = spark.range(1).select(X.minhash_similarity(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))).alias("r")).first().r
    assert same == 0.5


def test_services(spark):
    rows = [("h1", 0, "c1", "s1", "K", "w"), ("h2", 1, "c1", "s1", "K", "w"), ("h3", 2, "c3", "s1", "K2", "w2"), ("h4", 3, "c3", "s1", "K2", "w2"), ("h5", 4, "c5", "s5", None, None), ("h6", 5, "c5", "s5", None, None)]
    df = spark.createDataFrame(rows, "host string, pos int, chash string, shash string, pgp string, btc string")
    got = {r.host: (r.role, r.same_as) for r in P.services(df).collect()}
    assert got == {"h1": ("service", None), "h2": ("mirror", "h1"), "h3": ("clone", None), "h4": ("clone", None), "h5": ("service", None), "h6": ("mirror", "h5")}


def test_canonical_and_intent(spark):
    m = spark.createDataFrame([(3, 1, True, False), (4, 1, True, True), (1, 1, False, True), (9, 2, False, False), (8, 2, False, True)], "id int, class_id int, listed boolean, keyed boolean")
    assert {r.class_id: r.canonical for r in P.canonical(m).collect()} == {1: 3, 2: 8}
    cols = "same boolean, pay boolean, differ boolean, keyless boolean, sim double, asset boolean, listed boolean"
    rows = [(True, True, False, False, 1.0, False, False), (False, True, True, False, 1.0, False, False), (False, False, False, True, 0.6, False, False), (False, False, False, True, 0.1, True, False), (False, False, False, True, 0.1, True, True)]
    got = [tuple(r.r) for r in spark.createDataFrame(rows, cols).select(P.intent(*[F.col(c.split()[0]) for c in cols.split(", ")]).alias("r")).collect()]
    assert got == [("mirror", "shared_payment"), ("clone", "payment_swap"), ("mirror", "benign_copy"), ("clone", "keyless_copy"), ("mirror", "benign_copy")]


def test_crawl(spark):
    rows = [
        ("http://a.onion/", 200, '<a href="/x">x</a><a href="http://b.onion">b</a><a href="http://clear.net">c</a>', False),
        ("http://a.onion/x", 200, '<a href="/wall">w</a>', False),
        ("http://a.onion/wall", 200, '<a href="http://c.onion/">c</a>', True),
        ("http://b.onion/", 500, '<a href="http://d.onion/">d</a>', False),
        ("http://c.onion/", 200, "end", False),
        ("http://d.onion/", 200, "never", False),
    ]
    pages = spark.createDataFrame(rows, "url string, status int, html string, needs_session boolean")
    allowed = spark.createDataFrame([(f"{x}.onion",) for x in "abcd"], "host string")
    full = {(r.url, r.depth) for r in P.crawl(pages, ["http://A.onion"], allowed).collect()}
    assert full == {("http://a.onion/", 0), ("http://a.onion/x", 1), ("http://a.onion/wall", 2), ("http://c.onion/", 3)}
    naive = {r.url for r in P.crawl(pages, ["http://a.onion"], allowed, sessions=False).collect()}
    assert naive == {"http://a.onion/", "http://a.onion/x"}
