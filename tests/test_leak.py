"""Public claims beside private talks."""

from pyspark.sql import functions as F

from corroborate.operators import leak as L


def test_bluffs(spark):
    arc = "struct<victim:string,proof_gb:double,outcome:string,tactics:array<string>>"
    arcs = spark.createDataFrame([(1, ("A", 10.0, "ongoing", ["deletion_promise"])), (2, ("B", None, "settled", [])), (9, ("Z", 1.0, "ongoing", []))], f"victim_id int, arc {arc}")
    victims = spark.createDataFrame([(1, "Acme", 60.0, "sold"), (2, "Bolt", 5.0, "sold")], "victim_id int, org string, claimed_gb double, status string")
    slid = spark.createDataFrame([(1, True), (2, False)], "victim_id int, deadline_slid boolean")
    got = {r.victim_id: (r.org, r.bluffs) for r in L.bluffs(arcs, victims, slid).collect()}
    assert got == {1: ("Acme", ["deadline_bluff", "volume_bluff", "sold_bluff", "deletion_bluff"]), 2: ("Bolt", []), 9: ("Z", [])}


def test_reposts(spark):
    e = spark.createDataFrame([(1, "a", ["x", "y"], "5"), (1, "b", ["x", "y"], "5"), (1, "c", ["x", "y", "z"], "50"), (2, "a", ["q"], "1"), (2, "b", ["r"], "1")], "victim_id int, site string, words array<string>, claim string")
    assert {(r.site_a, r.site_b, r.verdict) for r in L.repost_verdicts(e).collect()} == {("a", "b", "mirror"), ("a", "c", "clone"), ("b", "c", "clone")}


def test_bind_and_consistency(spark):
    r = spark.createDataFrame([("shop", "http://old"), ("blog", "http://b"), ("x", None)], "name string, address string")
    env = spark.createDataFrame([("ADDR_shop=http://new.onion",), ("ADDR_blog=pending",), ("noise",)], "line string")
    assert {(x.name, x.address) for x in L.bind_addresses(r, "name", "address", env).collect()} == {("shop", "http://new.onion"), ("blog", "http://b"), ("x", None)}
    t = spark.createDataFrame([("Rival wants $2,000,000 or $50",)], "t string").select(L.consistent(F.col("t"), "own", ["rival"], 1_000_000).alias("t")).first().t
    assert t == "own wants $1,000,000 or $50"


def test_naive_duplicates(spark):
    rows = [(1, True, "d1", "m1", "K", "w"), (2, False, "d1", "m1", "K", "w"), (3, False, "d3", "m1", "K2", "w2"), (4, False, "d4", "m1", "K3", None), (5, False, "d5", "m5", None, None)]
    df = spark.createDataFrame(rows, "id int, listed boolean, digest string, masked string, pgp string, btc string")
    assert {(r.id, r.canonical, r.role) for r in L.naive_duplicates(df).collect()} == {(1, 1, "canonical"), (2, 1, "mirror"), (3, 1, "clone"), (4, 4, "canonical"), (5, 5, "canonical")}


def test_gaps(spark):
    c = spark.createDataFrame([("c", "g", 80, 50, True, True, True, False), ("d", "h", 80, 50, True, False, True, True)], "chat_id string, group_name string, first_demand int, floor int, final boolean, theatre boolean, sells boolean, deletes boolean")
    p = spark.createDataFrame([("g", 100)], "group_name string, demand int")
    assert {r.chat_id: r.gaps for r in L.public_private_gap(c, p).collect()} == {"c": ["opening", "floor", "deadline"], "d": ["deletion"]}
