"""Feeds, alerts, files, store and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corroborate.operators import changefeed as C
from corroborate.operators import feeds as O
from corroborate.sources import files
from corroborate.sources.store import Store, current, refresh
from corroborate.sources.tables import table
from corroborate.streaming import windows


def test_staircase_and_bluffs(spark):
    rows = [("g", "c", i, v, f) for i, (v, f) in enumerate([(100, False), (None, False), (120, False), (80, True), (80, False), (50, False)])]
    t = spark.createDataFrame(rows, "group_name string, chat_id string, seq int, figure int, final boolean")
    key = ["group_name", "chat_id"]
    assert [(r.seq, r.figure, r.step) for r in O.staircase(t, key, "seq", "figure").orderBy("seq").collect()] == [(0, 100, 1), (3, 80, 2), (5, 50, 3)]
    b = O.final_then_lower(t, key, "seq", "figure", "final").first()
    assert (b.final_at, b.final_value, b.lower_at, b.lower_value) == (3, 80, 5, 50)
    assert O.turns_after(t, key, "seq", "final", 3).count() == 0 and O.turns_after(t, key, "seq", "final", 2).first().after == 2


def test_bursts_and_taxonomy(spark):
    c = spark.createDataFrame([(f"w{i}", 10) for i in range(20)] + [("w99", 100)], "week string, n bigint")
    assert [r.week for r in O.bursts(c).where("burst").collect()] == ["w99"]
    p = spark.createDataFrame([("v", "a"), ("v", "a"), ("v", "b"), ("w", "a"), (None, "a"), ("x", None)], "v string, g string")
    assert tuple(O.taxonomy(p, "v", "g").first()) == (2, 2, 1)
    n = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "k string, n bigint")
    got = {r.k: (r["rank"], r.share) for r in O.lorenz(n, "k").collect()}
    assert got == {"a": (1, 5 / 12), "b": (2, 8 / 12), "c": (3, 11 / 12), "d": (4, 1.0)}


def test_lagged_correlation(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    a = spark.createDataFrame(list(enumerate(x)), "bucket bigint, n bigint")
    b = spark.createDataFrame([(i + 2, v) for i, v in enumerate(x)], "bucket bigint, n bigint")
    flat = spark.createDataFrame([(i, 1) for i in range(14)], "bucket bigint, n bigint")
    spine = spark.range(14).select(F.col("id").alias("bucket"))
    best = O.lagged_correlation(a, b, "bucket", "n", spine).orderBy(F.desc("r"), "lag").first()
    assert best.lag == 2 and best.r >= 0.7
    assert all(r.r == 0 for r in O.lagged_correlation(a, flat, "bucket", "n", spine).where("lag = 0").collect())


def _snapshots(spark):
    t0 = dt.datetime(2024, 1, 1)

    def at(i, *rows):
        return [(f"t{i}", t0 + dt.timedelta(days=i), t0 + dt.timedelta(days=i), *r) for r in rows]

    rows = at(
        1,
        ("victims", "slip", "s", {"status": "countdown", "deadline": "2024-02-01"}),
        ("victims", "pub", "s", {"status": "countdown"}),
        ("victims", "away", "s", {"status": "countdown"}),
        ("victims", "old", "s", {"status": "published"}),
        ("sites", "shop", None, {"state": "up", "operator": "jay"}),
        ("pages", "p1", None, {"banner": "A", "content_id": "1"}),
        ("pages", "p2", None, {"banner": "A", "content_id": "1"}),
        ("pages", "p3", None, {"banner": "A"}),
        ("mirrors", "m1", None, {"of": "s"}),
    ) + at(
        2,
        ("victims", "slip", "s", {"status": "countdown", "deadline": "2024-03-01"}),
        ("victims", "pub", "s", {"status": "published"}),
        ("victims", "fresh", "s", {"status": "teased"}),
        ("victims", "fresh", "m1", {"status": "teased"}),
        ("sites", "shop", None, {"state": "down", "operator": "jay"}),
        ("pages", "p1", None, {"banner": "B", "content_id": "1"}),
        ("pages", "p2", None, {"banner": "A", "content_id": "2"}),
        ("mirrors", "m1", None, {"of": "s"}),
        ("mirrors", "m2", None, {"of": "s"}),
        ("clones", "c1", None, {"of": "s"}),
        ("personas", "back", None, {"signed_key": "K1"}),
        ("personas", "who", None, {"signed_key": "-"}),
    )
    return spark.createDataFrame(rows, "t string, taken_at timestamp, loaded_at timestamp, section string, name string, site string, attrs map<string,string>")


def test_alerts(spark):
    watch = spark.createDataFrame([("key", "K1"), ("handle", "jay")], "kind string, value string")
    s = _snapshots(spark)
    got = {(r.type, r.name, r.surface, r.severity, r.watched, r.n_seen_on) for r in C.alerts(s, watch).collect()}
    assert got == {
        ("deadline_slip", "slip", "s", "medium", False, 0),
        ("publication", "pub", "s", "high", False, 0),
        ("withdrawal", "away", "s", "medium", False, 0),
        ("victim_removed", "old", "s", "low", False, 0),
        ("new_victim", "fresh", "s", "high", False, 2),
        ("market_down", "shop", "shop", "high", True, 0),
        ("content_change", "p2", "p2", "medium", False, 0),
        ("new_mirror", "m2", "s", "low", False, 0),
        ("new_clone", "c1", "c1", "critical", False, 0),
        ("operator_resurface", "back", "back", "critical", True, 0),
        ("new_persona", "who", "who", "low", False, 0),
    }
    assert C.change_events(s).where("name = 'p1'").count() == 1  # churn is an event but no alert
    assert C.alerts(s.limit(0), watch).count() == 0


def test_files(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "shop.html").write_text("<h1>Shop</h1>\nline")
    (d / "shop-mirror.html").write_text("<h1>Shop</h1>")
    (d / "note.txt").write_text("no page")
    assert {(r.page_id, r.listed) for r in files.read_pages(spark, str(d)).collect()} == {("shop", True), ("shop-mirror", False)}
    c = tmp_path / "chats"
    c.mkdir()
    (c / "1.json").write_text(json.dumps({"chat_id": "1", "ransom_group": "red", "messages": [{"party": " Victim", "content": "> hi"}, {"party": "x", "content": " "}, {"party": "x", "content": "call 12345678"}]}))
    (c / "2.json").write_text("{broken")
    (c / "3.json").write_text(json.dumps({"chat_id": "3", "messages": []}))
    assert {tuple(r) for r in files.read_chats(spark, str(c)).collect()} == {("red", "1", 0, "victim", "hi"), ("red", "1", 2, "operator", "call [num]")}
    f = tmp_path / "posts.json"
    f.write_text("\n".join(json.dumps(x) for x in [{"post_title": "Acme", "group_name": "Red!", "discovered": "2024-01-03 10:00:00.5"}, {"post_title": "Bolt", "group_name": None, "discovered": "2024-01-01"}, {"post_title": "", "group_name": "x", "discovered": "2024-01-01"}, {"post_title": "Zed", "group_name": "x", "discovered": "soon"}]))
    got = files.read_posts(spark, str(f)).orderBy("seq").collect()
    assert [(r.seq, r.group_name, r.ordinal) for r in got] == [(0, "unknown", 0), (1, "red", 2)]
    m = tmp_path / "m.csv"
    m.write_text("list,date,vendor,cat,subcat,subsubcat,price,from,to,goodFB,greatFB,poorFB,badFB,worstFB\nL1,2024-01-01,Bo,A,B,C,0.5 to 1.5,usa,na,TRUE,,,,\nL1,2024-01-02,Bo,A,B,C,9 9,usa,na,,,TRUE,,\n,x,,,,,,,,,,,,\n")
    r = files.read_market(spark, str(m)).first()
    assert (r.list_id, r.price_btc_low, r.price_btc_high, r.origin, r.dest, r.n_feedback, r.fb_pos, r.fb_neg) == ("L1", 0.5, 1.5, "USA", "Unknown", 2, 1, 1)
    t = tmp_path / "a.txt"
    t.write_text("1.5 x\nbad\n\n2\n")
    assert {(r.series, r.t) for r in files.read_series(spark, str(t)).collect()} == {("a", 1.5), ("a", 2.0)}
    assert "<td>&lt;b></td>" in files.html_table(spark.createDataFrame([("<b>",)], "x string"), "T")
    with pytest.raises(ValueError):
        files.html_table(spark.range(5), "T", most=3)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    t = dt.datetime(2024, 1, 1)
    s.put(spark.createDataFrame([("u1", "body", t), ("u2", "body", t + dt.timedelta(1)), ("u3", "other", t), ("u4", None, t)], "url string, body string, fetched_at timestamp"))
    s.put(spark.createDataFrame([("u5", "body", t)], "url string, body string, fetched_at timestamp"))
    assert s.objects().count() == 2 and s.provenance().count() == 4
    assert {(r.name, r.body) for r in s.export().collect()} == {("u5", "body"), ("u3", "other")}
    assert s.get(s.objects().limit(1)).count() == 1


def test_refresh(spark, tmp_path):
    p = str(tmp_path / "t")
    assert refresh(spark.range(3), p) and refresh(spark.range(5), p) and not refresh(spark.range(0), p)
    assert current(spark, p).count() == 5
    assert refresh(spark.range(7), p) and refresh(spark.range(8), p) and current(spark, p).count() == 8
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("_done-")]) == 2
    with pytest.raises(FileNotFoundError):
        current(spark, str(tmp_path / "none"))


def test_late_rows_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *at: spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a", 1.0) for h in at], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: windows.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
    rows(1, 2, 7)
    windows.run_once(stream(), out)
    rows(20)
    windows.run_once(stream(), out)
    rows(3, 21)  # 3 o'clock is hours behind the watermark: its window was written and is not touched again
    got = windows.run_once(stream(), out).orderBy("start").collect()
    assert [(r.start.hour, r.n) for r in got] == [(0, 2), (6, 1)]


def test_lagged_correlations(spark):
    r = random.Random(4)
    series = {k: [r.randrange(6) for _ in range(60)] for k in "xyz"}
    rows = [(k, t, n) for k, v in series.items() for t, n in enumerate(v) if n and t % 7]
    df = spark.createDataFrame(rows, "s string, t bigint, n bigint")
    got = {(q.a, q.b, q.lag): (q.pairs, round(q.r, 9)) for q in O.lagged_correlations(df, "s", "t", "n").collect()}
    spine = df.select("t").distinct()
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        one = O.lagged_correlation(df.where(F.col("s") == a), df.where(F.col("s") == b), "t", "n", spine)
        assert {(a, b, q.lag): (q.pairs, round(q.r, 9)) for q in one.collect()} == {k: v for k, v in got.items() if k[:2] == (a, b)}


def test_streamed_alerts(spark, tmp_path):
    watch = spark.createDataFrame([("key", "K1"), ("handle", "jay")], "kind string, value string")
    s = _snapshots(spark)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for t in ("t1", "t2"):
        s.where(F.col("t") == t).write.mode("append").parquet(src)
        stream = spark.readStream.schema(s.schema).parquet(src)
        windows.new_alerts(stream, out, watch, str(tmp_path / "ck")).awaitTermination()
    key = ["type", "name", "surface"]
    assert {tuple(r) for r in spark.read.parquet(f"{out}/alerts").select(*key).collect()} == {tuple(r) for r in C.alerts(s, watch).select(*key).collect()}


def test_order_and_partitions_dont_matter(spark, data):
    s = table(spark, data, "snapshots")
    watch = spark.createDataFrame([], "kind string, value string")
    a = {tuple(r) for r in C.alerts(s.repartition(1), watch).collect()}
    assert a == {tuple(r) for r in C.alerts(s.orderBy(F.rand(3)).repartition(7).unionByName(s), watch).collect()}
