"""Pair groups, conversations, percentiles."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import conversations, pair_groups, quantiles
from corroborate.sources.tables import table


def least_labels(edges, vertices):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in vertices:
        find(v)
    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


R = random.Random(7)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(600)],
    "cycle": [(i, (i + 1) % 300) for i in range(300)],
    "star": [(0, i) for i in range(1, 400)],
    "tree": [(i, (i - 1) // 2) for i in range(1, 500)],
    "dense": [(R.randrange(60), R.randrange(60)) for _ in range(600)],
    "mixed": [(i, i + 1) for i in range(100)] + [(200 + R.randrange(80), 200 + R.randrange(80)) for _ in range(90)] + [(500, i) for i in range(501, 700)] + [(50, 500)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("worthwhile", [0.05, 0.6])
def test_group_pairs(spark, name, worthwhile):
    names = {i: f"h{R.randrange(10**9)}_{i}" for i in range(720)}
    pairs = [(names[a], names[b]) for a, b in GRAPHS[name]]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:20] + [(None, names[1]), (names[2], None), (names[3], names[3])]
    df = spark.createDataFrame(pairs, "a string, b string")
    v = spark.createDataFrame([(n,) for n in names.values()] + [(None,)], "handle string")
    got = {r.handle: r.group_handle for r in pair_groups.group_pairs(df, v, worthwhile=worthwhile).collect()}
    want = least_labels([(a, b) for a, b in pairs if a and b], names.values())
    assert got == want


def test_handle_groups_cases(spark):
    rows = [("b", "a", 0.5), ("c", "d", 0.0), ("e", "f", -1.0), ("g", "h", float("nan")), ("i", "j", None), (None, "k", 1.0), ("l", None, 1.0), ("m", "m", 1.0), ("é", "z", 1.0), ("Z", "z", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, weight double").withColumn("handle", F.lit("clash"))
    got = {r.handle: r.group_handle for r in pair_groups.handle_groups(df).collect()}
    assert got == {"a": "a", "b": "a", "é": "Z", "z": "Z", "Z": "Z"} | {x: x for x in "cdefghijklm"}
    assert pair_groups.handle_groups(df.limit(0)).count() == 0


def _messages(spark, rows):
    return spark.createDataFrame(rows, "group_name string, chat_id string, seq int, party string, content string, msg_id bigint").withColumn("turn", F.lit("clash")).withColumn("part", F.lit(1))


def chat(name, turns, start=0):
    return [("g", name, s, p, c, start + i) for i, (s, p, c) in enumerate(turns)]


WHOLE = [(0, "op", "hi"), (1, " VICTIM\t", "yes"), (2, "op", "ok")]
CASES = {
    "whole": (WHOLE, [0, 1, 2]),
    "late": (list(reversed(WHOLE)), [2, 1, 0]),
    "repeat": ([*WHOLE, (1, "victim", "yes")], [0, 1, 2]),
    "blank": ([(0, "op", "hi"), (1, "victim", " \n "), (2, None, None), (3, "victim", "yes")], [0, 3]),
    "gap": ([(0, "op", "hi"), (2, "victim", "yes")], None),
    "from_one": ([(1, "op", "hi"), (2, "victim", "yes")], None),
    "clash": ([*WHOLE, (1, "victim", "no")], None),
    "two_speakers": ([*WHOLE, (1, "op", "yes")], None),
    "nameless": ([*WHOLE, (3, " ", "who?")], None),
    "no_party_at_all": ([*WHOLE, (3, None, "who?")], None),
    "one_role": ([(0, "op", "hi"), (1, "other", "ho")], None),
    "null_seq": ([*WHOLE, (None, "op", "lost")], None),
    "withheld": ([(0, "op", "[withheld]"), (1, "victim", "yes")], [0, 1]),
}


@pytest.mark.parametrize("segment", [4096, 2])
def test_conversations(spark, segment):
    rows, want = [], set()
    for i, (name, (turns, kept)) in enumerate(CASES.items()):
        rows += chat(name, turns, 100 * i)
        want |= {(name, n, 100 * i + m) for n, m in enumerate(kept or [], 1)}
    rows += [(None, None, s, p, c, 9000 + s) for s, p, c in WHOLE] + [("h", "whole", s, p, c, 9100 + s) for s, p, c in WHOLE]
    got = {(r.chat_id, r.turn, r.msg_id) for r in conversations.rebuild(_messages(spark, rows), segment).where("group_name = 'g'").collect()}
    assert got == want
    all_ = conversations.rebuild(_messages(spark, rows), segment)
    assert {(r.group_name, r.chat_id) for r in all_.where("msg_id >= 9000").collect()} == {(None, None), ("h", "whole")}
    assert {r.speaker for r in all_.where("chat_id = 'repeat' and turn = 2").collect()} == {"victim"}
    assert conversations.rebuild(_messages(spark, rows).limit(0), segment).count() == 0


def test_one_very_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("g").alias("group_name"), F.lit("c").alias("chat_id"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") % 2 == 0, "op").otherwise("victim").alias("party"), F.concat(F.lit("t"), F.col("id")).alias("content"), (n - F.col("id")).alias("msg_id"))
    got = conversations.rebuild(rows, 512).agg(F.count("*"), F.sum((F.col("turn") + F.col("msg_id") == n + 1).cast("int")), F.max("turn")).first()
    assert tuple(got) == (n, n, n)
    assert conversations.transcripts(rows, 512).agg(F.max(F.size("turns")), F.sum("n_turns")).first()[:] == (512, n)


def check_quantiles(values, told, eps):
    x = np.sort(values)
    for r in told:
        assert r.n == len(x)
        k = max(1, np.ceil(r.q * r.n))
        lo, hi = np.searchsorted(x, r.value, "left") + 1, np.searchsorted(x, r.value, "right")
        off = 0 if lo <= k <= hi else min(abs(lo - k), abs(hi - k))
        assert off <= r.rank_error + 1 and r.rank_error <= eps * r.n + 1, (r, off)


@pytest.mark.parametrize("shape", ["uniform", "ties", "skewed", "sorted"])
def test_percentiles(spark, shape):
    rng = np.random.default_rng(1)
    v = {"uniform": rng.random(60_000), "ties": rng.integers(0, 5, 60_000).astype(float), "skewed": np.exp(rng.normal(0, 4, 60_000)), "sorted": np.arange(60_000.0)}[shape]
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)], "k string, v double")
    for parts, fan in ((1, 64), (13, 3)):
        s = quantiles.sketches(df.repartition(parts), ["k"], "v", 0.02)
        told = quantiles.percentiles(quantiles.merge_sketches(s, ["k"], 0.02, fan_in=fan), ["k"], [0.0, 0.01, 0.5, 0.9, 1.0], 0.02).collect()
        for k in "ab":
            check_quantiles(np.array([x for i, x in enumerate(v) if (i % 3 > 0) == (k == "a")]), [r for r in told if r.k == k], 0.02)


def test_percentile_cases(spark):
    rows = [(None, 1.0), ("x", None), ("x", float("nan")), ("y", float("inf")), ("y", -1.0), ("y", 0.0), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit(1)).withColumn("weight", F.lit("clash"))
    told = {(r.k, r.n, r.value) for r in quantiles.percentiles(quantiles.merge_sketches(quantiles.sketches(df, ["k"], "v"), ["k"]), ["k"], [0.5]).collect()}
    assert told == {(None, 1, 1.0), ("y", 3, 0.0)}
    assert quantiles.percentiles(quantiles.merge_sketches(quantiles.sketches(df.limit(0), ["k"], "v"), ["k"]), ["k"], [0.5]).count() == 0


def test_days_combine(spark, data):
    rows = table(spark, data, "market_listings").where("category = 'Hardware'")
    daily = quantiles.merge_sketches(quantiles.sketches(rows, ["category", "list_date"], "price_btc_low"), ["category", "list_date"])
    united = daily.withColumn("part", F.pmod(F.xxhash64("list_date"), F.lit(100)).cast("int")).drop("list_date")
    told = quantiles.percentiles(quantiles.merge_sketches(united, ["category"], parts=100, fan_in=7), ["category"], [0.05, 0.5, 0.95], 0.005).collect()
    v = np.array([r.p for r in rows.where("price_btc_low is not null and not isnan(price_btc_low)").select(F.col("price_btc_low").alias("p")).collect()])
    check_quantiles(v, told, 0.005)


def test_ids_that_collide_are_drawn_anew(spark, monkeypatch):
    hashed = pair_groups._number
    monkeypatch.setattr(pair_groups, "_number", lambda c, seed: F.lit(7).cast("bigint") if seed == 0 else hashed(c, seed))
    df = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    assert {r.handle: r.group_handle for r in pair_groups.handle_groups(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
