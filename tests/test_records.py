"""Numbers, units, snapshot differences."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corroborate.functions.numbers import number_value, sums_of_money, volume_in_mb
from corroborate.operators.snapshot_diff import canonical_map, snapshot_diff
from corroborate.operators.units import pairwise_scales, propagate, quantities, snap
from corroborate.sources.tables import table

MONEY = [
    ("We could raise 400000 USD, no more.", [("usd", 400000)]),
    ("carry 810k. Ref #810k1", [("usd", 810000)]),
    ("US$ 0.925 mln, no", [("usd", 925000)]),
    ("settle at 16,73 BTC, room 29", [("btc", "16.73")]),
    ("Pay BTC 47 now and US$ 290,000 in 10 days", [("btc", 47), ("usd", 290000)]),
    ("340 Tsd. Euro today", [("eur", 340000)]),
    ("Between a million and three hundred thousand dollars", [("usd", 1000000), ("usd", 300000)]),
    ("one and a half million dollars, half a million or a quarter million", [("usd", 1500000), ("usd", 500000), ("usd", 250000)]),
    ("seven hundred and fifty thousand is", [("usd", 750000)]),
    ("54236 files from 64 of your servers, case 39-28", []),
    ("440.000 €, 945,000.00 USD, 1.250.000 USD, 4 000 000 $", [("eur", 440000), ("usd", 945000), ("usd", 1250000), ("usd", 4000000)]),
    ("XMR 5910.6. £90k", [("xmr", "5910.6"), ("gbp", 90000)]),
    ("", []),
    (None, []),
    ("x" * 100_000 + " 50k", [("usd", 50000)]),
]
VOLUMES = [("1,8 TB", 1800000), ("1,264 gb", 1264000), ("555.150 MB", 555150), ("1 TB 900 GB", 1900000), ("18 folders and 875 GB of mail", 875000), ("1800 gigabit", 225000), ("2438 GiB", "2617782.566912"), ("4", None), ("all of it", None), (None, None)]


@pytest.mark.parametrize("text,want", MONEY)
def test_money(text, want):
    assert sorted(sums_of_money(text)) == sorted((u, Decimal(a)) for u, a in want)


@pytest.mark.parametrize("text,want", VOLUMES)
def test_volume(text, want):
    assert volume_in_mb(text) == (None if want is None else Decimal(want))


def test_number_value(spark):
    rows = [("1,264", 1264.0), ("1,8", 1.8), ("1.250.000,50", 1250000.5), ("1,250,000.5", 1250000.5), ("12 000", 12000.0), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want double").select(number_value(F.col("t"), F.lit(False)).cast("double").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def _quantity_tables(spark):
    ts = dt.datetime(2024, 1, 5)
    messages = spark.createDataFrame(
        [
            (1, "g", "Pay 10 BTC or 5 BTC or 10 btc.", [], ts),  # a repeated sum is one row
            (2, "g", None, [200, 200, None], ts),
            (3, "g", "  \n", [300], ts),
            (4, "g", "[withheld]", None, ts),
            (5, "h", "hello", [9], ts),
            (6, None, None, [7], ts),
            (7, "g", "3 BTC", [], None),  # no month, no rate
        ],
        "msg_id bigint, group_name string, content string, amounts array<bigint>, sent_at timestamp",
    ).withColumn("unit", F.lit("clash"))
    victims = spark.createDataFrame(
        [
            (1, 1, 5.0, "5 GB", "s"),
            (2, 2, 7.0, None, "s"),
            (3, 3, -1.0, None, "s"),
            (4, 4, float("nan"), "all of it", "s"),
            (5, 5, 8.0, "undisclosed", "s"),
            (6, 6, None, "", None),
            (7, 7, 2.0, None, "unknown"),
        ],
        "rec_id bigint, victim_id int, claimed_gb double, claim_text string, site string",
    )
    rates = spark.createDataFrame([("btc", "2024-01", 40000.0), ("eur", "2024-01", 1.1)], "unit string, rate_month string, usd_per_unit double")
    units = spark.createDataFrame([("g", "money", "usd_thousand"), ("s", "volume", "tb")], "origin_name string, quantity string, unit string")
    return messages, victims, rates, units


def test_quantities_cases(spark):
    got = {tuple(r) for r in quantities(*_quantity_tables(spark)).collect()}
    assert got == {("messages", 1, 400000), ("messages", 1, 200000), ("messages", 2, 200000), ("messages", 3, 300000), ("messages", 6, 7), ("victims", 1, 5000), ("victims", 2, 7000000), ("victims", 7, 2000)}


def test_quantities_empty(spark):
    m, v, r, u = _quantity_tables(spark)
    assert quantities(m.limit(0), v.limit(0), r, u).count() == 0


def test_quantities_against_plain_python(spark, data):
    import duckdb

    con = duckdb.connect()
    rates = {(u, m): Decimal(str(x)) for u, m, x in con.execute(f"SELECT * FROM '{data}/unit_rates.parquet'").fetchall()}
    units = {(o, q): u for o, q, u in con.execute(f"SELECT * FROM '{data}/source_units.parquet'").fetchall()}
    half = lambda x: int((x + Decimal("0.5")).to_integral_value(rounding="ROUND_FLOOR"))
    want = set()
    for i, g, c, a, m in con.execute(f"SELECT msg_id, group_name, content, amounts, strftime(sent_at, '%Y-%m') FROM '{data}/messages.parquet'").fetchall():
        if c is None or not c.strip() or c.strip().lower() == "[withheld]":
            u = units[g, "money"]
            f = {"usd": Decimal(1), "usd_thousand": Decimal(1000), "usd_cent": Decimal("0.01")}.get(u) or rates[u, m]
            want |= {("messages", i, half(Decimal(x) * f)) for x in a or []}
        else:
            want |= {("messages", i, half(x * (1 if u == "usd" else rates[u, m]))) for u, x in sums_of_money(c)}
    mb = {"gb": 1000, "tb": 1000000, "mb": 1, "gib": Decimal("1073.741824"), "tib": Decimal("1099511.627776")}
    for i, s, n, t in con.execute(f"SELECT rec_id, site, claimed_gb, claim_text FROM '{data}/victims.parquet'").fetchall():
        v = volume_in_mb(t)
        if v is None and n is not None and n == n and n > 0 and not (t and t.strip() and not any(ch.isdigit() for ch in t)):
            v = Decimal(str(n)) * mb[units[s, "volume"]]
        if v is not None:
            want.add(("victims", i, half(v)))
    got = [tuple(r) for r in quantities(*[table(spark, data, n) for n in ("messages", "victims", "unit_rates", "source_units")]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_source_graph(spark):
    rows = [(f"e{i}", s, float((i + 1) * f)) for i in range(20) for s, f in (("anchor", 1000), ("b", 1), ("c", 0.001)) if not (s == "c" and i < 10 or s == "anchor" and i >= 15)]
    rows += [("e1", "b", 77777.0), ("e2", "b", None), ("e3", "b", float("nan")), ("e3", None, 1.0)]  # wrong and missing values
    obs = spark.createDataFrame(rows, "entity string, source string, value double")
    edges = pairwise_scales(obs).withColumn("scale", snap(F.col("scale"), {"k": 1000, "m": 0.001, "mm": 1e-6, "one": 1})).where("scale is not null and a <> 'anchor' or b <> 'c'")
    found = {r.source: (r.factor, r.hops) for r in propagate(edges, spark.createDataFrame([("anchor", 1.0)], "source string, factor double")).collect()}
    assert found["b"] == (1000.0, 1) and found["c"][0] == pytest.approx(1e6) and found["c"][1] == 2


def test_offsets_are_found_and_carried(spark):
    rows = [(f"e{i}", s, f(50.0 + 7 * i)) for i in range(40) for s, f in (("anchor", lambda v: v), ("b", lambda v: 1.8 * v + 32), ("c", lambda v: (1.8 * v + 32) * 10)) if not (s == "c" and i < 12 or s == "anchor" and i >= 28)]
    rows += [("e1", "b", 1e6), ("e2", "b", 3.0)]
    edges = pairwise_scales(spark.createDataFrame(rows, "entity string, source string, value double")).where("a <> 'anchor' or b <> 'c'")
    found = {r.source: r for r in propagate(edges, spark.createDataFrame([("anchor", 1.0)], "source string, factor double")).collect()}
    assert found["c"].hops == 2
    for v in (80.0, 300.0):
        assert found["b"].factor * (1.8 * v + 32) + found["b"].shift == pytest.approx(v, rel=1e-6)
        assert found["c"].factor * 10 * (1.8 * v + 32) + found["c"].shift == pytest.approx(v, rel=1e-6)


def test_units_nobody_declares(spark):
    """No declared unit at all: feeds told from their messages, sites over several hops and with an offset."""
    day = lambda m: dt.datetime(2024, m, 5)
    feeds = {"k": lambda u, m: u // 1000, "cents": lambda u, m: u * 100, "coin": lambda u, m: round(u / (40000 * m)), "usd": lambda u, m: u}
    messages, want = [], set()
    for g, f in feeds.items():
        for i in range(60):
            usd, m = 400_000 * (i + 1), 1 + i % 2
            messages.append((len(messages), g, f"we want ${usd}", [f(usd, m) if i % 9 else 777], day(m)))
            want.add(("messages", len(messages) - 1, usd))
        messages.append((len(messages), g, None, [f(8_000_000, 2)], day(2)))
        want.add(("messages", len(messages) - 1, {"coin": 8_000_000}.get(g, 8_000_000)))
    victims = []
    for i in range(40):
        gb = 50 + 7 * i
        if i < 25:
            victims += [(i, None, f"{gb} GB", "near"), (i, gb * 1e6 / 1e6, None, "near")]  # in GB, with and without unit
        if i >= 15:
            victims.append((i, gb * 1000.0, None, "far"))  # in MB, linked through near only
            victims.append((i, float(gb), None, "near"))
        victims.append((i, 2.0 * gb * 1000 + 5000, None, "odd"))  # twice as much and an offset, linked through far
    rows = [(n, *v) for n, v in enumerate(victims)]
    want |= {("victims", n, (50 + 7 * v[0]) * 1000) for n, v in enumerate(victims)}
    m = spark.createDataFrame(messages, "msg_id bigint, group_name string, content string, amounts array<bigint>, sent_at timestamp")
    v = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], "rec_id bigint, victim_id int, claimed_gb double, claim_text string, site string")
    rates = spark.createDataFrame([("btc", "2024-01", 40000.0), ("btc", "2024-02", 80000.0)], "unit string, rate_month string, usd_per_unit double")
    none = spark.createDataFrame([], "origin_name string, quantity string, unit string")
    assert {tuple(r) for r in quantities(m, v, rates, none).collect()} == want


def test_small_sums_that_are_offered():
    assert sums_of_money("We can pay 9500 today") == [("usd", Decimal(9500))] and sums_of_money("We offer 4 files and 9500 rows") == []


def test_snapshot_diff_cases(spark):
    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    rows = [
        ("t2", t0, t0, "s", "same", "x", {"a": "1", "b": "-"}),
        ("t10", t0 + day, t0 + day, "s", "same", "x", {"b": None, "a": "1"}),  # a missing value in another spelling
        ("t2", t0, t0, "s", "gone", "x", {"a": "1"}),
        ("t10", t0 + day, t0 + day, "s", "new", "x", {"a": "1"}),
        ("t2", t0, t0, "s", "fixed", "x", {"a": "1"}),
        ("t2", t0, t0 + day, "s", "fixed", "x", {"a": "2"}),  # a correction loaded later counts
        ("t10", t0 + day, t0 + day, "s", "fixed", "x", {"a": "2"}),
        ("t2", t0, t0, "s", "moved", None, {"a": "1"}),
        ("t10", t0 + day, t0 + day, "s", "moved", None, {"a": "3"}),
        ("t10", t0 + day, t0 + day, "s", "moved", None, {"a": "3"}),
        ("t10", t0 + day, t0 + day, None, None, None, None),
        (None, t0, t0, "s", "lost", "x", {}),
    ]
    df = spark.createDataFrame(rows, "t string, taken_at timestamp, loaded_at timestamp, section string, name string, site string, attrs map<string,string>").withColumn("pos", F.lit(9)).withColumn("change", F.lit("clash"))
    got = {(r.t_from, r.t_to, r.name, r.change) for r in snapshot_diff(df, ["section", "name", "site"], canonical_map(F.col("attrs"))).collect()}
    assert got == {("t2", "t10", "gone", "removed"), ("t2", "t10", "new", "added"), ("t2", "t10", "moved", "changed"), ("t2", "t10", None, "added")}
    assert snapshot_diff(df.limit(0), ["section", "name", "site"], canonical_map(F.col("attrs"))).count() == 0
