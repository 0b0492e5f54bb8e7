"""Components, similarity joins, evidence, scores."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corroborate.operators import evidence as V
from corroborate.operators import report as R
from corroborate.operators import scoring as S
from corroborate.operators.components import components, solve_components
from corroborate.operators.ranking import greedy_route
from corroborate.operators.simjoin import _runs, near_duplicate_classes, similar_pairs, similar_texts
from oracle import compare


def union_find(edges, vertices=()):
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
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"random": [(r.randrange(300), r.randrange(300)) for _ in range(250)], "path": [(i, i + 1) for i in range(400)], "star": [(0, i) for i in range(1, 300)], "none": []}[kind]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {x.id: x.component for x in components(df, spark.range(420)).collect()}
    assert got == union_find(edges, range(420))


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_similar_pairs(spark, t):
    r = random.Random(5)
    sets = []
    for i in range(120):
        base = sets[r.randrange(len(sets))][1] if sets and r.random() < 0.6 else [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 25))]
        sets.append((i, [w for w in base if r.random() < 0.95] + ([f"w{r.randrange(60)}"] if r.random() < 0.3 else [])))
    got = {(x.x, x.y): x.jaccard for x in similar_pairs(spark.createDataFrame(sets, "id bigint, items array<string>"), t).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        a, b = set(a), set(b)
        if a and b and len(a & b) / len(a | b) >= t:
            want[i, j] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_near_duplicate_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "")], "id bigint, digest string")
    items = spark.createDataFrame([("a", list("abcdefghij")), ("b", list("abcdefghik")), ("c", list("xyz")), ("", [])], "digest string, items array<string>")
    got = {r.id: (r.class_id, r.n_links) for r in near_duplicate_classes(docs, items, 0.8).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0)}


def _profiles(spark):
    rows = [
        ("NightJar", "market", ["K1"], ["K1"], ["w1"], [1, 2, 2], ["a", "b"], "the quick note to you and the rest of it"),
        ("n1ghtjar", "leak", ["K1"], ["K1"], [], [1, 2], ["a", "b"], "the quick note to you and the rest of them"),
        ("Mirror", "forum", ["K1"], [], [], [13], ["c"], "zzz qqq"),
        ("Loner", "forum", [], [], [], [], [], ""),
    ]
    return spark.createDataFrame(rows, "handle string, surface string, displayed_keys array<string>, signed_keys array<string>, wallets array<string>, active_hours array<int>, tactics array<string>, posts string")


def test_evidence(spark):
    p = _profiles(spark)
    edges = V.all_edges(p)
    signals = {(r.a, r.b, r.signal) for r in edges.collect()}
    assert ("NightJar", "n1ghtjar", "shared_signed_key") in signals and ("NightJar", "n1ghtjar", "handle_transform") in signals
    assert ("Mirror", "NightJar", "displayed_only_key") in signals and not any(s == "displayed_only_key" and "Mirror" not in (a, b) for a, b, s in signals)
    pairs = V.pair_weights(edges)
    clusters = {r.handle: (r.cluster, r.confidence) for r in V.fuse(pairs, p.select("handle")).collect()}
    assert clusters == {"NightJar": ("NightJar", "high"), "n1ghtjar": ("NightJar", "high"), "Mirror": ("Mirror", "single"), "Loner": ("Loner", "single")}
    assert {(r.a, r.b) for r in V.framing_pairs(pairs).collect()} == {("Mirror", "NightJar"), ("Mirror", "n1ghtjar")}
    watch = {(r.kind, r.value) for r in V.watchlist(V.fuse(pairs, p.select("handle")), p).collect()}
    assert watch == {("handle", "NightJar"), ("handle", "n1ghtjar"), ("key", "K1"), ("wallet", "w1")}
    inside = spark.createDataFrame([("NightJar",), ("n1ghtjar",)], "handle string")
    assert [r.handle for r in R.framers(inside, V.framing_pairs(pairs)).collect()] == ["Mirror"]
    # naive linking merges the framed profile too
    naive = V.fuse(V.pair_weights(V.all_edges(p, naive=True)), p.select("handle"))
    truth = V.fuse(pairs, p.select("handle"))
    s = S.pair_scores(truth.select(F.col("handle").alias("id"), F.col("cluster").alias("group")), naive.select(F.col("handle").alias("id"), F.col("cluster").alias("group"))).first()
    assert (s.recall, s.false_merges) == (1.0, 2)


@pytest.mark.parametrize("w,merges", [((0.3, 0.3), False), ((0.6, 0.2), True), ((0.3, 0.3, 0.2), True), ((0.6, 0.3), True)])
def test_merge_edge(spark, w, merges):
    rows = [("a", "b", f"s{i}", x) for i, x in enumerate(w)] + [("b", "a", "s0", w[0]), ("a", "a", "x", 9.0), (None, "a", "x", 9.0), ("a", "b", "neg", -5.0)]
    pairs = V.pair_weights(spark.createDataFrame(rows, "a string, b string, signal string, weight double"))
    handles = spark.createDataFrame([("a",), ("b",)], "handle string")
    assert (V.fuse(pairs, handles).where("size = 2").count() == 2) == merges


def test_scores(spark):
    t = spark.createDataFrame([("1", "x"), ("2", "y")], "k string, v string")
    f = spark.createDataFrame([("1", "x"), ("1", "x"), ("3", "z")], "k string, v string")
    s = S.set_scores(t, f, ["k", "v"]).first()
    assert (s.matched, s.false_rows, s.recall) == (1, 1, 0.5) and s.precision == pytest.approx(1 / 3)
    a = spark.createDataFrame([(1, "1.0", "p"), (2, "x", None)], "id int, n string, s string")
    b = spark.createDataFrame([(1, "1", "q")], "id int, n string, s string")
    assert {r.field: (r.n, r.right) for r in S.field_recall(a, b, "id", ["n", "s"]).collect()} == {"n": (2, 1), "s": (1, 0)}
    truth = spark.createDataFrame([("a", "low"), ("b", "high"), ("c", "low")], "id string, level string")
    told = spark.createDataFrame([("a", "high"), ("b", "high")], "id string, level string")
    o = S.overclaims(truth, told, ["low", "moderate", "high"]).first()
    assert tuple(o) == (3, 2, 1, 1)
    roles = spark.createDataFrame([("m", "c", "mirror"), ("k", "c", "clone")], "id string, canonical string, role string")
    got = spark.createDataFrame([("c", 1, "canonical"), ("m", 1, "mirror"), ("k", 2, "clone")], "id string, cluster int, role string")
    assert S.role_recall(roles, got, "mirror").first().recall == 1.0 and S.role_recall(roles, got, "clone").first().recall == 0.0


def test_report(spark):
    claims = spark.createDataFrame([("c2", "single_soft_signal"), ("c1", "hard_identifier"), ("c0", "odd"), ("c3", "indirect_signals")], "id string, basis string")
    assert [(r.id, r.confidence) for r in R.assemble(claims).orderBy("finding").collect()] == [("c1", "high"), ("c3", "moderate"), ("c0", "low"), ("c2", "low")]


def test_greedy_route(spark):
    n = [(i, i / 10, j % 10, (j % 10) / 10) for i in range(10) for j in (i - 1, i + 1)]
    df = spark.createDataFrame(n, "node int, place double, next int, next_place double")
    got = {r.start: (r.node, r.hops) for r in greedy_route(df, spark.createDataFrame([(i, i / 10) for i in range(10)], "node int, place double"), 0.5).collect()}
    assert got[5] == (5, 0) and got[0][0] == 5 and got[0][1] == 5 and got[2] == (5, 3)


def test_components_raise_at_the_limit(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(500)], "u bigint, v bigint")
    with pytest.raises(RuntimeError):
        solve_components(df, max_rounds=1)


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from corroborate import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.95])
def test_cosine_edges_against_all_pairs(spark, least):
    r = random.Random(6)
    rows = []
    for i in range(90):
        dims = r.sample(range(24), r.randrange(0, 9)) if i % 3 else [r.randrange(3)]
        rows += [(f"p{i:02d}", k, float(r.randrange(1, 9))) for k in dims]
    rows += [("zero", 1, 0.0), (None, 1, 1.0)]
    got = {(x.a, x.b): x.sim for x in V.cosine_edges(spark.createDataFrame(rows, "id string, dim int, x double"), least, "s", 1.0).collect()}
    vec = {}
    for i, k, x in rows:
        if i and x:
            vec.setdefault(i, {})[k] = x
    norm = {i: sum(x * x for x in v.values()) ** 0.5 for i, v in vec.items()}
    want = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        sim = sum(x * vec[b].get(k, 0) for k, x in vec[a].items()) / (norm[a] * norm[b])
        if sim >= least - 0.0004:
            want[a, b] = sim
    assert all(abs(got[k] - v) < 6e-4 for k, v in want.items() if v >= least + 0.0006) and set(got) <= set(want)


@pytest.mark.parametrize("t", [0.3, 0.8])
def test_similar_texts(spark, t):
    r = random.Random(6)
    texts = {i: "".join(r.choice(["ab", "cé", "d😀", "xyz", " "]) for _ in range(r.randrange(12))) for i in range(300)}
    texts |= {1000 + i: x + r.choice(["", "ab", "q"]) for i, x in list(texts.items())[:80]}
    rows = [*texts.items(), (5000, None)]
    runs = {i: {x[k : k + 4] for k in range(len(x) - 3)} for i, x in texts.items()}
    want = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a in texts for b in texts if a < b and runs[a] and runs[b] and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= t - 1e-12}
    got = {(x.x, x.y): x.jaccard for x in similar_texts(spark.createDataFrame(rows, "id bigint, text string").repartition(5), t).collect()}
    assert want and got == pytest.approx(want)
    assert similar_texts(spark.createDataFrame([], "id bigint, text string"), t).count() == 0


def test_rings_of_titles_in_common_words(spark, tmp_path):
    """Titles whose rarest runs are common move no rows of pairs that aren't alike."""
    r = random.Random(7)
    names = sorted({"".join(r.choice(["gabo", "lunra", "wyda", "tisku", "mopex"]) for _ in range(4)) for _ in range(1500)})
    rows = [(i, f"{n} wool scarf", f"V{i % 7}") for i, n in enumerate(names)] + [(9000 + i, f"{n} wool scarfs", "V9") for i, n in enumerate(names[:40])]
    spark.createDataFrame(rows, "rec_id bigint, title string, vendor string").write.parquet(str(tmp_path / "listings.parquet"))
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = set(stages())
    assert compare(entry.queries()["resale_rings"](spark, str(tmp_path)), entry.oracle_sql()["resale_rings"], str(tmp_path)) == ""
    assert max(n for k, n in stages().items() if k not in before) < 30 * len(rows)


def test_rings_broadcast_nothing_by_estimate(spark, tmp_path):
    """Titles and their prefixes are many times what Spark estimates from the files; none goes through the driver."""
    r = random.Random(9)
    names = sorted({"".join(r.choice(["gabo", "lunra", "wyda", "tisku", "mopex"]) for _ in range(4)) for _ in range(300)})
    rows = [(i, f"{n} wool scarf", f"V{i % 7}") for i, n in enumerate(names)] + [(9000 + i, f"{n} wool scarfs", "V9") for i, n in enumerate(names[:40])]
    spark.createDataFrame(rows, "rec_id bigint, title string, vendor string").write.parquet(str(tmp_path / "listings.parquet"))
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = lambda: {x.executionId(): x.physicalPlanDescription() for x in (lambda x: [x.apply(i) for i in range(x.size())])(store.executionsList())}
    before = set(executions())
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # all joins are chosen by estimates
    try:
        assert compare(entry.queries()["resale_rings"](spark, str(tmp_path)), entry.oracle_sql()["resale_rings"], str(tmp_path)) == ""
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x for k, x in executions().items() if k not in before]
    assert any("SortMergeJoin" in x for x in plans) and not [x for x in plans if "Broadcast" in x]


@pytest.mark.parametrize("alphabet", [["a", "b", "😀"], [chr(0x4E00 + i) for i in range(20000)]])
def test_runs_of_texts(alphabet):
    r = random.Random(10)
    texts = ["", "ab", *("".join(r.choice(alphabet[: 2 + i * 60]) for _ in range(r.randrange(40))) for i in range(300)), ""]
    owner, h = _runs(pa.array(texts), 4)
    runs = [[x[k : k + 4] for k in range(len(x) - 3)] for x in texts]
    want = [(i, x) for i, found in enumerate(runs) for x in sorted(set(found))]
    named = {}
    assert [i for i, _ in want] == owner.tolist()
    assert all(named.setdefault(x, y) == y for (_, x), y in zip(want, h.tolist())) and len(set(named.values())) == len(named)
