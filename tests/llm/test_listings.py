"""Residue in listings, and listings of one product."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import product_groups as G
from corroborate.llm import residue as R
from corroborate.sources.tables import table

BAD = ["{{ title }}", "${name}", "[[item.title]]", "%7B%7Btitle%7D%7D", "__TITLE__", "@@name@@", "<headline>", "[seller name]", "{% title %}", "<%= x %>", "%NAME%", "&#123;&#123;x&#125;&#125;",
       "[object Object]", "undefined undefined", "null - null", "NaN", "none (none)", "Lorem  ipsum 4", "dolor sit amet, consectetur", "asdf asdf asdf", "test test test 3", "xxxxx xxxx", "foo bar baz",
       "Your product name here", "sample title goes here 5", "untitled listing (draft)", "TBD - fill in later", "new item 1 (copy of template)", "title to be announced by template owner 6",
       "404 Not Found [req 507b9]", "Error 500: internal server error", "502 Bad Gateway", "gateway timeout (upstream 504)", "Connection timed out while contacting upstream", 
       "Traceback (most recent call last): KeyError 'title'", "Too many requests, slow down", "Please enable JavaScript to view this listing", 
       "<noscript>Activa JavaScript para continuar</noscript>", "You need to turn on scripts to use this site", "tea box {{ size }} 200 g", "tea {weight} box", "tea <colour> box"]
GOOD = ["{curly} font bundle 60p", "font bundle {curly} Hexley", "JavaScript primer e-book 300 pp", "Error 404 enamel sign 30 cm", "404 enamel sign", "lorem ipsum poster red", "poster 'lorem ipsum' 50 cm", "layout template pack 40p",
        "*** SALE *** candle", "travel router TBD 257", "usb stick 64 GB !!!", "100% original 100% original tea", "template pack by Null Works", "", "   "]


def _listings(spark, rows):
    return spark.createDataFrame(rows, "rec_id bigint, listing_id int, title string, vendor string, category string, price_text string, terms string")


def test_residue_cases(spark):
    rows = [(i, i, t, "SaltOwl", "office", "5 USD", None) for i, t in enumerate(BAD)] + [(100 + i, 100 + i, t, "NullFerry", "office", "n/a", None) for i, t in enumerate(GOOD)]
    rows += [(200 + i, 200 + i, "tea", v, None, "ask", None) for i, v in enumerate(["vendor_handle", "null null", "asdfasdf", "John Placeholder", "Shop Name (change me)", "{{vendor}}", "<handle>", "lorem ipsum", "Your shop name"])]
    rows += [(300 + i, 300 + i, "tea", "TestPost", None, p, None) for i, p in enumerate(["NaN USD", "USD undefined", "$NaN", "#REF!", "${price} EUR", "XX.XX USD", "5.10 PRICE HERE", "9.99 (template default)", "Error 503", "Loading price...", "timeout: price backend", "Preis nur mit JavaScript", "undefined", "your price", "[amount] usd"])]
    rows += [(400 + i, 400 + i, None, "ErrorKite", None, p, None) for i, p in enumerate([None, "0 USD", "negotiable", "on request", "ask", "n/a", "USD 5.20", ""])]
    got = {r.rec_id for r in R.residue(_listings(spark, rows).withColumn("loose", F.lit("clash"))).collect()}
    want = set(range(len(BAD))) | set(range(200, 209)) | set(range(300, 315))
    assert got == want, ([rows[i] for i in got - want if i < 100], sorted(got ^ want))
    assert R.residue(_listings(spark, rows).limit(0)).count() == 0
    assert R.clean(_listings(spark, rows)).count() == len(rows) - len(want)


def test_evidence_of_the_corpus(spark):
    kinds = ["office", "apparel", "hardware", "digital"]
    # an unknown message on many addresses, hosts and categories; a real title repeated in one category; brackets bound to a product or not
    rows = [(i, i, f"Bitte kommen Sie morgen wieder {i}", f"Vendor{i}", kinds[i % 4], "5 USD", None) for i in range(8)]
    rows += [(50 + i, 50 + i, "Hexley ABC 123 tea", f"Vendor{i}", "household", "5 USD", None) for i in range(8)]
    rows += [(100 + i, 100 + i, f"[zig] widget pack {i}", f"Vendor{i}", "office", "5 USD", None) for i in range(8)]
    rows += [(200 + i, 200 + i, f"{w} [frob] {v}", f"Vendor{i}", kinds[i % 4], "5 USD", None) for i, (w, v) in enumerate(zip(["red", "salt", "old", "dry", "new", "hot", "big", "wet"], ["tea", "cup", "ink", "map", "box", "pen", "hat", "jar"]))]
    # a message that stands for a vendor too; the same message on goods of one category, told by the slug or by the body
    rows += [(300 + i, 300 + i, "Veuillez patienter", "Veuillez patienter" if i else "SaltOwl", kinds[i], "5 USD", None) for i in range(3)]
    rows += [(400 + i, 400 + i, "Zangadul Komobri", f"Vendor{i}", kinds[i % 4], "5 USD", "one zangadul; escrow" if i % 2 else "zangadul") for i in range(8)]
    # five of many misfiled are no message, and a phrase that only one kind of goods bears is none either
    rows += [(1000 + i, 1000 + i, "Nelbri Renpex tea", f"Vendor{i % 9}", kinds[i] if i < 4 else "outdoor", "5 USD", None) for i in range(300)]
    rows += [(2000 + i, 2000 + i, "Access denied doormat", f"Vendor{i % 9}", "garden", "5 USD", None) for i in range(40)]
    df = _listings(spark, rows)
    want = set(range(8)) | set(range(200, 208)) | set(range(300, 303))
    assert {r.rec_id for r in R.residue(df).collect()} == want
    slugs = df.withColumn("file_name", F.when(F.col("rec_id") < 8, F.concat(F.lit("listing-kommen-sie-morgen-"), "rec_id")).otherwise(F.concat(F.lit("listing-"), F.col("rec_id"), F.lit(".html"))))
    assert {r.rec_id for r in R.residue(slugs).collect()} == want - set(range(8))


def test_evidence_alone_finds_messages(spark, data, monkeypatch):
    """Without any phrase, what repeats is still found on a larger table, and nothing else."""
    df = table(spark, data.replace("sf0.01", "sf0.1"), "listings")
    told = {r.rec_id for r in R.flags(df).where("bad_title").select("rec_id").collect()}
    monkeypatch.setattr(R, "phrased", lambda text: F.lit(False))
    alone = {r.rec_id for r in R.flags(df).where("bad_title").select("rec_id").collect()}
    assert alone <= told and len(alone) > 0.8 * len(told)
    monkeypatch.setattr(R, "title_evidence", lambda d: spark.createDataFrame([], "sig bigint, llr double"))
    marks = {r.rec_id for r in R.flags(df).where("bad_title").select("rec_id").collect()}
    assert len(marks) < 0.6 * len(told)


MAKERS = ["Corvane", "Jorvane", "Zoplif Works", "Nivaro", "Hexley"]
SYL = ["ul", "ga", "gad", "da", "lun", "rau", "tis", "pex", "zan", "bri", "mo", "ka"]
KINDS = {"candle": ("wax candle", "pillar candle"), "router": ("mini router", "travel router"), "tea": ("loose tea", "leaf tea")}


def typo(r, w):
    i = r.randrange(1, len(w) - 1)
    return r.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def corpus(seed, n):
    """Titles of invented products in the ways sellers write them, with the truth."""
    r = random.Random(seed)
    products, rows, truth = [], [], {}
    for i in range(n):
        coded = r.random() < 0.5
        kind = r.choice(list(KINDS))
        name = "".join(r.choice(SYL) for _ in range(2)).title() + " " + "".join(r.choice(SYL) for _ in range(3)).title()
        code = "".join(r.choice("ABCDEFGH") for _ in range(3)) + f"{r.randrange(1000):03d}"
        products.append((r.choice(MAKERS), code if coded else name, coded, kind, r.choice([150, 300]), r.choice(["red", "black"])))
    for lid in range(8 * n):
        m, model, coded, kind, size, colour = p = products[lid % n]
        pieces = r.choice([1, 1, 3])
        truth[lid] = (*p, pieces)
        clean = r.random() < 0.75
        maker = m if clean else typo(r, m)
        name = model[:3] + r.choice(["-", " ", "", "/"]) + model[3:] if coded else (model if clean or r.random() < 0.5 else typo(r, model))
        bits = [f"{maker} {name}" if not coded or r.random() < 0.8 else name, r.choice(KINDS[kind]), r.choice([f"{size} g", f"{size / 1000:g}kg", f"{size} gram"]), {"red": r.choice(["red", "rot", "RED"]), "black": r.choice(["blk", "Schwarz"])}[colour]]
        if pieces == 3:
            bits.append(r.choice(["x3", "3 pcs", "set of 3", "three pack", "3-pack"]))
        extra = bits.pop(2) if r.random() < 0.3 else None
        if r.random() < 0.4:
            bits.insert(0, r.choice(["great gift", "*** SALE ***"]))
        t = r.choice([" ", " - ", ", "]).join(bits)
        rows.append((lid, lid, t.upper() if r.random() < 0.1 else t, f"V{lid % 7}", None, "1 USD", f"{extra}; escrow" if extra else "escrow, 2-of-3"))
    return rows, truth


def test_products(spark):
    rows, truth = corpus(4, 120)
    rows += [(90_000, 5, "{{ title }}", "V", None, None, None), (90_001, 90_001, "[[name]]", "V", None, None, None), (90_002, None, "wax candle", "V", None, None, None), (90_003, 90_003, None, "V", None, None, None), rows[0]]
    df = _listings(spark, rows).withColumn("group_id", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r.listing_id_a, r.listing_id_b) for r in G.same_product(df).collect()}
    groups = defaultdict(list)
    for lid, p in truth.items():
        groups[p].append(lid)
    want = {tuple(sorted(x)) for ids in groups.values() for x in itertools.combinations(ids, 2)}
    right = len(got & want)
    assert right / len(want) > 0.97 and right / len(got) > 0.99, (right, len(want), len(got))
    ids = [r.listing_id for r in G.group_products(df).select("listing_id").collect()]
    assert len(ids) == len(set(ids)) == len(truth) and G.same_product(df.limit(0)).count() == 0
    again = {(r.listing_id_a, r.listing_id_b) for r in G.same_product(df.orderBy(F.rand(1)).repartition(3)).collect()}
    assert again == got


def found(spark, df):
    return {(r.listing_id_a, r.listing_id_b) for r in G.same_product(df).collect()}


def quality(got, truth):
    groups = defaultdict(list)
    for lid, p in truth.items():
        groups[p].append(lid)
    want = {tuple(sorted(x)) for ids in groups.values() for x in itertools.combinations(ids, 2)}
    return len(got & want) / len(want), len(got & want) / max(len(got), 1)


def test_scores_decide(spark, monkeypatch):
    """A constant in place of the learned weights gives other pairs, and worse ones."""
    rows, truth = corpus(8, 120)
    df = _listings(spark, rows)
    recall, precision = quality(found(spark, df), truth)
    monkeypatch.setattr(G, "reinforce", lambda pairs, idfs, **k: np.ones(len(idfs)))
    r, p = quality(found(spark, df), truth)
    assert min(recall, precision) > 0.97 and r * p < 0.9 * recall * precision


def other_catalogue(seed, n):
    """Tools and books, of other makers and in other words than any list in the library could hold."""
    r = random.Random(seed)
    brands = ["Kestrel Tools", "Bramhold", "Ovate", "Fjordmann", "Tessaly Press", "Quillon", "Hartwick", "Dunmore & Co"]
    lines = ["Falcon", "Heron", "Osprey", "Merlin", "Condor", "Harrier", "Plover", "Curlew", "Bittern", "Siskin", "Dunlin", "Avocet"]
    goods = [("cordless drill", "drill driver", "battery drill"), ("jigsaw", "jig saw tool"), ("garden shears", "hedge shears", "hand shears"), ("hardback novel", "novel, hardcover"), ("spirit level", "bubble level")]
    praise = ["brand new", "as seen on tv", "order today", "10 day returns", "clearance", "genuine part", "nice present"]
    products = [(r.choice(brands), f"{r.choice(lines)} {''.join(r.choice(SYL) for _ in range(3)).title()}" if i % 3 else f"{r.choice('KLMNPQ')}{r.choice('RSTVX')}{r.randrange(1000, 9999)}", r.randrange(5), r.choice(["", "yellow", "brown"])) for i in range(n)]
    rows, truth = [], {}
    for lid in range(7 * n):
        p = brand, model, kind, colour = products[lid % n]
        truth[lid] = p
        bits = [f"{brand} {model}", r.choice(goods[kind]), *([r.choice([colour, colour.upper()])] if colour else [])]
        r.shuffle(bits)
        for _ in range(r.randrange(3)):
            bits.insert(r.choice([0, len(bits)]), r.choice(praise))
        rows.append((lid, lid, r.choice([" ", " / ", ", "]).join(bits), f"V{lid % 11}", None, "1 USD", None))
    return rows, truth


def test_another_catalogue(spark):
    rows, truth = other_catalogue(3, 150)
    recall, precision = quality(found(spark, _listings(spark, rows)), truth)
    assert recall > 0.9 and precision > 0.9, (recall, precision)


def test_hot_product(spark):
    """A product with a third of all rows, in many wordings: no more candidate pairs than wordings, and one group."""
    r = random.Random(1)
    rows, truth = [], {}
    for i in range(900):
        name = "".join(r.choice(SYL) for _ in range(2)).title() + " " + "".join(r.choice(SYL) for _ in range(3)).title()
        truth[i] = p = r.choice(MAKERS), name, r.choice(list(KINDS)), 10 * r.randrange(1, 40), r.choice(["red", "black", "green"])
        rows.append((i, i, f"{p[0]} {name} {r.choice(KINDS[p[2]])} {p[3]} g {p[4]} {r.choice(['great gift', 'hot offer', 'new batch'])}", f"V{i % 7}", None, "1 USD", None))
    for i in range(450):
        bits = ["Hexley Ulbri Gadamokalun", r.choice(["wax candle", "pillar candle"]), r.choice(["150 g", "0.15kg"]), "red", *r.sample(["great gift", "hot offer", "limited stock", "with invoice", "new batch"], 2)]
        r.shuffle(bits)
        rows.append((10_000 + i, 10_000 + i, " ".join(bits), f"V{i % 9}", None, "1 USD", None))
        truth[10_000 + i] = ("hot",)
    recall, precision = quality(found(spark, _listings(spark, rows)), truth)
    assert recall > 0.98 and precision > 0.98, (recall, precision)


def test_words_of_one_product_agree(spark):
    known = G.Lexicon([("cold", 50, 9), ("wallet", 90, 9), ("maker", 40, 9)], 1000, 10, 9000)
    both, a, b, clash = known.compared("wallet harcor wylimtis".split(), "harcorwylimis wallet cold".split())
    assert len(both) == 3 and not a and len(b) == 1 and not clash
    assert known.compared(["abc123"], ["abc124"])[3] and not known.compared(["abc123"], ["abc123", "xyz9"])[3]
    assert known.spelled("walet") == "wallet" and known.spelled("wxyz") == "wxyz"


@pytest.mark.parametrize(
    "title,terms,attrs,words",
    [
        ("Hexley ABC-123 tea 0.2 kg x3 Schwarz", None, "200g|black|3", ["hexley", "abc123", "tea"]),
        ("zerrin rot 090 coffee", "black; 250g", "250g|black|1", ["zerrin", "rot090", "coffee"]),
        ("rot 404 enamel sign", None, "|red|1", ["404", "enamel", "sign"]),
        ("RED 100% original", "two pack", "|red|2", ["100", "original"]),
        ("H4RC0R wylimtis", "", "||1", ["harcor", "wylimtis"]),
        ("", None, "||1", []),
    ],
)
def test_read(title, terms, attrs, words):
    assert G.read(title, terms) == (attrs, words)


@pytest.mark.parametrize("a,b,want", [("abc", "abc", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "abbc", True), ("abc", "axc", True), ("abc", "xyz", False), ("abcd", "badc", False), ("", "a", True)])
def test_one_edit(a, b, want):
    assert G.one_edit(a, b) == want == G.one_edit(b, a)


def test_attributes_are_an_exact_key(spark, data):
    rows = R.flags(table(spark, data, "listings")).where("not bad_title and title is not null").select("listing_id", "rec_id", "title", "terms").collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.rec_id, r.title)):
        first.setdefault(r.listing_id, G.read(r.title, r.terms))
    pairs = found(spark, table(spark, data, "listings"))
    assert pairs and all(first[a][0] == first[b][0] for a, b in pairs)
    same = defaultdict(list)
    for lid, (attrs, words) in first.items():
        same[attrs, tuple(words)].append(lid)
    assert all(p in pairs for ids in same.values() for p in itertools.combinations(sorted(ids), 2))


def test_marks_of_any_length(spark):
    long = " | default of the listing title" * 9
    bad = ["{{ title" + long + " }}", "{% title" + long + " %}", "<%= title" + long + " %>", "${title" + long + "}", "[[title" + long + "]]", "%7B%7Btitle" + long + "%7D%7D", "&#123;&#123;title" + long + "&#125;&#125;", "@@" + "name_" * 30 + "@@",
           "__" + "TITLE_" * 30 + "X__", "%" + "NAME_" * 30 + "X%", "tea [" + "the text of a sale that has the " * 4 + "title]"]
    good = ["{{ tea" + long, "tea [" + "the text of a sale that has the " * 4 + "tin]"]
    rows = [(i, i, t, "SaltOwl", "office", "5 USD", None) for i, t in enumerate(bad + good)]
    assert {r.rec_id for r in R.residue(_listings(spark, rows)).collect()} == set(range(len(bad)))


def test_no_candidate_is_left_out(spark, monkeypatch):
    """Two wordings that the fullest listing of their string doesn't match, nor a fifth of all, still meet each other."""
    common = [f"word{c}" for c in "abcdefghijklmno"]
    known = G.Lexicon([(w, 100, 5) for w in common], 1000, 10, 9000)
    texts = [["zangadul", *common[:12]], ["zangadul", *common[12:]], [common[12], "zangadul", common[13]]]
    rows = [(i, "||1", " ".join(ws), known.fullness(ws)) for i, ws in enumerate(texts)]
    monkeypatch.setattr(G, "reinforce", lambda pairs, idfs, **k: np.ones(len(idfs)))
    links = G.same_profiles(spark.createDataFrame(rows, "pid bigint, attrs string, text string, full double"), known).collect()
    assert {frozenset((k.u, k.v)) for k in links} == {frozenset((1, 2))}
