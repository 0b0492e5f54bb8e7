"""Linking pseudonymous profiles by weighing hard identifiers against soft signals; pseudonyms only, never people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.names import plain_handle
from corroborate.functions.text import let
from corroborate.operators.components import solve_components
from corroborate.session import cut

# fixed values: words whose frequency tells a writer's habits
FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "as",
    "at", "by", "we", "i", "you", "u", "it", "is", "are", "was", "will", "shall", "would",
    "just", "so", "ok", "please", "kindly", "hence", "moreover", "whilst", "thus", "step",
    "no", "not", "do", "dont", "your", "our", "my", "this", "that", "here", "heres",
    "thats", "gonna", "wanna", "once", "every", "any", "will", "if", "then", "them",
]
HARD = ("shared_signed_key", "shared_wallet")
MERGE, STYLE, RHYTHM = 0.8, 0.45, 0.6


def shared_items(profiles: DataFrame, items: str, signal: str, weight: float, id: str = "handle") -> DataFrame:
    """(a, b, signal, weight): pairs of profiles that share an item of an array column, each once. A join on the item,
    not on all pairs; null and empty items link nothing."""
    each = profiles.select(F.col(id).alias("h"), F.explode(items).alias("item")).where("h is not null and item is not null and item <> ''").distinct()
    a, b = each.select(F.col("h").alias("a"), "item"), each.select(F.col("h").alias("b"), "item")
    return a.join(b, "item").where("a < b").select("a", "b").distinct().withColumns({"signal": F.lit(signal), "weight": F.lit(float(weight))})


def item_stars(profiles: DataFrame, items: str, signal: str, weight: float, id: str = "handle") -> DataFrame:
    """(a, b, signal, weight): each profile that has an item of an array column beside the least one that has it, once:
    as many rows as holders, whatever an item is shared by, and the same components as all pairs would give."""
    each = profiles.select(F.col(id).alias("b"), F.explode(items).alias("item")).where("b is not null and item is not null and item <> ''").distinct()
    least = each.groupBy("item").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("item", "a")
    return each.join(least, "item").where("a <> b").select("a", "b").distinct().withColumns({"signal": F.lit(signal), "weight": F.lit(float(weight))})


def identifier_edges(profiles: DataFrame, naive: bool = False) -> DataFrame:
    """Edges of profiles(handle, displayed_keys, signed_keys, wallets). A key that is displayed by both but signed
    with by neither pair is no link: weight 0, a mark of possible framing. naive takes any shared identifier."""
    if naive:
        all_ = profiles.withColumn("all", F.concat(F.coalesce("displayed_keys", F.array().cast("array<string>")), F.coalesce("signed_keys", F.array().cast("array<string>")), F.coalesce("wallets", F.array().cast("array<string>"))))
        return shared_items(all_, "all", "shared_identifier", 1.0)
    signed = shared_items(profiles, "signed_keys", HARD[0], 1.0)
    shown = shared_items(profiles, "displayed_keys", "displayed_only_key", 0.0).join(signed.select("a", "b"), ["a", "b"], "left_anti")
    return signed.unionByName(shared_items(profiles, "wallets", HARD[1], 1.0)).unionByName(shown)


def cosine_edges(vectors: DataFrame, least: float, signal: str, weight: float) -> DataFrame:
    """(a, b, sim, signal, weight) of vectors(id, dim, x) without negative entries whose cosine, rounded to three
    places, is at least `least`. Ids without weight are alike to none.

    Not all pairs that share a dimension are made: with dimensions in one order, the rarest first, two vectors as
    alike as asked share one of the first dimensions of both, up to where what remains of a vector is too short to
    reach the threshold by itself. Only pairs that do are worked out in full; the result is exact.
    """
    cut_at = max(least - 0.000501, 1e-9) ** 2
    rows = vectors.where("id is not null and dim is not null and x > 0")
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    held = rows.groupBy("dim").agg(F.count("*").alias("df"))
    unit = cut(rows.join(norm, "id").join(held, "dim").select("id", "dim", "x", "df", "norm"))
    w = Window.partitionBy("id").orderBy("df", "dim").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("x") * F.col("x") / (F.col("norm") * F.col("norm"))).over(w), F.lit(0.0))
    first = unit.withColumn("left", 1 - before).where(F.col("left") >= cut_at - 1e-9).where("df > 1").select("id", "dim")
    pairs = first.withColumnRenamed("id", "a").join(first.withColumnRenamed("id", "b"), "dim").where("a < b").select("a", "b").distinct()
    va, vb = (unit.select(F.col("id").alias(k), "dim", F.col("x").alias(f"x{k}"), F.col("norm").alias(f"n{k}")) for k in "ab")
    dot = pairs.join(va, "a").join(vb, ["b", "dim"]).groupBy("a", "b", "na", "nb").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    sim = F.round(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), 3)
    return dot.select("a", "b", sim.alias("sim")).where(F.col("sim") >= least).withColumns({"signal": F.lit(signal), "weight": F.lit(float(weight))})


def rhythm_edges(profiles: DataFrame) -> DataFrame:
    """Profiles(handle, active_hours) active at the same hours of day."""
    hours = profiles.select(F.col("handle").alias("id"), F.explode("active_hours").alias("dim")).where("dim between 0 and 23").groupBy("id", "dim").agg(F.count("*").cast("double").alias("x"))
    return cosine_edges(hours, RHYTHM, "rhythm", 0.3)


def word_frequencies(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, dim, x): the share of each function word among all words of an id's texts."""
    words = texts.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))).alias("dim"))
    counts = words.groupBy("id", F.when(F.col("dim").isin(*FUNCTION_WORDS), F.col("dim")).alias("dim")).agg(F.count("*").alias("n"))
    total = counts.groupBy("id").agg(F.sum("n").alias("all"))
    return counts.where("dim is not null").join(total, "id").select("id", "dim", (F.col("n") / F.col("all")).alias("x"))


def trigram_frequencies(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, dim, x): the share of each run of three characters, white space collapsed and case ignored. Counted per
    text first, so that only distinct trigrams of a text leave a task."""
    s = F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " ")
    chars = F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0))

    def grams(c: Column) -> Column:
        # the text beside itself moved by one and two places: linear, where substr would count from the start each time
        n = F.size(c)
        two = F.zip_with(c, F.slice(c, F.lit(2), n), lambda x, y: F.concat(x, y))
        three = F.zip_with(two, F.slice(c, F.lit(3), n), lambda x, y: F.concat(x, y))
        return F.filter(three, lambda g: g.isNotNull())

    each = texts.select(F.col(id).alias("id"), s.alias("s")).where(F.length("s") >= 3).select("id", F.explode(let(chars, grams)).alias("dim"))
    counts = each.groupBy("id", "dim").agg(F.count("*").alias("n"))
    total = counts.groupBy("id").agg(F.sum("n").alias("all"))
    return counts.join(total, "id").select("id", "dim", (F.col("n") / F.col("all")).alias("x"))


def style_similarity(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(a, b, sim): half the cosine of function words and half that of trigrams, rounded to three places."""

    # rounding happens once, on the mean; the parts are kept exact
    def exact(v: DataFrame, name: str) -> DataFrame:
        norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        a, b = v.select(F.col("id").alias("a"), "dim", F.col("x").alias("xa")), v.select(F.col("id").alias("b"), "dim", F.col("x").alias("xb"))
        dot = a.join(b, "dim").where("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
        full = dot.join(norm.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b")
        return full.select("a", "b", F.try_divide(F.col("dot"), F.col("na") * F.col("nb")).alias(name))

    fw, tri = exact(word_frequencies(texts, id, text), "fw"), exact(trigram_frequencies(texts, id, text), "tri")
    both = fw.join(tri, ["a", "b"], "full_outer")
    return both.select("a", "b", F.round(0.5 * F.coalesce("fw", F.lit(0.0)) + 0.5 * F.coalesce("tri", F.lit(0.0)), 3).alias("sim"))


def style_edges(profiles: DataFrame, least: float = STYLE) -> DataFrame:
    return style_similarity(profiles, "handle", "posts").where(F.col("sim") >= least).withColumns({"signal": F.lit("stylometry"), "weight": F.lit(0.6)})


def handle_edges(profiles: DataFrame) -> DataFrame:
    """Handles equal without look-alike digits, case and marks."""
    keyed = profiles.select("handle", F.array(plain_handle(F.col("handle"))).alias("plain"))
    return shared_items(keyed, "plain", "handle_transform", 0.3)


def lookalike_handles(profiles: DataFrame) -> DataFrame:
    """(a, b, signal, weight): handles whose plain forms are at most one edit apart. They share a form with one letter
    left out, which is what is joined; the edit distance is checked on the few pairs that do."""
    p = profiles.select("handle", plain_handle(F.col("handle")).alias("p")).where("p <> ''").distinct()
    cutoff = F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.concat(F.substr(F.col("p"), F.lit(1), i - 1), F.substr(F.col("p"), i + 1)))
    each = p.select("handle", "p", F.explode(F.array_distinct(F.concat(F.array("p"), cutoff))).alias("d"))
    a, b = each.select(F.col("handle").alias("a"), F.col("p").alias("pa"), "d"), each.select(F.col("handle").alias("b"), F.col("p").alias("pb"), "d")
    pairs = a.join(b, "d").where("a < b").where(F.levenshtein("pa", "pb", 1) >= 0)
    return pairs.select("a", "b").distinct().withColumns({"signal": F.lit("handle_lookalike"), "weight": F.lit(1.0)})


def tactic_edges(profiles: DataFrame) -> DataFrame:
    """Equal, non-empty sequences of tactics."""
    keyed = profiles.where(F.size("tactics") > 0).select("handle", F.array(F.array_join("tactics", "|")).alias("t"))
    return shared_items(keyed, "t", "tactic_sequence", 0.2)


def all_edges(profiles: DataFrame, naive: bool = False) -> DataFrame:
    keep = ["a", "b", "signal", "weight"]
    parts = [identifier_edges(profiles, True), lookalike_handles(profiles)] if naive else [identifier_edges(profiles), style_edges(profiles), rhythm_edges(profiles), handle_edges(profiles), tactic_edges(profiles)]
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return out


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight, signals, hard, displayed): evidence per pair, a < b. Weights are added as decimals, so the sum
    doesn't depend on the order; null, NaN and negative weights add nothing; null ends and self pairs are dropped."""
    good = edges.where("a is not null and b is not null and a <> b")
    w = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(0).cast("decimal(10,4)")
    pairs = good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "signal", w.alias("w"))
    each = pairs.groupBy("a", "b", "signal").agg(F.max("w").alias("w"))  # repeated evidence of one kind counts once
    return each.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.array_join(F.array_sort(F.collect_list("signal")), ",").alias("signals"), F.max(F.col("signal").isin(*HARD)).alias("hard"), F.max(F.col("signal") == "displayed_only_key").alias("displayed"))


def framing_pairs(pairs: DataFrame, merge: float = MERGE) -> DataFrame:
    """Pairs whose only tie may be a key one of them doesn't control."""
    return pairs.where(F.col("displayed") & (F.col("weight") < F.lit(merge).cast("decimal(10,4)"))).select("a", "b")


def fuse(pairs: DataFrame, handles: DataFrame, merge: float = MERGE) -> DataFrame:
    """(handle, cluster, size, confidence): clusters of handles joined by pairs of weight merge or more, named by their
    least handle. confidence is single, high (all joined by pairs with a hard identifier) or medium."""
    ids = cut(handles.where("handle is not null").distinct().sort("handle").select("handle", F.monotonically_increasing_id().alias("id")))
    strong = cut(
        pairs.where(F.col("weight") >= F.lit(merge).cast("decimal(10,4)"))
        .join(ids.select(F.col("handle").alias("a"), F.col("id").alias("u")), "a")
        .join(ids.select(F.col("handle").alias("b"), F.col("id").alias("v")), "b")
        .select("u", "v", "hard")
    )
    roots = solve_components(strong.select("u", "v")).withColumnRenamed("root", "r")
    hard = solve_components(strong.where("hard").select("u", "v")).withColumnRenamed("root", "h")
    each = ids.join(roots, "id", "left").join(hard, "id", "left").select("handle", F.coalesce("r", "id").alias("r"), F.coalesce("h", "id").alias("h"))
    each = cut(each)
    info = each.groupBy("r").agg(F.min("handle").alias("cluster"), F.count("*").alias("size"), F.count_distinct("h").alias("parts"))
    conf = F.when(F.col("size") == 1, "single").when(F.col("parts") == 1, "high").otherwise("medium")
    return each.join(info, "r").select("handle", "cluster", "size", conf.alias("confidence"))


def watchlist(clusters: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, value): the handles, signed keys and wallets of clusters of high confidence."""
    sure = profiles.join(clusters.where("confidence = 'high'").select("handle"), "handle", "left_semi")
    key = sure.select(F.lit("key").alias("kind"), F.explode("signed_keys").alias("value"))
    wallet = sure.select(F.lit("wallet").alias("kind"), F.explode("wallets").alias("value"))
    return sure.select(F.lit("handle").alias("kind"), F.col("handle").alias("value")).unionByName(key).unionByName(wallet).where("value <> ''").distinct()
