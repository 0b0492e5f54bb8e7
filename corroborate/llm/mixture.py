"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.encode import token_counts, tokenizer_path
from corroborate.session import cut

#: Rates tried per source and pass, and passes: each pass narrows the bracket GRID - 1 times.
GRID, PASSES = 17, 4
#: A rate at which every document gets its cap of copies: the Poisson chance of fewer is nil.
ALWAYS = 1e3


def below(k: int, rate: float) -> float:
    """The Poisson distribution function: the chance of at most k at a rate."""
    return sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1)) if rate > 0 else 1.0


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson count that is cut off at cap."""
    return sum(1 - below(k, rate) for k in range(cap))


def rate_for(mean: float, cap: int) -> float:
    """The rate at which a count cut off at cap has this mean; ALWAYS if the mean is the cap or more."""
    if mean >= cap * (1 - 1e-9):
        return ALWAYS
    lo, hi = 0.0, 64.0 + 8 * cap
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed only."""
    return F.xxhash64(doc_id, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _copies(u: Column, marks: Column) -> Column:
    """How many copies: the Poisson distribution inverted at u, cut off at the cap. marks holds the distribution
    function at 0 ... cap - 1."""
    return F.size(F.filter(marks, lambda m: u >= m))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per source of targets the Poisson rate and what it was told from; sizes(source, n_tokens, u).

    The mixture's size is total_tokens, or without it the largest at which every source that has tokens can give
    its share within its cap. Shares are relative to the sources that have tokens. The rate starts from the mean
    repetition rate (share * size / available) and is then set so that the tokens really drawn come nearest to the
    target: a larger rate never takes a copy away, so the tokens drawn grow with the rate and the bracket can be
    narrowed by one aggregation per pass. Only sums per source and tried rate come to the driver: targets is a
    fixed table of a few sources.
    """
    have = {r["source"]: (r["t"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    rows = [
        {"source": r["source"], "target_share": float(r["target_share"]), "max_repeats": int(r["max_repeats"]), "tokens": have.get(r["source"], (0, 0))[0] or 0, "documents": have.get(r["source"], (0, 0))[1]}
        for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()
    ]
    live = [r for r in rows if r["tokens"] > 0]
    weight = sum(r["target_share"] for r in live)
    size = total_tokens or min((r["max_repeats"] * r["tokens"] * weight / r["target_share"] for r in live), default=0)
    for r in rows:
        r["goal"] = size * r["target_share"] / weight if r["tokens"] > 0 else 0.0
        r["rate"] = rate_for(r["goal"] / r["tokens"], r["max_repeats"]) if r["tokens"] > 0 else 0.0
        r["bracket"] = (r["rate"] / 4, r["rate"] * 4 + 1e-9)
    open_ = [r for r in live if r["rate"] < ALWAYS]
    for _ in range(PASSES if open_ else 0):
        tried = {r["source"]: [r["bracket"][0] + (r["bracket"][1] - r["bracket"][0]) * g / (GRID - 1) for g in range(GRID)] for r in open_}
        caps = {r["source"]: r["max_repeats"] for r in open_}
        grid = sizes.sparkSession.createDataFrame(
            [(s, g, [below(k, x) for k in range(caps[s])]) for s, xs in tried.items() for g, x in enumerate(xs)], "source string, g int, marks array<double>"
        )
        by_source = grid.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("g", "marks"))).alias("grid"))
        # one partial sum per source and tried rate leaves a task
        drawn = (
            sizes.join(F.broadcast(by_source), "source")
            .select("source", "n_tokens", "u", F.inline("grid"))
            .groupBy("source", "g")
            .agg(F.sum(F.col("n_tokens") * _copies(F.col("u"), F.col("marks"))).alias("t"))
            .collect()
        )
        got = {(r["source"], r["g"]): r["t"] for r in drawn}
        for r in open_:
            xs, ts = tried[r["source"]], [got[(r["source"], g)] for g in range(GRID)]
            best = min(range(GRID), key=lambda g: (abs(ts[g] - r["goal"]), g))
            r["rate"] = xs[best]
            up = next((g for g in range(GRID) if ts[g] >= r["goal"]), GRID - 1)
            r["bracket"] = (xs[max(0, up - 1)], xs[up])
    return rows


def _sizes(documents: DataFrame, targets: DataFrame, path: str, seed: int) -> DataFrame:
    wanted = documents.join(F.broadcast(targets.select("source").where("source is not null").distinct()), "source", "left_semi").where("text is not null and text <> ''")
    return cut(wanted.select("source", token_counts(F.col("text"), path).alias("n_tokens"), uniform(F.col("doc_id"), seed).alias("u")))


def _marked(rows: list[dict], spark) -> DataFrame:
    """(source, marks): a row per source that takes part; a fixed small table."""
    data = [(r["source"], [below(k, r["rate"]) if r["rate"] < ALWAYS else 0.0 for k in range(r["max_repeats"])]) for r in rows if r["tokens"] > 0]
    return spark.createDataFrame(data, "source string, marks array<double>")


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 17, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, copy_no, text, shuffle_key) of the mixture, in the order of shuffle_key, a hash of document
    and copy: a global shuffle that is the same on every run.

    Sizes are counted once in tokens of a public tokenizer. A document is taken as often as the Poisson
    distribution of its source's rate, inverted at the document's own hash, says, but never more than max_repeats
    times. Documents of a null source or one without a target take no part, nor do null and empty texts. A target
    without documents gives nothing. Rows that repeat a doc_id are drawn alike, each as a document. Nothing is
    grouped by source, so a source with most rows is no hot spot.
    """
    path = path or tokenizer_path()
    rows = plan(_sizes(documents, targets, path, seed), targets, total_tokens)
    marks = _marked(rows, documents.sparkSession)
    drawn = documents.where("text is not null and text <> ''").select("doc_id", "source", "text").join(F.broadcast(marks), "source").withColumn("copies", _copies(uniform(F.col("doc_id"), seed), F.col("marks")))
    copies = drawn.where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")
    return copies.withColumn("shuffle_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).orderBy("shuffle_key")


def shares(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 17, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, mixed_copies, mixed_tokens, most_copies, share): what
    each source of the mixture really contributes."""
    path = path or tokenizer_path()
    sizes = _sizes(documents, targets, path, seed)
    rows = plan(sizes, targets, total_tokens)
    n = _copies(F.col("u"), F.col("marks"))
    spark = documents.sparkSession
    real = sizes.join(F.broadcast(_marked(rows, spark)), "source").withColumn("n", n).groupBy("source").agg(F.sum("n").alias("mixed_copies"), F.sum(F.col("n") * F.col("n_tokens")).alias("mixed_tokens"), F.max("n").alias("most_copies"))
    told = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["documents"], r["tokens"]) for r in rows], "source string, target_share double, max_repeats int, documents bigint, tokens bigint")
    total = real.agg(F.sum("mixed_tokens").alias("total"))
    none = {"mixed_copies": 0, "mixed_tokens": 0, "most_copies": 0}
    return told.join(real, "source", "left").fillna(none).crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("mixed_tokens"), F.col("total"))).drop("total")
