"""Exact set-similarity joins without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators.components import solve_components
from corroborate.session import cut

#: Runs of characters are counted in so many cells, whatever the input; the driver holds these counts.
CELLS = 1 << 18


def similar_pairs(sets: DataFrame, threshold: float, id: str = "id", items: str = "items") -> DataFrame:
    """(x, y, jaccard) of every two different rows of sets(id, items) whose distinct items have a Jaccard similarity
    of at least threshold. Exact: no pair is lost.

    Items are ordered by how many sets hold them, rarest first. Two sets as alike as threshold must share one of the
    first n - ceil(threshold * n) + 1 items of each, so only these prefixes are joined, with a filter on the sizes
    (the smaller at least threshold times the larger); rare items come first, so blocks are small. Candidates are
    then verified on the whole sets. Sets without items are alike to none here. ids must be unique.
    """
    hashed = sets.select(F.col(id).alias("id"), F.transform(F.array_distinct(F.col(items)), lambda s: F.xxhash64(s)).alias("h")).where(F.size("h") > 0)
    each = hashed.select("id", F.size("h").alias("n"), F.explode("h").alias("item"))
    df = each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # items of a single set can't be shared; they count for the size only, and stand before all others
    shared = each.join(df, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    single = F.col("n") - F.size("o")
    prefix = F.slice(F.col("o"), F.lit(1), F.greatest(keep - single, F.lit(0)).cast("int"))
    ordered = cut(shared.select("id", "n", prefix.alias("prefix"), F.array_sort(F.transform("o", lambda s: s["item"])).alias("h")))
    heads = ordered.select("id", "n", F.explode("prefix").alias("p")).select("id", "n", "p.item")
    a = heads.select(F.col("id").alias("x"), F.col("n").alias("nx"), "item")
    b = heads.select(F.col("id").alias("y"), F.col("n").alias("ny"), "item")
    near = (F.col("x") < F.col("y")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9)
    candidates = a.join(b, "item").where(near).select("x", "y", "nx", "ny").distinct()
    whole = candidates.join(ordered.select(F.col("id").alias("x"), F.col("h").alias("hx")), "x").join(ordered.select(F.col("id").alias("y"), F.col("h").alias("hy")), "y")
    common = F.size(F.array_intersect("hx", "hy"))
    return whole.select("x", "y", (common / (F.col("nx") + F.col("ny") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def _runs(texts: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct runs of characters of a batch of texts, by text and, within it, by characters."""
    strings = texts.to_pylist()
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.maximum(sizes - run + 1, 0)
    owner = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(len(owner)) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(counts) - counts), counts)
    known = np.zeros(int(chars.max(initial=0)) + 1, dtype=bool)
    known[chars] = True
    alphabet = np.flatnonzero(known)
    width = len(alphabet).bit_length()
    if run * width + len(strings).bit_length() < 64:  # text and characters fit one number
        code = (np.cumsum(known) - 1)[chars]
        key = owner
        for i in range(run):
            key = key << width | code[at + i]
        key = np.sort(key)
        key = key[np.diff(key, prepend=-1) != 0]
        owner = key >> run * width
        columns = [alphabet[key >> (run - 1 - i) * width & (1 << width) - 1] for i in range(run)]
    else:
        columns = [chars[at + i] for i in range(run)]
        order = np.lexsort((*reversed(columns), owner))
        columns, owner = [c[order] for c in columns], owner[order]
        first = np.ones(len(owner), dtype=bool)
        first[1:] = np.any([c[1:] != c[:-1] for c in (owner, *columns)], axis=0)
        columns, owner = [c[first] for c in columns], owner[first]
    h = np.zeros(len(owner), dtype=np.uint64)
    for c in columns:  # each step is a bijection of what was before and the character
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return owner, h


def similar_texts(texts: DataFrame, threshold: float, run: int = 4) -> DataFrame:
    """(x, y, jaccard) of every two different rows of texts(id BIGINT, text), for many short texts, whose distinct runs
    of `run` characters have a Jaccard similarity of at least threshold. Exact: no pair is lost.

    The same prefix filter as similar_pairs, over any order of the runs exact: here by how many texts hold a run, as
    counted in a fixed number of cells, so runs themselves are never shuffled. A row of a prefix also holds one bit per
    residue of a hash, the parity of the runs there: two texts differ in at least as many runs as these bits differ,
    and pairs that differ too much go within the join. Only texts of what is left are fetched and compared. Texts
    shorter than a run are alike to none here; null texts take no part. ids must be unique.

    Spark takes the prefixes for as small as the texts, and texts for as small as their compressed files, and would
    broadcast either through the driver; the joins are told to shuffle both sides instead.
    """
    texts = texts.select("id", "text").where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            _, h = _runs(b.column("text"), run)
            n += np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["cell", "n"])

    told = texts.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(CELLS, dtype=np.int64)
    held[told["cell"].to_numpy()] = told["n"].to_numpy()
    rank = np.empty(CELLS, dtype=np.int32)
    rank[np.argsort(held, kind="stable")] = np.arange(CELLS)
    alone = int((held < 2).sum())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, h = _runs(b.column("text"), run)
            n = np.bincount(owner, minlength=len(b))
            start = np.cumsum(n) - n
            bits = np.zeros(len(b), dtype=np.uint64)
            if len(h):
                bits[n > 0] = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), start[n > 0])
            cell = rank[(h % np.uint64(CELLS)).astype(np.int64)].astype(np.int64)
            # by text, cell and characters; the last are the order the runs come in
            size = len(h).bit_length()
            key = np.sort((owner * CELLS + cell) << size | np.arange(len(h)))
            order = key & (1 << size) - 1
            keep = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            # what a single text holds can't be shared
            taken = order[(np.arange(len(h)) < np.repeat(start + keep, n)) & (cell[order] >= alone)]
            whose = owner[taken]
            ids = b.column("id").take(pa.array(whose))
            # half a hash does for the join: runs that share it only make candidates
            yield pa.RecordBatch.from_arrays([pa.array(h[taken].astype(np.uint32).view(np.int32)), pa.array(bits[whose].view(np.int64)), ids, pa.array(n[whose].astype(np.int32))], names=["item", "bits", "id", "n"])

    # a small number stands last, where its zeros and those that begin the next row are compressed together
    heads = texts.mapInArrow(prefixes, "item int, bits bigint, id bigint, n int")
    a = heads.select("item", F.col("bits").alias("bx"), F.col("id").alias("x"), F.col("n").alias("nx"))
    b = heads.select("item", F.col("bits").alias("by"), F.col("id").alias("y"), F.col("n").alias("ny"))
    # what leaves out the most comes first
    near = F.bit_count(F.col("bx").bitwiseXOR(F.col("by"))) <= (F.col("nx") + F.col("ny")) * (1 - threshold) / (1 + threshold) + 1e-9
    near &= (F.col("x") < F.col("y")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9)
    candidates = a.join(b.hint("merge"), "item").where(near).select("x", "y").distinct()
    whole = candidates.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")).hint("merge"), "x").join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")).hint("merge"), "y")
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - run + 1), lambda i: F.substr(F.col(c), i, F.lit(run))))
    sets = whole.select("x", "y", runs("tx").alias("rx"), runs("ty").alias("ry"))
    common = F.size(F.array_intersect("rx", "ry"))
    return sets.select("x", "y", (common / (F.size("rx") + F.size("ry") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def near_duplicate_classes(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(id, class_id, n_links): every document with the least id of its class and how many other documents it is
    linked to. docs(id, digest): equal digests are exact copies; items(digest, items) has one row per digest.

    Copies are made one before the join, so a text copied a million times is one row of it; links between different
    texts count the copies on the other side, and copies are linked to each other.
    """
    size = cut(docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")))
    pairs = cut(similar_pairs(items, threshold, "digest", "items"))
    both = pairs.select(F.col("x").alias("digest"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("digest"), F.col("x").alias("other")))
    linked = both.join(size.select(F.col("digest").alias("other"), "copies"), "other").groupBy("digest").agg(F.sum("copies").alias("elsewhere"))
    numbered = size.select("digest", F.col("first").alias("v"))
    edges = pairs.join(numbered.select(F.col("digest").alias("x"), F.col("v").alias("u")), "x").join(numbered.withColumnRenamed("digest", "y"), "y").select("u", "v")
    roots = cut(solve_components(edges))
    least = roots.groupBy("root").agg(F.min("id").alias("class_id"))
    named = roots.join(least, "root").select(F.col("id").alias("first"), "class_id")
    classes = size.join(named, "first", "left").join(linked, "digest", "left").select("digest", F.coalesce("class_id", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("elsewhere", F.lit(0))).alias("n_links"))
    return docs.join(classes, "digest").select("id", "class_id", "n_links")


def structural_pairs(pages: DataFrame, most_bits: int = 9) -> DataFrame:
    """(x, y, bits) of pages(id, hi, lo, asset) that share an asset and whose structure hashes differ in at most
    most_bits bits. The join is on the asset, never on all pairs."""
    a = pages.select(F.col("id").alias("x"), F.col("hi").alias("xh"), F.col("lo").alias("xl"), "asset")
    b = pages.select(F.col("id").alias("y"), F.col("hi").alias("yh"), F.col("lo").alias("yl"), "asset")
    bits = F.bit_count(F.col("xh").bitwiseXOR(F.col("yh"))) + F.bit_count(F.col("xl").bitwiseXOR(F.col("yl")))
    return a.join(b, "asset").where("x < y").select("x", "y", bits.alias("bits")).where(F.col("bits") <= most_bits).distinct()
