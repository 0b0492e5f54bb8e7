"""Tokens, shingles, page structure and their sketches. Numbers of hashes that must agree with SQL come from md5."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]+"
PRIME = 2_147_483_647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside a lambda an outer expression would be worked out anew for every
    element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def visible_text(html: Column) -> Column:
    """Lower-case text with tags taken out and white space collapsed."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.lower(F.trim(F.regexp_replace(bare, SPACE, " ")))


def tokens(html: Column) -> Column:
    return F.filter(F.split(visible_text(html), " "), lambda w: w != "")


def windows(items: Column, k: int) -> Column:
    """ARRAY<STRING>: each k items in a row, joined by spaces; all of them where there are fewer; none of none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        slide = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(slide)

    return let(items, of)


def shingles(html: Column, k: int = 5) -> Column:
    """The distinct k-word windows of a page's visible text."""
    return F.array_distinct(windows(tokens(html), k))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal, an empty and another are not alike at all."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def skeleton(html: Column) -> Column:
    """The opening tags' names in order, in lower case."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<[ \t\n]*([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t))


def tag_features(html: Column) -> Column:
    """Windows of three tags, repeats kept; fewer tags are one feature."""
    return windows(skeleton(html), 3)


def md5_word(text: Column, half: int = 0) -> Column:
    """32 bits of md5 as BIGINT; half 0 or 1."""
    return F.conv(F.substr(F.md5(text), F.lit(1 + 8 * half), F.lit(8)), 16, 10).cast("bigint")


def simhash_bits(features: Column) -> Column:
    """STRUCT<hi, lo>: a 64-bit similarity hash in two words of 32 bits, from md5. A bit is set if more features have
    it than not; ties and no features give 0."""

    def folded(hashes: Column) -> Column:
        n = F.size(hashes)

        def bit(i: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.call_function("shiftright", h, i).bitwiseAND(F.lit(1).cast("bigint")))
            return F.when(ones * 2 > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: bit(i)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def word(half: int) -> Column:
        return let(F.transform(features, lambda f: md5_word(f, half)), folded)

    return F.struct(word(0).alias("hi"), word(1).alias("lo"))


def structure_hash_blake(html: Column) -> Column:
    """BIGINT: the 64-bit similarity hash of a page's tag_features() from 8-byte blake2b digests, in Arrow batches."""

    def one(page: str | None) -> int:
        tags = [t.lower() for t in re.findall(r"<[ \t\n]*([a-zA-Z][a-zA-Z0-9]*)", page or "")]
        sums = [0] * 64
        for f in [" ".join(tags[i : i + 3]) for i in range(max(1, len(tags) - 2))] if tags else []:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            for i in range(64):
                sums[i] += 1 if h >> i & 1 else -1
        x = sum(1 << i for i in range(64) if sums[i] > 0)
        return x - (1 << 64) if x >> 63 else x

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in pages], dtype="int64")

    return F.pandas_udf(run, "bigint")(html)


def structure_similarity(a: Column, b: Column) -> Column:
    """1 - the share of the 64 bits that differ, of two structs of simhash_bits()."""
    return 1 - (F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))) / 64


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def minhash(items: Column, n: int = 16, seed: int = 1) -> Column:
    """ARRAY<BIGINT>: for each of n permutations x -> (a x + b) mod (2^31 - 1) the least over the items' 31-bit md5
    hashes; zeros for no items. Products stay within 62 bits."""
    perms = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in permutations(n, seed)])

    def signed(hashes: Column) -> Column:
        signature = F.transform(perms, lambda p: F.array_min(F.transform(hashes, lambda h: (h * p["a"] + p["b"]) % PRIME)))
        return F.when(F.size(hashes) == 0, F.array_repeat(F.lit(0).cast("bigint"), n)).otherwise(signature)

    return let(F.transform(items, lambda s: md5_word(s) % PRIME), signed)


def minhash_similarity(a: Column, b: Column) -> Column:
    """The share of equal places; 0 for empty signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, 0.0).otherwise(same / F.size(a))
