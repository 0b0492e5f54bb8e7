"""Listings of the same product, found by reinforcing discriminative terms and pair scores in turn."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.residue import flags
from corroborate.operators.components import components
from corroborate.session import cut

# fixed values: units with their size in a base unit, number words, and the basic colours in a few languages and as abbreviated
UNITS = {"kg": ("g", 1000), "gram": ("g", 1), "grams": ("g", 1), "gramm": ("g", 1), "g": ("g", 1), "mg": ("g", 0.001), "tb": ("gb", 1000), "gb": ("gb", 1), "gig": ("gb", 1), "mb": ("gb", 0.001),
         "mm": ("mm", 1), "cm": ("mm", 10), "m": ("mm", 1000), "metre": ("mm", 1000), "meter": ("mm", 1000), "ml": ("ml", 1), "cl": ("ml", 10), "dl": ("ml", 100), "litre": ("ml", 1000),
         "liter": ("ml", 1000), "l": ("ml", 1000), "pages": ("p", 1), "pgs": ("p", 1), "pp": ("p", 1), "p": ("p", 1)}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20, "fifty": 50, "hundred": 100}
COLOURS = {"black": "black", "blk": "black", "schwarz": "black", "noir": "black", "negro": "black", "nero": "black",
           "white": "white", "wht": "white", "weiss": "white", "weiß": "white", "blanc": "white", "blanco": "white", "bianco": "white",
           "red": "red", "rot": "red", "rouge": "red", "rojo": "red", "rosso": "red", "green": "green", "grn": "green", "grün": "green", "vert": "green", "verde": "green",
           "blue": "blue", "blu": "blue", "blau": "blue", "bleu": "blue", "azul": "blue", "grey": "grey", "gray": "grey", "gry": "grey", "grau": "grey", "gris": "grey", "grigio": "grey",
           "yellow": "yellow", "ylw": "yellow", "gelb": "yellow", "jaune": "yellow", "amarillo": "yellow", "giallo": "yellow", "brown": "brown", "brn": "brown", "braun": "brown", "marron": "brown",
           "orange": "orange", "purple": "purple", "lila": "purple", "violet": "purple", "pink": "pink", "rosa": "pink"}

#: A term on a smaller share of all occurrences of terms shares its weight with the others so rare. At most 1 / RARE
#: terms are above it, whatever the input, so their weights may be held by the driver and sent to every task.
RARE = 1e-4
#: From which share of a term's occurrences on rare words one edit away are taken for misspellings of it.
SPELLED = 1e-3
#: Weights move by less than this when the rounds end.
TOLERANCE = 1e-3
#: Pairs with a score from here on are the same product.
THRESHOLD = 0.47
#: What terms that only the fuller listing of a pair has count, against those only the sparser one has.
OMITTED = 0.25

_PIECES = re.compile(rf"\bset\s+of\s+(\d+)\b|\b(\d+)[- ]?pack\b|\b(\d+)\s?(?:pcs|pieces)\b|\bx(\d+)\b|\b(\d+)x\b|\b({'|'.join(NUMBERS)})[- ]pack\b")
_SIZE = re.compile(rf"(?<![\w.])(\d+(?:[.,]\d+)?)\s?({'|'.join(sorted(UNITS, key=len, reverse=True))})\b")
# letters and digits that make up one code, however written
_CODE = re.compile(r"(?<![a-z0-9])([a-z]{2,4})[-./ ]?(\d{2,5})(?![a-z0-9%])")
_COLOUR = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(COLOURS, key=len, reverse=True))})(?![^\W_])")
_WORD = re.compile(r"[^\W_]+")
_CODED = re.compile(r"(?=.*\d)(?=.*[^\W\d_])")
_LEET = str.maketrans("013457", "oieast")
_READ = pa.struct([("attrs", pa.string()), ("words", pa.list_(pa.string()))])


def read(title: str, terms: str | None = None) -> tuple[str, list[str]]:
    """The attributes of a listing as one string (size in base units, colour, pieces; empty where stated nowhere) and
    the other words of its title. Sellers put attributes in the title or the terms; letters and digits of a code are
    joined, figures within words read as the letters they stand for."""
    s, extra = (re.sub(r"\s+", " ", x.lower()) for x in (title, terms or ""))
    pieces, size, colour = 1, "", ""
    if m := _PIECES.search(s):
        s = s[: m.start()] + " | " + s[m.end() :]
    else:
        m = _PIECES.search(extra)
    if m:
        n = next(x for x in m.groups() if x)
        pieces = NUMBERS.get(n) or min(int(n), 10**6)
    if m := _SIZE.search(s):
        s = s[: m.start()] + " | " + s[m.end() :]
    else:
        m = _SIZE.search(extra)
    if m:
        base, factor = UNITS[m[2]]
        size = f"{round(float(m[1].replace(',', '.')) * factor, 3):g}{base}"
    # a colour before figures may be the letters of a code, where no other code but another colour is stated
    codes = list(_CODE.finditer(s))
    sure = [m for m in codes if m[1] not in COLOURS]
    if not sure:
        spans = [m.span() for m in codes]
        stated = [m for m in _COLOUR.finditer(s) if not any(a <= m.start() < z for a, z in spans)]
        sure = codes if stated or _COLOUR.search(extra) else []
    for m in reversed(sure):
        s = f"{s[: m.start()]} {m[1]}{m[2]} {s[m.end() :]}"
    if m := _COLOUR.search(s):
        colour, s = COLOURS[m[0]], _COLOUR.sub(" | ", s)
    elif m := _COLOUR.search(extra):
        colour = COLOURS[m[0]]
    kept = {m[1] + m[2] for m in sure}
    words = [w if w in kept or w.isdigit() or w.isalpha() else w.translate(_LEET) for w in _WORD.findall(s)]
    return f"{size}|{colour}|{pieces}", words


def one_edit(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced, or two neighbours exchanged, leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def left_out(word: str) -> set[str]:
    """A word and all it becomes with one letter left out: two words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Lexicon:
    """The terms that aren't rare, with how rare each is (in rows or in attributes, whichever makes it rarer, so that
    the words of a product with a third of all rows still tell it, unless hardly any listing states attributes), and
    the spelling of rare words."""

    def __init__(self, terms: Iterable[tuple[str, int, int]], rows: int, attrs: int, occurrences: int):
        terms = sorted(terms, key=lambda t: (-t[1], t[0]))
        self.idf = {w: max(math.log(rows / n), math.log(attrs / c)) for w, n, c in terms}
        self.code = {w: i for i, (w, _, _) in enumerate(terms, 1)}
        most = math.log(max(rows, 2))
        self.rare = min(most, math.log(1 / RARE))
        #: terms from here on may name a product
        self.telling = min(0.4 * most, 4.85)
        self.idfs = np.array([self.rare, *(self.idf[w] for w, _, _ in terms)])
        self.forms: dict[str, list[str]] = {}
        for w, n, _ in terms:
            if n >= max(5, SPELLED * occurrences) and w.isalpha() and len(w) > 3:
                for f in left_out(w):
                    self.forms.setdefault(f, []).append(w)
        self.known: dict[str, str] = {}

    def spelled(self, word: str) -> str:
        """A rare word as the most frequent term one edit away; others as they are."""
        if word in self.code or len(word) < 3 or not word.isalpha():
            return word
        right = self.known.get(word)
        if right is None:
            near = {v for f in left_out(word) for v in self.forms.get(f, ()) if one_edit(v, word)}
            if len(self.known) > 200_000:
                self.known.clear()
            right = self.known[word] = min(near, key=lambda v: self.code[v]) if near else word
        return right

    def tells(self, word: str) -> bool:
        return self.idf.get(word, self.rare) >= self.telling

    def fullness(self, words: Iterable[str]) -> float:
        return round(sum(self.idf.get(w, self.rare) for w in set(words) if self.tells(w) or w in self.code), 6)

    def strings(self, words: list[str]) -> dict[str, bool]:
        """What may name the product: of every run of telling words the rarest, all with figures, and every two
        neighbours written together; with whether it may be misspelled (letters only, no part of a longer one)."""
        out: dict[str, bool] = {}
        run: list[str] = []
        for w in [*words, None]:
            if w is not None and self.tells(w):
                run.append(w)
                continue
            if run:
                parts = set()
                for a, b in zip(run, run[1:]):
                    if a.isalpha() and b.isalpha():
                        out[a + b] = True
                        parts |= {a, b}
                best = max(run, key=lambda x: (self.idf.get(x, self.rare), len(x), x))
                for x in run:
                    if x == best or not x.isalpha():
                        out.setdefault(x, x.isalpha() and x not in parts)
                run = []
        return out

    def compared(self, a: list[str], b: list[str]) -> tuple[list[int], list[int], list[int], bool]:
        """(both, only_a, only_b, clash) of two listings' terms by code, 0 for rare ones. Rare words one edit apart,
        or two words of one written together in the other, are the same. clash: each has a model code of its own."""
        sa, sb = dict.fromkeys(a), dict.fromkeys(b)
        both = [w for w in sa if w in sb]
        la, lb = [w for w in sa if w not in sb], [w for w in sb if w not in sa]
        if la and lb and not (all(w in self.code for w in la) and all(w in self.code for w in lb)):
            used_a: set[str] = set()
            used_b: set[str] = set()
            ys = self._spans(b, lb)
            for x, px in self._spans(a, la):
                for y, py in ys:
                    if abs(len(x) - len(y)) < 2 and used_a.isdisjoint(px) and used_b.isdisjoint(py) and not (x in self.code and y in self.code) and one_edit(x, y):
                        used_a.update(px)
                        used_b.update(py)
                        both += px if len(px) >= len(py) else py
                        break
            la, lb = [w for w in la if w not in used_a], [w for w in lb if w not in used_b]
        clash = any(_CODED.match(w) for w in la) and any(_CODED.match(w) for w in lb)
        return *([self.code.get(w, 0) for w in ws] for ws in (both, la, lb)), clash

    @staticmethod
    def _spans(words: list[str], left: list[str]) -> list[tuple[str, tuple[str, ...]]]:
        rest = set(left)
        two = [(a + b, (a, b)) for a, b in zip(words, words[1:]) if a in rest and b in rest and a.isalpha() and b.isalpha()]
        return two + [(w, (w,)) for w in left if len(w) > 1 and w.isalpha()]


def lexicon(items: DataFrame) -> Lexicon:
    """The lexicon of items(attrs, words): counts over all rows; only terms above the share RARE, 1 / RARE at most,
    come to the driver."""
    held = items.select("attrs", F.explode(F.array_distinct("words")).alias("w")).groupBy("w", "attrs").agg(F.count("*").alias("c"))
    stats = cut(held.groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("attrs")))
    rows, attrs = items.agg(F.count("*"), F.count_distinct("attrs")).first()
    total = stats.agg(F.sum("n")).first()[0] or 0
    common = stats.where((F.col("n") >= RARE * total) & (F.col("n") > 1)).collect()
    return Lexicon([tuple(r) for r in common], rows, attrs, total)


def _scores(b: pa.RecordBatch, value: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The scores of a batch of pairs, and per side the term codes and whose they are. value: of each term."""
    sides, sums = {}, {}
    for name in ("both", "only_a", "only_b"):
        lists = b.column(name)
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
        sides[name] = codes, owner
        sums[name] = np.bincount(owner, weights=value[codes], minlength=len(b))
    less, more = np.minimum(sums["only_a"], sums["only_b"]), np.maximum(sums["only_a"], sums["only_b"])
    return sums["both"] / np.maximum(sums["both"] + less + OMITTED * more, 1e-12), sides


def reinforce(pairs: DataFrame, idfs: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, max_rounds: int = 200) -> np.ndarray:
    """The weights of all terms, found in turn with the scores of pairs(both, only_a, only_b).

    A pair's score is the weight of the terms both have (weight times rarity), as a share of these and of what only
    one has; it counts as a match from the threshold on, by a steep logistic function. A term's weight is how surely
    a matching pair agrees in it, times how surely a pair that agrees in it matches: words that sellers add or leave
    out at will lose the first, words of a whole class of goods the second. Each round is one pass over the pairs
    and one aggregation of at most 1 / RARE terms; the rare ones share a weight. Rounds end when no weight moves by
    more than tolerance; if they don't, this raises.
    """
    weights = np.full(len(idfs), 0.5)
    for _ in range(max_rounds):
        value = weights * idfs

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            agree, held, shared = (np.zeros(len(value)) for _ in range(3))
            for b in batches:
                score, sides = _scores(b, value)
                match = 1 / (1 + np.exp(-14 * (score - threshold)))
                for name, (codes, owner) in sides.items():
                    m = np.bincount(codes, weights=match[owner], minlength=len(value))
                    held += m
                    if name == "both":
                        agree += m
                        shared += np.bincount(codes, minlength=len(value))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, agree[some], held[some], shared[some])], names=["code", "agree", "held", "shared"])

        told = pairs.select("both", "only_a", "only_b").mapInArrow(count, "code bigint, agree double, held double, shared double")
        rows = told.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("agree", "held", "shared")]).collect()
        if not rows:
            return weights
        agree, held, shared = (np.zeros(len(value)) for _ in range(3))
        for r in rows:
            agree[r["code"]], held[r["code"]], shared[r["code"]] = r["agree"], r["held"], r["shared"]
        # few pairs say little: each term starts with five of the average
        kept, sure = agree.sum() / held.sum(), agree.sum() / max(shared.sum(), 1)
        now = (agree + 5 * kept) / (held + 5) * (agree + 5 * sure) / (shared + 5)
        moved = np.abs(now - weights).max()
        weights = now
        if moved <= tolerance:
            return weights
    raise RuntimeError(f"the weights still move by {moved:.4f} after {max_rounds} rounds")


def matched(pairs: DataFrame, weights: np.ndarray, idfs: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """pairs plus `same`: a score from the threshold on, and no clash of model codes."""
    value = weights * idfs
    fields = [f for f in pairs.schema.fields if f.name not in ("both", "only_a", "only_b", "clash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, _ = _scores(b, value)
            same = (score >= threshold) & ~b.column("clash").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(same)], names=[*(f.name for f in fields), "same"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", same boolean")


def compare(pairs: DataFrame, known: Lexicon) -> DataFrame:
    """pairs(..., a_text, b_text) with Lexicon.compared() in place of the texts."""
    kind = pa.struct([("both", pa.list_(pa.int16())), ("only_a", pa.list_(pa.int16())), ("only_b", pa.list_(pa.int16())), ("clash", pa.bool_())])

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [known.compared(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array([dict(zip(("both", "only_a", "only_b", "clash"), x)) for x in out], type=kind)

    told = F.arrow_udf(run, "struct<both:array<smallint>,only_a:array<smallint>,only_b:array<smallint>,clash:boolean>")("a_text", "b_text")
    rest = [c for c in pairs.columns if c not in ("a_text", "b_text")]
    return pairs.select(*rest, told.alias("t")).select(*rest, "t.*")


def _stars(members: DataFrame) -> DataFrame:
    """(key, x, y, a_text, b_text): every member of a key beside the fullest listing of that key: as many pairs as
    members, however large the key. Counted partially; the hot side of the join is one that AQE may split."""
    head = members.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("pid", "text"), F.struct("full", "pid")).alias("r")).where("n > 1").select("key", F.col("r.pid").alias("x"), F.col("r.text").alias("a_text"))
    return members.join(head, "key").where("pid <> x").select("key", "x", F.col("pid").alias("y"), "a_text", F.col("text").alias("b_text"))


def _apart(members: DataFrame, alike: DataFrame, groups: DataFrame) -> DataFrame:
    """(x, y): once each, all pairs of members(key, pid) that share a key, or have keys that are alike(k1, k2), but are
    in different groups(id, component). The groups of a key are paired before its members are, so a key in which all
    are in one group gives nothing, however large it is."""
    held = cut(members.join(groups.select(F.col("id").alias("pid"), F.col("component").alias("g")), "pid"))
    parts = cut(held.select("key", "g").distinct())
    a, b = parts.select(F.col("key").alias("k1"), F.col("g").alias("g1")), parts.select(F.col("key").alias("k2"), F.col("g").alias("g2"))
    inside = a.join(b, F.col("k1") == F.col("k2")).where("g1 < g2")
    across = alike.join(a, "k1").join(b, "k2").where("g1 <> g2").select("k1", "g1", "k2", "g2")
    x, y = held.select(F.col("key").alias("k1"), F.col("g").alias("g1"), F.col("pid").alias("x")), held.select(F.col("key").alias("k2"), F.col("g").alias("g2"), F.col("pid").alias("y"))
    pairs = inside.unionByName(across).join(x, ["k1", "g1"]).join(y, ["k2", "g2"])
    return cut(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())


def same_profiles(profiles: DataFrame, known: Lexicon) -> DataFrame:
    """(u, v): links between profiles(pid, attrs, text, full) of one product.

    A profile is a distinct set of attributes and words; a product listed a million times in the same words is one.
    Candidates share their attributes and a telling string (Lexicon.strings), equal or with one letter left out, and
    each meets the fullest listing of the string first; from these pairs the weights are learned. Those a string's
    fullest listing doesn't match meet the next fullest of them, as long as a fifth of them match. What is in one
    group by then needs no more links; all other candidates are compared (_apart), so none that meets the threshold is
    left out.
    """
    kind = pa.list_(pa.struct([("s", pa.string()), ("loose", pa.bool_())]))
    strings = F.arrow_udf(lambda t: pa.array([[{"s": s, "loose": x} for s, x in sorted(known.strings(w.split()).items())] for w in t.to_pylist()], type=kind), "array<struct<s:string,loose:boolean>>")
    members = cut(profiles.select("pid", "attrs", "text", "full", F.inline(strings("text"))).withColumn("key", F.xxhash64("attrs", "s")))
    stars = cut(_stars(members.select("key", "pid", "text", "full")))

    # strings one letter apart: each beside the most frequent that it shares a form with
    node = members.where("loose and length(s) >= 5").groupBy("key", "attrs", "s").agg(F.count("*").alias("n"), F.max_by(F.struct("pid", "text"), F.struct("full", "pid")).alias("r"))
    form = F.transform(F.sequence(F.lit(0), F.length("s")), lambda i: F.xxhash64("attrs", F.when(i == 0, F.col("s")).otherwise(F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, F.length("s"))))))
    node = cut(node)
    forms = node.select("key", "n", "s", F.explode(F.array_distinct(form)).alias("form"))
    head = forms.groupBy("form").agg(F.count("*").alias("m"), F.max_by("key", F.struct("n", "s")).alias("to")).where("m > 1").select("form", "to")
    near = forms.join(head, "form").where("key <> to").select("key", "to").distinct()
    alike = cut(forms.select("form", F.col("key").alias("k1")).join(forms.select("form", F.col("key").alias("k2")), "form").where("k1 < k2").select("k1", "k2").distinct())
    near = near.join(node.select(F.col("key").alias("to"), F.col("r.pid").alias("x"), F.col("r.text").alias("a_text")), "to").join(node.select("key", F.col("r.pid").alias("y"), F.col("r.text").alias("b_text")), "key")

    columns = ["x", "y", "a_text", "b_text"]
    pairs = stars.select(columns).unionByName(near.select(columns)).where("x <> y").dropDuplicates(["x", "y"])
    pairs = cut(compare(pairs, known))
    weights = reinforce(pairs, known.idfs)
    told = cut(matched(pairs, weights, known.idfs))
    links = [told.where("same").select(F.col("x").alias("u"), F.col("y").alias("v"))]
    seen = stars.join(told, ["x", "y"])
    while True:
        tells = seen.groupBy("key").agg(F.count_if(~F.col("same")).alias("n"), F.avg(F.col("same").cast("double")).alias("share")).where("n > 1 and share >= 0.2").select("key")
        left = cut(seen.where(~F.col("same")).join(tells, "key", "left_semi").select("key", F.col("y").alias("pid")).join(members.select("key", "pid", "text", "full"), ["key", "pid"]))
        if left.isEmpty():
            break
        seen = cut(matched(compare(_stars(left), known), weights, known.idfs))
        links.append(seen.where("same").select(F.col("x").alias("u"), F.col("y").alias("v")))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    out = cut(out)
    rest = _apart(members.select("key", "pid"), alike, components(out, profiles.select(F.col("pid").alias("id"))))
    text = profiles.select("pid", "text")
    rest = rest.join(text.select(F.col("pid").alias("x"), F.col("text").alias("a_text")), "x").join(text.select(F.col("pid").alias("y"), F.col("text").alias("b_text")), "y")
    more = matched(compare(rest, known), weights, known.idfs)
    return out.unionByName(more.where("same").select(F.col("x").alias("u"), F.col("y").alias("v")))


def group_products(listings: DataFrame) -> DataFrame:
    """(listing_id, group_id): one row per listing_id that has a title without residue; equal group_ids are one
    product: same maker, model, size, colour and pieces.

    Which words name a product, which its maker and which nothing is learned from the listings (reinforce); links
    found by score are followed by connected components. Size, colour and pieces are an exact key, read by units,
    number words and colours; listings that state one nowhere are equal to each other only. A listing captured with
    several good titles counts with that of the smallest rec_id. Rows with a null listing_id or title take no part;
    listings whose title has no word left but attributes are equal if these are. Repeated rows and rows in any order
    give the same groups.
    """
    good = flags(listings, ("title",)).where("not bad_title and title is not null and listing_id is not null")
    first = good.groupBy("listing_id").agg(F.min_by(F.struct("title", "terms"), F.struct("rec_id", "title")).alias("r"))

    def attrs_and_words(titles: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("attrs", "words"), read(t, x))) for t, x in zip(titles.to_pylist(), terms.to_pylist())], type=_READ)

    items = cut(first.select("listing_id", F.arrow_udf(attrs_and_words, "struct<attrs:string,words:array<string>>")("r.title", "r.terms").alias("f")).select("listing_id", "f.*"))
    known = lexicon(items)

    def spelled(words: pa.Array) -> pa.Array:
        right = [[known.spelled(w) for w in ws] for ws in words.to_pylist()]
        return pa.array([{"text": " ".join(ws), "full": known.fullness(ws)} for ws in right], type=pa.struct([("text", pa.string()), ("full", pa.float64())]))

    told = items.select("listing_id", "attrs", F.arrow_udf(spelled, "struct<text:string,full:double>")("words").alias("w")).select("listing_id", "attrs", "w.*")
    told = cut(told.withColumn("pid", F.xxhash64("attrs", "text")))
    profiles = told.dropDuplicates(["pid"]).select("pid", "attrs", "text", "full")
    groups = components(same_profiles(profiles, known), told.select(F.col("pid").alias("id")))
    return told.join(groups, told["pid"] == groups["id"]).select("listing_id", F.col("component").alias("group_id"))


def same_product(listings: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b): each pair of different listings of one product, the smaller first. As large as
    the result must be; a join on the group key, which AQE splits where a product is hot."""
    groups = cut(group_products(listings))
    a = groups.select("group_id", F.col("listing_id").alias("listing_id_a"))
    b = groups.select("group_id", F.col("listing_id").alias("listing_id_b"))
    return a.join(b, "group_id").where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
