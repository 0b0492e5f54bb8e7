"""Template residue, filler, error messages and script notices in place of content."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.session import cut

# fixed values: what template engines, spreadsheets and programs leave behind, whatever stands inside
MARKS = r"\{\{[^{}]*\}\}|\{%[^%]*%\}|<%=?[^%]*%>|[$#]\{[^{}]+\}|\[\[[^\[\]]+\]\]|@@\w+@@|(?<![A-Za-z0-9])__[A-Z][A-Z0-9_]*__|%7B%7B.+?%7D%7D|&#123;&#123;.+?&#125;&#125;|(?<![\w%])%[A-Z][A-Z_]{2,}%|\[object \w+\]|#(?:REF|VALUE|NAME|DIV/0|N/A)[!?]|\$NaN\b|</?noscript>"
#: A single bracket may be content, so the word inside must be the name of a slot, or the corpus must show that it
#: goes with no product.
SINGLE = r"(?<![{\[<$#%&])(?:\{([A-Za-z_][\w. ]*)\}|\[([A-Za-z_][\w. ]*)\]|<([A-Za-z_][\w. ]*)>)(?![}\]>])"
SLOTS = r"(?i)(?:^|[._ ])(?:title|name|headline|heading|handle|vendor|seller|user|shop|store|price|price_usd|price usd|amount|cost|total|currency|size|weight|colou?r|capacity|model|brand|count|quantity|qty|description|category|image|url|link|date|email|item|product|listing|offer|value|text|content|placeholder)$"

# fixed values: phrases of notices that scripts are needed, of errors and of fillers, in English; other languages and
# wordings are left to the evidence of the corpus
SCRIPTS = r"(?i)\b(?:enable|activate|allow|turn\s+on|switch\s+on|unblock)\b.{0,30}?\b(?:javascript|scripts?|cookies)\b|\b(?:javascript|scripts?|cookies)\b\s+(?:(?:is|are|must be)\s+)?(?:required|disabled|blocked|needed|necessary|enabled)|\b(?:requires?|needs?)\s+(?:javascript|scripts?|cookies)|\bnot\s+run\s+scripts\b|^\W*noscript\b|\bchecking your browser\b"
ERRORS = r"(?i)\b[45]\d\d\b[\s:,-]*(?:bad gateway|forbidden|not found|unauthori[sz]ed|service unavailable|internal server error|gateway time-?out|too many requests|bad request)|\binternal server error\b|\bbad gateway\b|\bservice unavailable\b|\bgateway time-?out\b|\bconnection (?:timed out|refused|failed|reset)\b|\b(?:database|data store) connection\b|\btraceback \(most recent call|\b(?:fatal|uncaught|syntax) error:|\b(?:Key|Type|Value|Attribute|Reference)Error\b|\baccess denied\b|\bsession expired\b|\btoo many requests\b|\bsomething went wrong\b|\bpage (?:could not be|was not|not) found\b|\b(?:under|scheduled) maintenance\b|\brequest failed\b|^\W*error\s*\d{0,5}\W*$|\btime-?out:|^\W*loading\b.*(?:\.\.\.|…)\W*$|\bstack trace\b"
FILLER = r"(?i)^\W*(?:lorem\s+ipsum|dolor\s+sit\s+amet)(?:[\s,.]+(?:dolor|sit|amet|consectetur|adipiscing|elit|\d+))*\W*$|^\W*foo\W+bar\b|^\W*(?:asdf|qwerty)\b|\b(?:placeholder|fill in later|change me|replace me|goes here)\b|\b(?:your|insert|sample|example)\s+(?:product|shop|store|title|name|price|item|listing|text)\b|^\W*tbd(?:\W*$|\s+-)|^\W*untitled\b|\(draft\)|\bcopy of template\b|\btemplate (?:default|owner)\b|\bprice here\b|\bXX[.,]XX\b|^\W*(?:vendor|seller|user|shop|item|product)_(?:handle|name|title|id)(?:_here)?\W*$|_here\W*$"
#: No price speaks of these.
PRICE_NOTICE = r"(?i)javascript|\bscripts?\b|\bcookies\b"
#: A word or a run of letters again and again.
REPEATED = r"(?i)^\W*(\w{2,})(?:\W+\1)+(?:\s+\d+)?\W*$|^\W*(\w{2,6})\2+\W*$|^\W*x{3,}(?:\W+x+)*(?:\s+\d+)?\W*$"
EMPTY = r"(?i)^\W*(?:null|undefined|nan)(?:\W+(?:null|undefined|nan|none|usd|eur|gbp|btc|xmr))*\W*$|^\W*(?:usd|eur|gbp|btc|xmr)\W+(?:null|undefined|nan)\W*$"
EMPTY_TEXT = r"(?i)^\W*none(?:\W+none)*\W*$"


# fixed values: what a text must hold, in lower case, for a lexicon to match at all; looked for first, as it is cheap
SCRIPT_STEMS = ("script", "cookie", "checking your")
ERROR_STEMS = ("gateway", "forbidden", "found", "unauthori", "unavailable", "error", "request", "connection", "traceback", "denied", "expired", "wrong", "maintenance", "timeout", "time-out", "loading",
               "stack trace")
FILLER_STEMS = ("lorem", "dolor", "foo", "asdf", "qwerty", "placeholder", "fill in", "change me", "replace me", "goes here", "your", "insert", "sample", "example", "tbd", "untitled", "(draft)",
                "copy of template", "template default", "template owner", "price here", "xx.xx", "xx,xx", "_handle", "_name", "_title", "_id", "_here")

#: Log odds a phrase of the lexicons stands for, and from which a title is residue.
PHRASE = 14.0
RESIDUE = 3.0
#: How often a record is filed under another category than its goods', or names them in its slug or body by chance.
MISFILED = 0.05


def _holds(low: Column, stems: tuple[str, ...]) -> Column:
    return functools.reduce(Column.__or__, [low.contains(x) for x in stems])


def slots(text: Column) -> Column:
    """ARRAY<STRING>: the words in single brackets, in lower case."""
    found = F.regexp_extract_all(text, F.lit(SINGLE), F.lit(0))
    return F.transform(found, lambda m: F.lower(F.substr(m, F.lit(2), F.length(m) - 2)))


def marked(text: Column) -> Column:
    """Whether a text holds a mark of a template engine, the name of a slot in single brackets, or a printed empty
    value: signs that need no further evidence. Never null."""
    likely = text.rlike(r"[{\[<$#%@&_]") & (text.rlike(MARKS) | F.exists(slots(text), lambda s: s.rlike(SLOTS)))
    return F.coalesce(likely | text.rlike(EMPTY), F.lit(False))


def phrased(text: Column) -> Column:
    """Whether a text holds a phrase of a lexicon or nothing but a word or letters again and again. Never null."""
    low = F.lower(text)
    said = (_holds(low, SCRIPT_STEMS) & text.rlike(SCRIPTS)) | (_holds(low, ERROR_STEMS) & text.rlike(ERRORS)) | (_holds(low, FILLER_STEMS) & text.rlike(FILLER))
    return F.coalesce(said | text.rlike(REPEATED), F.lit(False))


def signature(text: Column) -> Column:
    """A 64-bit hash of a text without case, numbers and request marks: what copies of one message share; null where
    nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\[req [^\]]*\]", ""), r"[\d\W]+", " "))
    return F.when(bare != "", F.xxhash64(bare))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0))


def title_evidence(listings: DataFrame) -> DataFrame:
    """(sig, llr) of repeated titles: the log likelihood ratio of "a message the machinery put there" to "goods".

    Rows of one signature are compared with what the rest of their records say. Goods keep to their category, but
    for the share MISFILED; a message comes with any category, as often as all listings do. A title that takes up a
    word of its address slug or of its body speaks of the goods; one that also stands where a seller's name should is
    no goods' name, by every such row. Slug words on more than a tenth of all rows are the
    host's own and say nothing. Every row counts by its likelihood, so what a few misfiled rows or one seller's
    reposts can show doesn't depend on the size of the data: a title of goods on a thousand rows, five of them
    misfiled, is far below zero. Counted by (signature, category), partially; only slug words above the share, a few
    by construction, come to the driver.
    """
    kind = F.lower(F.trim("category"))
    definite = F.when(~kind.isin("other", "misc", "unknown", "none", "various", ""), kind)
    rows = listings.select(signature(F.col("title")).alias("sig"), definite.alias("kind"), "title", *[c if c in listings.columns else F.lit(None).cast("string").alias(c) for c in ("file_name", "terms")])
    total = rows.count()
    common = rows.select(F.explode(F.array_distinct(_words("file_name"))).alias("w")).groupBy("w").count().where(F.col("count") > 0.1 * total).select("w").collect()
    slug = F.array_except(_words("file_name"), F.array(*[F.lit(r["w"]) for r in common]).cast("array<string>"))
    agrees = F.arrays_overlap(_words("title"), F.concat(slug, _words("terms")))
    counts = cut(rows.groupBy("sig", "kind").agg(F.count("*").alias("n"), F.count_if(agrees).alias("a")))
    filed = counts.where("kind is not null")
    share = filed.groupBy("kind").agg(F.sum("n").alias("c"))
    share = share.crossJoin(F.broadcast(share.agg(F.sum("c").alias("all")))).select("kind", (F.col("c") / F.col("all")).alias("base"))  # one row beside each category
    named = listings.groupBy(signature(F.col("vendor")).alias("sig")).agg(F.count("*").alias("v")).where("sig is not null")
    repeated = counts.groupBy("sig").agg(F.sum("n").alias("n")).join(named, "sig", "left").where("sig is not null and (n > 1 or v > 0)").select("sig", F.coalesce("v", F.lit(0)).alias("v"))
    top = F.max_by(F.struct("n", "base"), F.struct("n", "kind"))
    told = filed.join(repeated, "sig").join(share, "kind").groupBy("sig").agg(F.sum("n").alias("n"), top.alias("top"), (F.sum("a") - F.max("v")).alias("a"))
    at_top = F.col("top.n") * F.log(F.col("top.base") / (1 - MISFILED + MISFILED * F.col("top.base")))
    elsewhere = (F.col("n") - F.col("top.n")) * -math.log(MISFILED)
    return told.select("sig", (at_top + elsewhere + F.col("a") * math.log(MISFILED)).alias("llr")).where((F.col("llr") >= RESIDUE) | (F.col("llr") <= RESIDUE - PHRASE))


def loose_titles(listings: DataFrame, least: int = 5, bound: float = 0.8) -> DataFrame:
    """(title_hash) of titles with a single-bracket word that goes with no product: on at least `least` rows, and no
    other word stands beside the bracket in a share `bound` of them. A word in brackets that belongs to a product's
    name always stands with the same words. Counts and joins only; the words aren't brought together."""
    words = listings.where(F.col("title").rlike(SINGLE)).select(F.xxhash64("title").alias("title_hash"), F.lower("title").alias("t"), F.explode(F.array_distinct(slots(F.col("title")))).alias("slot"))
    total = words.groupBy("slot").agg(F.count("*").alias("n"))
    beside = words.select("slot", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w")).where("w <> slot").groupBy("slot", "w").agg(F.count("*").alias("c"))
    top = beside.groupBy("slot").agg(F.max("c").alias("c"))
    loose = total.join(top, "slot", "left").where((F.col("n") >= least) & (F.coalesce("c", F.lit(0)) < bound * F.col("n")))
    return words.join(loose, "slot", "left_semi").select("title_hash").distinct()


def flags(listings: DataFrame, fields: tuple[str, ...] = ("title", "vendor", "price")) -> DataFrame:
    """listings plus bad_title, bad_vendor, bad_price, or those asked for: which field holds residue.

    A title is residue if it bears a mark (marked), if its single bracket goes with no product (loose_titles), or by
    the log odds of its phrases (phrased) and of the evidence of all rows together (title_evidence), whose message
    may be in any language. A vendor or price text that repeats a title told from the evidence is residue too, else
    marks and phrases tell. Null and blank fields hold none; prices left open by the seller aren't cases. Repeated
    rows are judged alike. Extra columns stay as they are; tables without file_name or terms are judged by the rest.
    """
    evidence = cut(title_evidence(listings))
    said = evidence.where(F.col("llr") >= RESIDUE).select("sig")
    none = F.lit(False)
    empty = lambda c: F.coalesce(F.col(c).rlike(EMPTY_TEXT), none)
    out = listings
    if "title" in fields:
        loose = loose_titles(listings).select(F.col("title_hash").alias("_title"), F.lit(True).alias("_loose"))
        out = out.withColumns({"_sig": signature(F.col("title")), "_title": F.xxhash64("title")})
        out = out.join(evidence.select(F.col("sig").alias("_sig"), F.col("llr").alias("_llr")), "_sig", "left").join(loose, "_title", "left")
        odds = F.when(phrased(F.col("title")), PHRASE).otherwise(0.0) + F.coalesce("_llr", F.lit(0.0))
        out = out.withColumn("bad_title", marked(F.col("title")) | empty("title") | F.coalesce("_loose", none) | (F.col("title").isNotNull() & (odds >= RESIDUE)))
        out = out.drop("_sig", "_title", "_llr", "_loose")
    for field, column in (("vendor", "vendor"), ("price", "price_text")):
        if field in fields:
            out = out.withColumn("_sig", signature(F.col(column))).join(said.select(F.col("sig").alias("_sig"), F.lit(True).alias("_said")), "_sig", "left")
            rest = empty(column) if field == "vendor" else F.coalesce(F.col(column).rlike(PRICE_NOTICE), none)
            out = out.withColumn(f"bad_{field}", marked(F.col(column)) | phrased(F.col(column)) | rest | F.coalesce("_said", none)).drop("_sig", "_said")
    return out


def residue(listings: DataFrame) -> DataFrame:
    """(rec_id) of the listings that hold residue in title, vendor or price_text."""
    return flags(listings).where("bad_title or bad_vendor or bad_price").select("rec_id")


def clean(listings: DataFrame) -> DataFrame:
    """The other listings."""
    return flags(listings).where("not (bad_title or bad_vendor or bad_price)").drop("bad_title", "bad_vendor", "bad_price")
