"""Names, dates, places and prices as feeds spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(name: Column, prefix: str, salt: str, width: int = 12) -> Column:
    """prefix and the first hex digits of a salted hash. Few digits collide soon: six from about 5,000 names on."""
    return F.concat(F.lit(prefix), F.substr(F.sha2(F.concat(F.lit(salt), F.lit("|"), F.lower(F.trim(name))), 256), F.lit(1), F.lit(width)))


def norm_group(name: Column) -> Column:
    """Lower-case letters and digits only; `unknown` if none are left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", ""), F.lit("")), F.lit("unknown"))


def parse_day(text: Column) -> Column:
    """A date from a timestamp with or without fractions, a date, or any text that starts with one; else null."""
    return F.try_to_date(F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def clean_place(text: Column) -> Column:
    """White space collapsed; what means nothing becomes Unknown; acronyms in capitals, else each word capitalised."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " "))
    low = F.lower(s)
    return F.when(low.isin("", "na", "n/a", "none", "-"), "Unknown").when(low.isin("usa", "eu", "uk", "us"), F.upper(s)).otherwise(F.initcap(low))


def price_range(text: Column) -> Column:
    """STRUCT<low, high>: the first two numbers of a price text; nulls if there are fewer."""
    nums = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?"), F.lit(0))
    two = F.size(nums) >= 2
    pick = lambda i: F.when(two, F.get(nums, F.lit(i)).try_cast("double"))
    return F.struct(pick(0).alias("low"), pick(1).alias("high"))


def rating_class(good: Column, bad: Column) -> Column:
    """pos, neg or neu; pos wins."""
    return F.when(good, "pos").when(bad, "neg").otherwise("neu")


def plain_handle(handle: Column) -> Column:
    """A handle without look-alike digits, case and marks."""
    return F.regexp_replace(F.translate(F.lower(handle), "130457", "ieoast"), r"[^\p{L}\p{N}]", "")


def week_label(day: Column, parity: bool = False) -> Column:
    """Year and ISO week. parity labels with the calendar year, which is wrong around New Year."""
    year = F.year(day) if parity else F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def months_between_parts(text: Column, year: int, month: int, day: int) -> Column:
    """Months from a date written yyyy-MM[-dd] to a given one, a month counted as 30 days, at least half a month;
    null where there is no date."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{2})(?:-(\d{2}))?", i)
    months = (F.lit(year) - part(1).try_cast("int")) * 12 + (F.lit(month) - part(2).try_cast("int")) + (F.lit(day) - F.coalesce(part(3).try_cast("int"), F.lit(1))) / 30.0
    return F.greatest(months, F.lit(0.5))
