"""Numbers, sums of money and data volumes as people write them, parsed."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(30,8)"

#: A number with group separators (space, no-break space, comma, dot, apostrophe) or without, and decimals.
NUM = r"(?:\d{1,3}(?:[   ,.'’]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?)(?!\d)"

# fixed values: how scales and currencies are written
SCALES = {"k": 1_000, "thousand": 1_000, "grand": 1_000, "tsd": 1_000, "m": 1_000_000, "mn": 1_000_000, "mln": 1_000_000,
          "mil": 1_000_000, "mio": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000}
CURRENCIES = {"usd": "usd", "us$": "usd", "$": "usd", "dollar": "usd", "dollars": "usd", "eur": "eur", "€": "eur", "euro": "eur",
              "euros": "eur", "gbp": "gbp", "£": "gbp", "pound": "gbp", "pounds": "gbp", "btc": "btc", "xbt": "btc", "₿": "btc",
              "bitcoin": "btc", "bitcoins": "btc", "xmr": "xmr", "monero": "xmr"}
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
         "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
         "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
         "eighty": 80, "ninety": 90}
#: Things a bare number may count, which is then no sum of money.
COUNTED = "files?|folders?|archives?|servers?|people|persons?|hours?|days?|weeks?|months?|years?|minutes?|times|records?|documents?|pages?|clients?|gb|tb|mb|gib|tib|mib|kb|%"

# fixed values: megabytes of 10^6 bytes in a unit; binary units are powers of 1024 bytes, bits are eighths
VOLUMES = {"kb": "0.001", "mb": "1", "gb": "1000", "tb": "1000000", "pb": "1000000000", "kib": "0.001024", "mib": "1.048576",
           "gib": "1073.741824", "tib": "1099511.627776", "pib": "1125899906.842624", "mbit": "0.125", "gbit": "125", "tbit": "125000"}
VOLUME_NAMES = {"kilobyte": "kb", "megabyte": "mb", "gigabyte": "gb", "terabyte": "tb", "petabyte": "pb", "kibibyte": "kib", "mebibyte": "mib",
                "gibibyte": "gib", "tebibyte": "tib", "megabit": "mbit", "gigabit": "gbit", "terabit": "tbit"}


def _alternatives(words) -> str:
    return "|".join(w.replace("$", r"\$") for w in sorted(words, key=lambda w: (-len(w), w)))


_CUR = _alternatives(CURRENCIES)
_SCALE = _alternatives(SCALES)
_WORD = _alternatives([*WORDS, "hundred", "half", "quarter", "an", "a"])

_END = r"(?![^\W_])"
#: A sum of money: currency, number, scale, currency or counted thing. Not inside a word, a code or a longer number.
_MONEY = re.compile(
    rf"(?<![#\w$€£₿.,])(?<![.,]\d)(?:(?P<left>{_CUR})\s?)?(?P<num>{NUM})(?:\s?(?P<scale>{_SCALE}){_END}\.?)?"
    rf"(?:\s?(?P<right>{_CUR}){_END}|\s?(?P<thing>{COUNTED}){_END})?{_END}",
    re.IGNORECASE,
)
#: A sum written in words.
_MONEY_WORDS = re.compile(
    rf"(?<!\w)(?P<words>(?:(?:{_WORD})(?:[\s-]+and)?[\s-]+)+)(?P<scale>thousand|million|billion)(?:\s+(?P<right>{_CUR}){_END})?{_END}", re.IGNORECASE
)
_UNIT = _alternatives([*VOLUMES, *[n + s for n in VOLUME_NAMES for s in ("", "s")]])
#: A number of units of data.
_VOLUME = re.compile(rf"(?<![#\w])(?<!\d[.,])(?P<num>{NUM})\s?(?P<unit>{_UNIT}){_END}", re.IGNORECASE)


def number_value(text: Column, single_is_decimal: Column) -> Column:
    """The number written in text as DECIMAL(30,8); null where it is none. Where both separators occur, the last
    is the decimal one; one that occurs again and again groups; a single one groups if exactly three digits follow
    and single_is_decimal is false."""
    s = F.regexp_replace(text, r"[\s\u00a0\u202f'’]", "")
    last = F.regexp_extract(s, r"([.,])\d*$", 1)
    both = s.contains(".") & s.contains(",")
    single = s.rlike(r"^[^.,]*[.,][^.,]*$") & (single_is_decimal | ~s.rlike(r"[.,]\d{3}$"))
    decimal = F.concat(F.regexp_replace(F.regexp_replace(s, r"[.,]\d*$", ""), "[.,]", ""), F.lit("."), F.regexp_extract(s, r"[.,](\d*)$", 1))
    return F.when((both | single) & (last != ""), decimal).otherwise(F.translate(s, ".,", "")).try_cast(DEC)


def _number(text: str, single_is_decimal: bool) -> Decimal:
    """As number_value()."""
    s = re.sub(r"[\s'’]", "", text)
    seps = re.findall(r"[.,]", s)
    if len(set(seps)) == 2 or len(seps) == 1 and (single_is_decimal or not re.search(r"[.,]\d{3}$", s)):
        whole, part = s[: s.rindex(seps[-1])], s[s.rindex(seps[-1]) + 1 :]
        return Decimal(re.sub(r"[.,]", "", whole) + "." + part)
    return Decimal(re.sub(r"[.,]", "", s))


#: What comes right before a bare number that is a sum.
_OFFERED = re.compile(r"\b(?:pay|pays|paid|paying|offer|offers|offered|demand|demands|price is|sum of|amount of|wire|wired|transfer|transferred)\s+(?:you\s+|us\s+)?$", re.IGNORECASE)


def sums_of_money(text: str | None, least_bare: int = 10_000, least_offered: int = 1_000) -> list[tuple[str, Decimal]]:
    """(unit, amount) of the sums of money a text states, in figures or words. Counts of things are none, nor are
    bare numbers, with neither currency nor scale, under least_bare, or under least_offered right after a word of
    paying or asking."""
    found = []
    if not text:
        return found
    for m in _MONEY.finditer(text):
        if m["thing"]:
            continue
        unit = CURRENCIES.get((m["left"] or m["right"] or "").lower())
        factor = SCALES[m["scale"].lower()] if m["scale"] else 1
        amount = _number(m["num"], unit in ("btc", "xmr") or factor >= 1_000_000) * factor
        if 0 < amount < 10**20 and (unit or m["scale"] or amount >= least_bare or (amount >= least_offered and _OFFERED.search(text, 0, m.start()))):
            found.append((unit or "usd", amount))
    for m in _MONEY_WORDS.finditer(text):
        n = Decimal(0)
        for w in re.split(r"[\s-]+", m["words"].strip().lower()):
            if w == "hundred":
                n = max(n, Decimal(1)) * 100
            else:
                n += {"half": Decimal("0.5"), "quarter": Decimal("0.25")}.get(w, Decimal(WORDS.get(w, 0)))
        found.append((CURRENCIES.get((m["right"] or "").lower(), "usd"), (n or 1) * Decimal(SCALES[m["scale"].lower()])))
    return found


def _money(texts: pd.Series) -> pd.Series:
    exact = Decimal("0.00000001")
    return pd.Series([[{"unit": u, "amount": a.quantize(exact)} for u, a in sums_of_money(t)] for t in texts])


def money(text: Column) -> Column:
    """ARRAY<STRUCT<unit, amount>> of sums_of_money(); empty for null. Texts with neither a digit nor a word of
    scale don't leave the JVM."""
    none = F.array().cast(f"array<struct<unit:string,amount:{DEC}>>")
    likely = F.coalesce(text.rlike(r"\d|(?i:thousand|million|billion)"), F.lit(False))
    parsed = F.pandas_udf(_money, f"array<struct<unit:string,amount:{DEC}>>")
    return F.coalesce(parsed(F.when(likely, text)), none)


def volume_in_mb(text: str | None) -> Decimal | None:
    """Megabytes of 10^6 bytes a text states, its parts added up; None where no unit is named."""
    parts = []
    for m in _VOLUME.finditer(text or ""):
        unit = re.sub("s$", "", m["unit"].lower())
        parts.append(_number(m["num"], False) * Decimal(VOLUMES[VOLUME_NAMES.get(unit, unit)]))
    return sum(parts) if parts and sum(parts) < 10**20 else None


def _volume(texts: pd.Series) -> pd.Series:
    exact = Decimal("0.00000001")
    return pd.Series([None if (v := volume_in_mb(t)) is None else v.quantize(exact) for t in texts], dtype=object)


def volume_mb(text: Column) -> Column:
    """volume_in_mb() as DECIMAL(30,8). Texts without a digit don't leave the JVM."""
    return F.pandas_udf(_volume, DEC)(F.when(text.rlike(r"\d\s*\p{L}"), text))


def half_up(x: Column) -> Column:
    return F.round(x, 0).cast("bigint")
