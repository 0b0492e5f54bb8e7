"""Quantities recorded in different units: linking sources by the entities they share, and converting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.numbers import DEC, VOLUMES, half_up, money, number_value, volume_mb
from corroborate.session import cut


def pairwise_scales(obs: DataFrame, tolerance: float = 0.02, min_links: int = 3) -> DataFrame:
    """(a, b, scale, offset, links, agreement) of every two sources that record the same entities:
    value_b = scale * value_a + offset.

    obs(entity, source, value): several values of an entity in a source are first reduced to their median, so an
    entity meets itself at most once per source pair and the join can't grow with repeated or hot entities. Two
    models are fitted robustly: a pure scale, the median of value_b / value_a (up to half of the links may be wrong),
    and a scale with an offset, from the quartiles of both sides and the median of what remains. The one within whose
    tolerance the larger share of links lies (agreement) is taken, the pure scale if they are equal. Pairs with fewer
    than min_links common entities are left out. Null, NaN, infinite, zero and negative values take no part.
    """
    good = obs.where("entity is not null and source is not null and value > 0 and value < double('infinity') and not isnan(value)")
    one = good.groupBy("entity", "source").agg(F.percentile_approx("value", 0.5, 10_000).alias("value"))
    a = one.select("entity", F.col("source").alias("a"), F.col("value").alias("x"))
    b = one.select("entity", F.col("source").alias("b"), F.col("value").alias("y"))
    pairs = a.join(b, "entity").where(F.col("a") < F.col("b"))
    q = F.array(*[F.lit(v) for v in (0.25, 0.75)])
    at = lambda c, i: F.element_at(F.col(c), i)
    fits = (
        pairs.groupBy("a", "b")
        .agg(F.percentile_approx(F.col("y") / F.col("x"), 0.5, 10_000).alias("ratio"), F.percentile_approx("x", q, F.lit(10_000)).alias("qx"), F.percentile_approx("y", q, F.lit(10_000)).alias("qy"), F.count("*").alias("links"))
        .where(F.col("links") >= min_links)
        .withColumn("slope", F.coalesce(F.try_divide(at("qy", 2) - at("qy", 1), at("qx", 2) - at("qx", 1)), F.col("ratio")))
        .drop("qx", "qy")
    )
    both = pairs.join(fits, ["a", "b"])
    rest = both.groupBy("a", "b").agg(F.percentile_approx(F.col("y") - F.col("slope") * F.col("x"), 0.5, 10_000).alias("rest"))
    near = lambda y: F.avg((F.abs(y - F.col("y")) <= tolerance * F.col("y")).cast("double"))
    told = both.join(rest, ["a", "b"]).groupBy("a", "b", "ratio", "slope", "rest", "links").agg(near(F.col("ratio") * F.col("x")).alias("pure"), near(F.col("slope") * F.col("x") + F.col("rest")).alias("affine"))
    better = F.col("affine") > F.col("pure")
    return told.select(
        "a", "b", F.when(better, F.col("slope")).otherwise(F.col("ratio")).alias("scale"), F.when(better, F.col("rest")).otherwise(0.0).alias("offset"), "links", F.greatest("pure", "affine").alias("agreement")
    )


def snap(scale: Column, known: dict[str, float], tolerance: float = 0.02) -> Column:
    """The known conversion factor nearest to a scale in ratio, if within tolerance; else null."""
    factors = F.array(*[F.lit(float(v)) for v in sorted(set(known.values()))])
    best = F.array_min(F.transform(factors, lambda v: F.struct(F.abs(F.log(scale / v)).alias("d"), v.alias("v"))))
    return F.when(best["d"] <= tolerance, best["v"])


def propagate(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(source, factor, shift, hops, support) for all sources reached from anchors(source, factor) over edges(a, b,
    scale, links) with value_b = scale * value_a + offset (0 where edges have no column offset): a value times
    factor plus shift is in the common unit.

    One round per hop; in each the best supported edge (most links, then the smallest neighbour) decides, so the
    result doesn't depend on row order. Every round reaches new sources or is the last. Source graphs are small (one
    row per source), but every round is a join, not a driver loop over rows."""
    offset = F.col("offset") if "offset" in edges.columns else F.lit(0.0)
    forth = edges.select("a", "b", "scale", offset.cast("double").alias("offset"), "links")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 / F.col("scale")).alias("scale"), (-offset / F.col("scale")).cast("double").alias("offset"), "links")
    both = cut(forth.unionByName(back))
    known = cut(anchors.select("source", F.col("factor").cast("double"), F.lit(0.0).alias("shift"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("support")))
    hop = 0
    while True:
        hop += 1
        reach = both.join(known.select(F.col("source").alias("b"), "factor", "shift"), "b").join(known.select(F.col("source").alias("a")), "a", "left_anti")
        # scale and offset lead to b's unit, and b's factor and shift on to the common one
        step = F.struct((F.col("scale") * F.col("factor")).alias("factor"), (F.col("offset") * F.col("factor") + F.col("shift")).alias("shift"))
        best = reach.groupBy("a").agg(F.max_by(step, F.struct(F.col("links"), F.col("b"))).alias("s"), F.max("links").alias("support"))
        new = cut(best.select(F.col("a").alias("source"), "s.factor", "s.shift", F.lit(hop).alias("hops"), "support"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


# --- money -----------------------------------------------------------------------------------------------------


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def rates_by_month(rates: DataFrame) -> DataFrame:
    """One row per month with a map unit -> US dollars per unit. A fixed table: a few units by months."""
    entry = F.struct(F.col("unit"), F.col("usd_per_unit").cast("decimal(20,6)").alias("usd"))
    by_month = rates.where("unit is not null and rate_month is not null and usd_per_unit is not null").dropDuplicates(["unit", "rate_month"])
    return by_month.groupBy("rate_month").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rates"))


def to_usd(amount: Column, unit: Column, rates: Column) -> Column:
    """US dollars as a decimal. usd, its thousands and hundredths need no rate; another unit without a rate in its
    month gives null."""
    own = {"usd": 1, "usd_thousand": 1000, "usd_cent": "0.01"}
    fixed = F.try_element_at(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(str(v)))]), unit).cast("decimal(20,6)")
    return (amount.cast(DEC) * F.coalesce(fixed, F.try_element_at(rates, unit).cast("decimal(20,6)"))).cast("decimal(38,6)")


def usd_stated(messages: DataFrame, rates: DataFrame) -> DataFrame:
    """messages(msg_id, group_name, content, amounts, sent_at) as (msg_id, group_name, rate_month, amounts, silent,
    said): the distinct whole US dollar sums its content states (empty where it has none), and whether the recorded
    figures stand in its place. The rate table is fixed and small, hence broadcast."""
    with_rates = messages.withColumn("rate_month", F.date_format("sent_at", "yyyy-MM")).join(F.broadcast(rates_by_month(rates)), "rate_month", "left")
    sums = F.transform(money(F.col("content")), lambda m: half_up(to_usd(m["amount"], m["unit"], F.col("rates"))))
    silent = blank(F.col("content")) | (F.lower(F.trim("content")) == "[withheld]")
    return with_rates.select("msg_id", "group_name", "rate_month", "amounts", silent.alias("silent"), F.array_distinct(F.filter(sums, lambda x: x.isNotNull())).alias("said"))


#: Units a feed may record money in, with what a unit is worth: US dollars, or a currency of the rate table.
FEED_UNITS = ("usd", "usd_thousand", "usd_cent", "eur", "gbp", "btc", "xmr")


def feed_units(said: DataFrame, rates: DataFrame, units: tuple[str, ...] = FEED_UNITS, tolerance: float = 0.15, min_agreement: float = 0.2) -> DataFrame:
    """(source, unit, links, agreement): the unit in which each group's feed records figures, told from the data.

    said must come from usd_stated(). Sources are the feed of a group in a month, for currencies change with it, and
    the sums stated in US dollars; the entity that links them is a message that states exactly one sum and carries
    exactly one figure. The pairwise scale of a month (robust against wrong figures and rounding) is snapped to the
    nearest conversion of that month; months are joined by the group, whose unit is the one with most links behind
    it, of equals the one named first. Months whose links disagree, and groups with fewer than three links in every
    month, tell nothing.
    """
    one = said.where("size(said) = 1 and size(amounts) = 1 and amounts[0] > 0 and said[0] > 0 and group_name is not null")
    feed = F.to_json(F.struct("group_name", "rate_month"))
    obs = one.select(F.col("msg_id").alias("entity"), F.inline(F.array(F.struct(F.lit("").alias("source"), F.col("said")[0].cast("double").alias("value")), F.struct(feed.alias("source"), F.col("amounts")[0].cast("double").alias("value")))))
    scales = pairwise_scales(obs, tolerance).where((F.col("a") == "") & (F.col("agreement") >= min_agreement) & (F.col("offset") == 0))
    parts = F.from_json("b", "group_name string, rate_month string")
    by_month = scales.withColumn("p", parts).select(F.col("p.group_name").alias("source"), F.col("p.rate_month").alias("rate_month"), (1 / F.col("scale")).alias("worth"), "links", "agreement")
    by_month = by_month.join(F.broadcast(rates_by_month(rates)), "rate_month", "left")
    options = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.abs(F.log(F.col("worth") / v)).alias("d"), F.lit(i).alias("i"))) for i, u in enumerate(units) for v in [to_usd(F.lit(1), F.lit(u), F.col("rates")).cast("double")]]))
    best = F.array_min(options)
    votes = by_month.withColumn("best", best).where(F.col("best.d") <= tolerance).groupBy("source", F.col("best.i").alias("i")).agg(F.sum("links").alias("links"), F.avg("agreement").alias("agreement"))
    won = votes.groupBy("source").agg(F.max_by(F.struct("i", "links", "agreement"), F.struct(F.col("links"), -F.col("i"))).alias("w"))
    names = F.array(*[F.lit(u) for u in units])
    return won.select("source", F.get(names, F.col("w.i")).alias("unit"), "w.links", "w.agreement")


# --- volumes ---------------------------------------------------------------------------------------------------


def claimed(victims: DataFrame) -> DataFrame:
    """victims plus `stated_mb` (from a unit in claim_text) and `bare` (the number of a row that names no unit)."""
    said = F.col("claim_text")
    number = F.when(said.rlike(r"^\s*[\d.,]+\s*$"), number_value(F.trim(said), F.lit(False)))
    valid = (F.col("claimed_gb") > 0) & ~F.isnan("claimed_gb") & (F.col("claimed_gb") < float("inf")) & (F.col("claimed_gb") < 1e20)
    held = F.when(valid, F.col("claimed_gb").cast(DEC))
    refused = said.isNotNull() & ~blank(said) & number.isNull() & ~said.rlike(r"\d")
    bare = F.when(refused, F.lit(None).cast(DEC)).otherwise(F.coalesce(held, F.when(F.col("claimed_gb").isNull() | F.isnan("claimed_gb"), number)))
    return victims.withColumn("stated_mb", volume_mb(said)).withColumn("bare", bare)


def site_units(victims: DataFrame, known: dict[str, str] = VOLUMES, min_agreement: float = 0.5) -> DataFrame:
    """(source, unit, factor, shift, links): how each site's numbers that come without a unit turn into megabytes,
    told from the data; unit is null where the way there is none of the known conversions.

    victims must come from claimed(). Sources are the bare numbers of each site and, as the anchor, all volumes
    stated with a unit (in megabytes). They are linked by entities of two kinds: a victim captured on one site both
    with a unit and without, and a victim that several sites list without one. Scales near a known conversion are
    snapped to it, others stand if they come with an offset; all are propagated from the anchor through the source
    graph. Links that disagree (a share under min_agreement near the fit) aren't followed.
    """
    here, own = F.concat_ws("|", F.col("victim_id").cast("string"), F.col("site")), F.col("victim_id").cast("string")
    stated = victims.where("stated_mb is not null and victim_id is not null").select(here.alias("entity"), F.lit("").alias("source"), F.col("stated_mb").cast("double").alias("value"))
    bare = victims.where("stated_mb is null and bare is not null and victim_id is not null and site is not null and site <> ''")
    obs = stated.unionByName(bare.select(F.explode(F.array(here, own)).alias("entity"), F.col("site").alias("source"), F.col("bare").cast("double").alias("value")))
    ratios = {k: float(v) for k, v in known.items()}
    scales = pairwise_scales(obs).where(F.col("agreement") >= min_agreement)
    steps = {f"{a}/{b}": x / y for a, x in ratios.items() for b, y in ratios.items()}
    edges = scales.withColumn("scale", F.coalesce(snap(F.col("scale"), steps), F.when(F.col("offset") != 0, F.col("scale")))).where("scale is not null")
    anchors = victims.sparkSession.range(1).select(F.lit("").alias("source"), F.lit(1.0).alias("factor"))
    found = propagate(edges, anchors)
    pick = F.array_min(F.array(*[F.struct(F.abs(F.log(F.col("factor") / v)).alias("d"), F.lit(k).alias("u")) for k, v in ratios.items()]))
    unit = F.when((F.col("shift") == 0) & (pick["d"] < 1e-6), pick["u"])
    return found.where("source <> ''").select("source", unit.alias("unit"), "factor", "shift", F.col("support").alias("links"))


def quantities(messages: DataFrame, victims: DataFrame, rates: DataFrame, source_units: DataFrame) -> DataFrame:
    """(src, rec_id, qty): all quantities in common units, US dollars and megabytes, one row per distinct quantity.

    How feeds and sites record is told from the data (feed_units, site_units); a unit declared in source_units is
    the exact check that follows and prevails. Undecided sources count as US dollars or gigabytes. Texts are parsed
    once. Null, blank and withheld content falls back to the recorded figures; a null array has none; null, zero and
    negative figures claim nothing. Repeated rows have distinct ids and each gives its rows. Extra columns are ignored.
    """
    messages = messages.select("msg_id", "group_name", "content", "amounts", "sent_at")
    victims = victims.select("rec_id", "victim_id", "claimed_gb", "claim_text", "site")
    said = cut(usd_stated(messages, rates))
    money_unit = _per_source(said.select("group_name").distinct().withColumnRenamed("group_name", "source"), feed_units(said, rates), source_units, "money", "usd")
    by_unit = said.join(F.broadcast(rates_by_month(rates)), "rate_month", "left").join(money_unit.select(F.col("source").alias("group_name"), "unit"), "group_name", "left")
    figures = F.transform(F.filter(F.col("amounts"), lambda x: x > 0), lambda x: half_up(to_usd(x, F.coalesce(F.col("unit"), F.lit("usd")), F.col("rates"))))
    sums = F.when(F.col("silent"), F.coalesce(figures, F.array().cast("array<bigint>"))).otherwise(F.col("said"))
    money_rows = by_unit.select(F.lit("messages").alias("src"), F.col("msg_id").alias("rec_id"), F.explode(F.array_distinct(F.filter(sums, lambda x: x.isNotNull()))).alias("qty"))

    volumes = cut(claimed(victims).select("rec_id", "victim_id", "site", "stated_mb", "bare"))
    site_unit = _per_source(volumes.select("site").distinct().withColumnRenamed("site", "source"), site_units(volumes), source_units, "volume", "gb")
    factor = F.try_element_at(F.create_map(*[x for k, v in VOLUMES.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(F.col("unit"), F.lit("gb"))).cast("decimal(30,10)")
    told = F.when(F.col("unit").isNull() & F.col("factor").isNotNull(), (F.col("bare").cast("double") * F.col("factor") + F.col("shift")).cast(DEC))
    mb = F.coalesce(F.col("stated_mb"), told, (F.col("bare") * factor).cast(DEC))
    sites = site_unit.withColumnRenamed("source", "site")
    volume_rows = volumes.join(sites, "site", "left").select(F.lit("victims").alias("src"), "rec_id", half_up(mb).alias("qty")).where("qty is not null")
    return money_rows.unionByName(volume_rows)


def _per_source(sources: DataFrame, told: DataFrame, declared: DataFrame, quantity: str, default: str) -> DataFrame:
    """(source, unit, factor, shift): a row per source at most. unit is null where only factor and shift are told."""
    by_hand = declared.where((F.col("quantity") == quantity) & F.col("unit").isNotNull()).groupBy(F.col("origin_name").alias("source")).agg(F.min("unit").alias("declared"))
    way = [F.col(c) if c in told.columns else F.lit(None).cast("double").alias(c) for c in ("factor", "shift")]
    both = sources.where("source is not null").join(told.select("source", F.col("unit").alias("told"), *way), "source", "left").join(by_hand, "source", "left")
    only_way = F.col("declared").isNull() & F.col("told").isNull() & F.col("factor").isNotNull()
    return both.select("source", F.when(~only_way, F.coalesce("declared", "told", F.lit(default))).alias("unit"), F.when(only_way, F.col("factor")).alias("factor"), F.when(only_way, F.col("shift")).alias("shift"))


def unit_report(messages: DataFrame, victims: DataFrame, rates: DataFrame, source_units: DataFrame) -> DataFrame:
    """(quantity, source, declared, told, links): per source the declared unit beside the one told from the data."""
    a = feed_units(cut(usd_stated(messages, rates)), rates).select(F.lit("money").alias("quantity"), "source", "unit", "links")
    b = site_units(cut(claimed(victims).select("victim_id", "site", "stated_mb", "bare"))).select(F.lit("volume").alias("quantity"), "source", "unit", "links")
    told = a.unionByName(b)
    declared = source_units.select("quantity", F.col("origin_name").alias("source"), F.col("unit").alias("declared"))
    return told.join(declared, ["quantity", "source"], "full_outer").select("quantity", "source", "declared", F.col("unit").alias("told"), "links")
