"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a missing attribute value, all equal to the attribute's absence.
MISSING = ("-", "—")


def canonical_map(attrs: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """A map's entries without missing values, in key order, as an array of structs: equal for maps that say the
    same in any order. A null map is an empty one."""
    entries = F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>")))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].isin(*missing))
    return F.array_sort(kept)


def consecutive(df: DataFrame, t: str, order: str) -> DataFrame:
    """(t_from, t_to, pos) of the deliveries, a row for each delivery but the last. One row per delivery, so the
    window is over as many rows as there are deliveries, not records."""
    from pyspark.sql import Window

    w = Window.orderBy("at", "t_from")
    return (
        df.where(F.col(t).isNotNull())
        .groupBy(F.col(t).alias("t_from"))
        .agg(F.min(order).alias("at"))
        .withColumns({"pos": F.row_number().over(w), "t_to": F.lead("t_from").over(w)})
        .select("t_from", "t_to", "pos")
    )


def latest_delivery(df: DataFrame, key: list[str], t: str, loaded: str, state: Column) -> DataFrame:
    """One row per (t, key): the state of the delivery loaded last. Two deliveries loaded at the same moment are
    decided by the greater state, so the result doesn't depend on row order."""
    last = F.max(F.struct(F.col(loaded).alias("l"), state.alias("s")))
    return df.groupBy(t, *key).agg(last.alias("last")).select(t, *key, F.col("last.s").alias("state"))


def snapshot_diff(
    df: DataFrame,
    key: list[str],
    state: Column,
    t: str = "t",
    order: str = "taken_at",
    loaded: str = "loaded_at",
) -> DataFrame:
    """(t_from, t_to, *key, change) of every record that differs between two deliveries next to each other.

    Each record of each delivery is reduced to a 128-bit hash of its canonical state (two independent 64-bit
    hashes); the deliveries are full-outer joined on primary key and position, a missing side giving `added` or
    `removed`, unequal hashes `changed`. Only hashes are shuffled by the join, never attributes.

    Null key columns are keys like others (they are compared null-safely by a marker). Rows with a null delivery
    name are left out. A delivery with no record at all can't be seen in the table; an empty table gives no rows.
    Repeated rows count once. Extra columns are ignored.
    """
    steps = consecutive(df, t, order)
    packed = latest_delivery(df, key, t, loaded, F.struct(F.xxhash64(state).alias("h1"), F.xxhash64(F.lit(7), state).alias("h2")))
    # one marker per null key column, so that the equi-join treats nulls as equal
    safe = {f"_{k}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in key}
    at = packed.withColumns(safe).join(steps.select(F.col("t_from").alias(t), "pos"), t).drop(t)
    on = [*safe, "pos"]
    old = at.select(*safe, "pos", F.col("state").alias("old"), *[F.col(k).alias(f"old_{k}") for k in key])
    new = at.select(*safe, (F.col("pos") - 1).alias("pos"), F.col("state").alias("new"), *[F.col(k).alias(f"new_{k}") for k in key])
    both = old.join(new, on, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(steps.where(F.col("t_to").isNotNull()), "pos")  # drops "before the first" and "after the last"
        .select("t_from", "t_to", *[F.coalesce(f"old_{k}", f"new_{k}").alias(k) for k in key], "change")
    )
