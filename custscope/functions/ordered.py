"""Exact order statistics and running totals without gathering a group in one task.

`percentile` keeps every distinct value of a group in one aggregation buffer, and a window
without a narrow key sends a whole group to one task. Both are fine where the number of
distinct values is bounded (days, weekdays); money is not bounded. Here values are first
collapsed to (group, value, count), which combines map-side and spreads a hot group over its
values; then a coarse, order-preserving bin of the value is counted. Only the bin totals are
scanned in order (a double has at most about six million bins, whatever the row count), and
only the values of one narrow bin are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_UNIT = 4096


def over_few_rows(aggregate: Column) -> Column:
    """A grand total beside each row. Only for tables already reduced to a row per segment."""
    return aggregate.over(Window.partitionBy())


def value_bin(value: Column) -> Column:
    """Monotone bin: linear near zero, logarithmic far from it (relative width 1/4096).

    Never NULL: a nullable join key would add a filter to one of the two readers of the counts,
    and they would no longer share one shuffle.
    """
    v = value.cast("double")
    scaled = F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(BINS_PER_UNIT)).cast("bigint")
    return F.coalesce(scaled, F.lit(0).cast("bigint"))


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    weight: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """One row per group with an interpolated quantile column per entry of `quantiles`.

    With `weight` the input is already one row per group and value. Groups holding only NULL
    values do not appear; callers left-join. With `members` the groups share parts: its columns are `groups` and those
    that name a part, and `df` has the values of the parts. A part is binned once, however many groups hold it, and only
    values of bins that a group looks into are copied to the group.
    """
    groups = list(groups)
    part = groups if members is None else [c for c in members.columns if c not in groups]
    present = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double").alias("_v")
    if weight is None:
        counts = present.select(*part, v).groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = present.select(*part, v, F.col(weight).alias("_n"))
    counts = counts.withColumn("_bin", value_bin(F.col("_v")))
    in_order = Window.partitionBy(*groups).orderBy("_bin")
    binned = counts.groupBy(*part, "_bin").agg(F.sum("_n").alias("_bn"))
    if members is not None:
        binned = binned.join(members, part).groupBy(*groups, "_bin").agg(F.sum("_bn").alias("_bn"))
    bins = (
        binned.withColumn("_upto", F.sum("_bn").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*groups)))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
    )

    def place(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    # Zero-based ranks needed for each quantile: the two neighbours of its position.
    wanted = F.array_distinct(F.array(*[
        f(place(p)).cast("bigint") for p in quantiles.values() for f in (F.floor, F.ceil)
    ]))
    ranks = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    hit_bins = (
        bins.withColumn("_ranks", ranks).where(F.size("_ranks") > 0)
        .select(*groups, "_bin", "_before", "_total", "_ranks")
    )
    inside = Window.partitionBy(*groups, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    if members is None:
        looked_into = counts.join(hit_bins, [*groups, "_bin"])
    else:
        hit = [*groups, "_bin", "_before", "_total", "_ranks"]
        looked_into = counts.join(hit_bins.join(members, groups), [*part, "_bin"]).groupBy(*hit, "_v").agg(F.sum("_n").alias("_n"))
    found = (
        looked_into
        .withColumn("_hi", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_hits", F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))))
        .where(F.size("_hits") > 0)
        .withColumn("_rank", F.explode("_hits"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank.cast("bigint"), F.col("_v")))

    def interpolated(p: float) -> Column:
        low, high = at(F.floor(place(p))), at(F.ceil(place(p)))
        frac = F.max(place(p) - F.floor(place(p)))
        return low + (high - low) * frac

    return found.groupBy(*groups).agg(*[interpolated(p).alias(c) for c, p in quantiles.items()])


def running_totals_desc(df: DataFrame, value: str) -> DataFrame:
    """Per distinct value: rows and sum of all values at or above it, plus the grand totals.

    Same meaning as a RANGE window ordered by the value descending: equal values are peers.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias(value)).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_s", F.col(value) * F.col("_n"))
        .withColumn("_bin", value_bin(F.col(value)))
    )
    # One partition, but over bins: bounded by the bin count, not by the rows.
    above = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bins = (
        counts.groupBy("_bin").agg(F.sum("_n").alias("_bn"), F.sum("_s").alias("_bs"))
        .select(
            "_bin",
            F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_n_above"),
            F.coalesce(F.sum("_bs").over(above), F.lit(0.0)).alias("_s_above"),
            F.sum("_bn").over(whole).alias("n_total"),
            F.sum("_bs").over(whole).alias("sum_total"),
        )
    )
    inside = Window.partitionBy("_bin").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(bins, "_bin").select(
        value,
        (F.col("_n_above") + F.sum("_n").over(inside)).alias("n_upto"),
        (F.col("_s_above") + F.sum("_s").over(inside)).alias("sum_upto"),
        "n_total", "sum_total",
    )
