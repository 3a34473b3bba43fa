"""Rule labels, segment rank, urgency ratio and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custscope.schema import SEGMENT_ORDER

ITEM_SEPARATOR = ", "


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def item_label(items: Column) -> Column:
    return F.array_join(F.sort_array(items), ITEM_SEPARATOR)


def rule_items(antecedents: Column, consequents: Column) -> Column:
    """Sorted distinct families named by both sides of a rule."""
    return F.sort_array(F.array_union(F.split(antecedents, ITEM_SEPARATOR), F.split(consequents, ITEM_SEPARATOR)))


def rule_arrow(antecedents: Column, consequents: Column) -> Column:
    return F.concat(antecedents, F.lit(" → "), consequents)


def segment_rank(segment: Column) -> Column:
    """1 is best; a name outside the vocabulary ranks 0."""
    return F.array_position(string_array(SEGMENT_ORDER), segment)


def urgency_ratio(recency: Column, cadence: Column) -> Column:
    return recency.cast("double") / F.greatest(cadence, F.lit(1.0))


def urgency_band(ratio: Column) -> Column:
    """Bands are [0,1), [1,1.5), [1.5,3] and above 3."""
    return (
        F.when(ratio < 1, F.lit("<1"))
        .when(ratio < 1.5, F.lit("1-1.5"))
        .when(ratio <= 3, F.lit("1.5-3"))
        .otherwise(F.lit(">3"))
    )


def moved_up(before: Column, after: Column) -> Column:
    """'subida' when both names are known and the new one ranks better, otherwise 'bajada'."""
    known = (segment_rank(before) > 0) & (segment_rank(after) > 0)
    return F.when(known & (segment_rank(after) < segment_rank(before)), "subida").otherwise("bajada")


def share(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
