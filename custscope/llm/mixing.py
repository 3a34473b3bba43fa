"""Mixing sources to target weights by systematic sampling.

1. Every document gets its size in words. Sources are totalled, take their weight by rank and share all words; a source's
   target stops at `most` times its size and the excess is shared again by weight. The water level that this ends at is the
   largest (words left) / (weights left) over the sources in order of the level at which each of them is full.
2. Within a source documents stand in order of size, largest first. Each adds its expected copies to a prefix sum that
   starts at one random offset, and is taken once for every whole number that the sum passes. Expected copies are
   (words still wanted) / (words still to come), set anew for each level of sizes (at most 1/2^k of the source), so what
   few large documents miss or add is made good by the smaller ones, and the mix ends near its target.
3. The prefix sums need no window over a source's documents: rows are range-sorted once, a row's place is its row number
   in its part, and what precedes the part is known from counts of (source, size, part).

Only numbers move between tasks; texts are read once, for their size. Expected copies are whole numbers of 1/UNIT, so
the sums are exact and equal rows and reruns agree, however rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import BLANKS, blocks

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target is at most this many times its size, and no document is taken more often.
MOST = 3
#: Expected copies are counted in 1/UNIT. A level of a source may hold 2^63 / (MOST * UNIT) documents, 1.8e11.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
#: Size levels: the k-th holds documents of at most 1/2^k of their source.
LEVELS = 12


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def _bound(value: Column, use) -> Column:
    """Evaluates `value` once and hands it to `use`."""
    return F.element_at(F.transform(F.array(value), use), 1)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target) of rows (source, size); one row per source, the null source last.

    Targets add up to all sizes. Without words every target is 0.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    whole = Window.partitionBy()
    filled = whole.orderBy(F.col("full_at"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0))
    left = ranked.withColumn("full_at", most * F.col("source_size") / F.col("weight")).select(
        "*", (F.sum("source_size").over(whole) - most * before("source_size")).alias("words_left"),
        (F.sum("weight").over(whole) - before("weight")).alias("weights_left"))
    level = F.max(F.col("words_left") / F.col("weights_left")).over(whole)
    return left.withColumn("level", level).select(
        "source", "rank", "source_size",
        F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _level(size: Column, source_size: Column) -> Column:
    return sum((size * (1 << k) <= source_size).cast("int") for k in range(1, LEVELS + 1))


def _rates(per_size: DataFrame, targets: DataFrame, seed: str, most: int) -> DataFrame:
    """(rank, level, rate, start): expected copies of a document in 1/UNIT and where the level's prefix sum starts.

    Walks a source's distinct sizes, not its documents: one array per source.
    """
    levels = per_size.groupBy("rank", "level").agg(
        F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("steps"), F.sum(F.col("size") * F.col("n")).alias("words"))
    walks = levels.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("level", "steps", "words"))).alias("levels"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    walks = walks.join(targets.select("rank", "source_size", "target", offset.alias("offset")), "rank")

    def state(wanted, left, at, out):
        return F.struct(wanted.cast("double").alias("wanted"), left.cast("long").alias("left"), at.cast("long").alias("at"), out.alias("out"))

    def level_step(s, level):
        share = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), s["wanted"] / s["left"]))
        rate = F.floor(share * UNIT).cast("long")

        def with_rate(r):
            def size_step(t, x):
                return _bound(t["at"] + x["n"] * r, lambda p: F.struct(
                    F.pmod(p, F.lit(UNIT)).cast("long").alias("at"), (t["taken"] + F.shiftright(p, UNIT_BITS) * x["size"]).cast("long").alias("taken")))

            start = F.struct(s["at"].alias("at"), F.lit(0).cast("long").alias("taken"))
            row = F.struct(level["level"].alias("level"), r.alias("rate"), s["at"].alias("start"))
            return _bound(F.aggregate(level["steps"], start, size_step), lambda t: state(
                s["wanted"] - t["taken"], s["left"] - level["words"], t["at"], F.concat(s["out"], F.array(row))))

        return _bound(rate, with_rate)

    empty = F.expr("CAST(array() AS array<struct<level: int, rate: bigint, start: bigint>>)")
    done = F.aggregate("levels", state(F.col("target"), F.col("source_size"), F.col("offset"), empty), level_step)
    return walks.select("rank", F.explode(done["out"]).alias("r")).select("rank", "r.*")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """One row per document: `key`, source, size, source_size, target (its source's), copies, taken (copies * size).

    A null or empty text has size 0 and is never taken. A null source is a source of its own, ranked last. Rows with
    equal keys, or without a key, are documents of their own; equal ones may change places, which the result does not show.
    A very long text counts whole. An empty table gives an empty table; other columns, whatever their names, are left out.
    Memory: one array per source of its distinct sizes and one row per source in a window; everything else is rows.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(F.col(key).alias("key"), "source", n_words(F.col("text")).alias("size")), "sized")
    targets = stage(source_targets(sized, weights, most), "targets")
    known = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ordered = stage(
        known.where("size > 0").withColumns({"level": _level(F.col("size"), F.col("source_size")), "down": -F.col("size")})
        .repartitionByRange(blocks(spark), "rank", "down", "key").sortWithinPartitions("rank", "down", "key")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    parts = stage(ordered.groupBy("rank", "level", "size", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")), "parts")
    rates = _rates(parts.groupBy("rank", "level", "size").agg(F.sum("n").alias("n")), targets, seed, most)
    earlier = Window.partitionBy("rank", "level").orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, -1)
    places = stage(
        parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(rates, ["rank", "level"])
        .select("rank", "size", "part", "rate", "start", (F.col("before") - F.col("first")).alias("shift")), "places")
    reached = F.col("start") + (F.col("shift") + F.col("at")) * F.col("rate")
    copies = F.shiftright(reached + F.col("rate"), UNIT_BITS) - F.shiftright(reached, UNIT_BITS)
    taken = ordered.join(places, ["rank", "size", "part"]).withColumn("copies", copies)
    empty = known.where("size = 0").withColumn("copies", F.lit(0).cast("long"))
    columns = [F.col("key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return taken.select(columns).unionByName(empty.select(columns))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` with all its columns, as often as it is taken."""
    keyed = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    taken = mix(keyed, key="_row", **options).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    again = keyed.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return again.select(*docs.columns)
