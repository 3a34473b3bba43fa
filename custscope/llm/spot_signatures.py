"""SpotSigs: chains of content words that follow common words, as sets compared by pruned Jaccard.

Built-in functions only. A signature is a common word (the anchor) and the next CHAIN words that are not
common, hashed; a text without anchors uses every word as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts
from .quality_rules import STOP_WORDS, _bound

CHAIN = 2
#: Words behind an anchor among which its chain is sought.
REACH = 12
ROWS_IN_RANGE = 1000


def signatures(text: Column) -> Column:
    """The ascending array of distinct signatures of a text; an empty text has none."""

    def content(words: Column, at: Column) -> Column:
        return F.slice(F.filter(F.slice(words, at + 2, REACH), lambda w: ~w.isin(*STOP_WORDS)), 1, CHAIN)

    def spot(words: Column, word: Column, at: Column) -> Column:
        chain = _bound(content(words, at), lambda c: F.when(F.size(c) == CHAIN, F.hash(word, c)))
        return F.when(word.isin(*STOP_WORDS), chain)

    def spots(words: Column) -> Column:
        anchored = F.array_compact(F.transform(words, lambda w, i: spot(words, w, i)))
        every = F.transform(words, lambda w, i: F.hash(F.slice(words, i + 1, CHAIN + 1)))
        return _bound(anchored, lambda a: F.when(F.size(a) > 0, a).otherwise(every))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marks = F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    found = _bound(words, lambda w: F.when(F.size(w) > 0, spots(w)).otherwise(marks))
    return F.sort_array(F.array_distinct(found))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without counting where the sizes alone keep it below `least`.

    Two empty sets are alike; an empty and a filled one are not.
    """
    x, y = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((x == 0) & (y == 0), F.lit(1.0))
        .when(F.least(x, y) < F.lit(least) * F.greatest(x, y), F.lit(0.0))
        .otherwise(shared / (x + y - shared))
    )


def written(signs: Column) -> Column:
    """The fingerprint as text: its signatures in order."""
    return F.array_join(signs.cast("array<string>"), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, signs and the next document's next_id, next_text, next_signs, in ascending (doc_id, text).

    Ids are cut into ranges; a window finds the next row within a range, and the last row of a range meets the
    first row of the next range that has rows. The last document of all meets the first. Rows without doc_id come first.
    """
    texts = doc_texts(docs)
    low, high, n = texts.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) * ROWS_IN_RANGE // max(1, n)))
    ranged = texts.select(
        "doc_id", "text", signatures(F.col("text")).alias("signs"),
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / width), F.lit(-1)).alias("range"))
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    found = ranged.select(
        "*", F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"),
        F.lead("signs").over(order).alias("next_signs"), F.row_number().over(order).alias("_at"))
    names = ["doc_id", "text", "signs", "next_id", "next_text", "next_signs"]
    heads = found.where("_at = 1").select(
        F.col("range").alias("_to"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"),
        F.col("signs").alias("next_signs"))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("_n"))
    around = Window.orderBy("range")  # one short row per range
    onward = ranges.select(
        "range", F.coalesce(
            F.lead("range").over(around), F.first("range").over(around)).alias("_to"))
    tails = (
        found.where("next_text IS NULL").drop("next_id", "next_text", "next_signs")
        .join(onward, "range").join(heads, "_to").select(*names)
    )
    return found.where("next_text IS NOT NULL").select(*names).unionByName(tails)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its signatures, those of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, or
    all of it. A null text is an empty one; a single document is its own next one. An empty table gives an
    empty table; other columns are left out.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_signs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", "edited", "signs", "edited_signs",
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))


def similar_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of different signature sets whose Jaccard is at least `least`, by their smallest ids.

    Documents with equal sets are one class, named by the smallest doc_id. Sets are partitioned by size: bounds
    grow by 1 / least, so a set can only be near sets of its own partition and the next. Within those, sets meet at a
    shared member of their prefixes, and sizes prune before members are counted. Nothing is compared twice. Texts
    without words and rows without doc_id take no part.
    """
    classes = (
        doc_texts(docs).where("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("signs"))
        .where(F.size("signs") > 0).groupBy("signs").agg(F.min("doc_id").alias("id"))
    )
    size = F.size("signs")
    band = F.floor(F.log(size) / F.log(F.lit(1 / least))).cast("int")
    # Float logarithms may put an exact bound on either side; bands one apart are compared anyway.
    prefix = F.slice("signs", 1, (size - F.ceil(F.lit(least) * size) + 1).cast("int"))
    keyed = classes.select("id", "signs", band.alias("band"), F.explode(prefix).alias("key"))
    probe = keyed.select("id", "signs", "key", "band", F.explode(F.array("band", F.col("band") + 1)).alias("to"))
    other = keyed.select(
        F.col("id").alias("id2"), F.col("signs").alias("signs2"), "key", F.col("band").alias("to"))
    met = probe.join(other, ["key", "to"]).where((F.col("band") < F.col("to")) | (F.col("id") < F.col("id2")))
    near = met.withColumn("likeness", likeness(F.col("signs"), F.col("signs2"), least)).where(F.col("likeness") >= least)
    return near.select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "likeness").distinct()
