"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common short words of the four languages of the corpus, in alphabetical order.
STOP_WORDS = (
    "a al als and are as at au auf avec be by con dans das de del dem den der des die du ein eine el en es est et for "
    "für il im in is ist it la las le les los lo mit nicht no of on par para pas por pour que qui se sich su "
    "sur that the this to un una und une von was with y zu"
).split()


@dataclass(frozen=True)
class Rule:
    """`low` <= `metric` <= `high`; a missing end is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The rules of the production query. Ratios are shares from 0 to 1; a text without words has ratios of 0.
RULES = (
    Rule("long_enough", "n_words", low=20),
    Rule("word_length", "mean_word_chars", low=1.5, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("marks", "mark_word_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.01),
    Rule("repeated_windows", "repeat_word_ratio", high=0.3),
    Rule("repeated_neighbours", "echo_word_ratio", high=0.2),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)
WINDOW = 8


def _bound(value: Column, use) -> Column:
    """Evaluates `value` once per row and hands it to `use` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words whose words occur at two places or more, the first included.

    Equal windows are neighbours once (hash, place) pairs are sorted; each repeated window then covers
    the words up to the next repeated window, at most WINDOW.
    """

    def covered(places: Column) -> Column:
        gap = F.transform(
            places,
            lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        return F.aggregate(gap, F.lit(0), lambda a, g: a + g)

    def places(ranked: Column) -> Column:
        here = lambda i: F.get(ranked, i)["h"]
        kept = F.transform(
            ranked,
            lambda x, i: F.when((x["h"] == here(i + 1)) | (x["h"] == here(i - 1)), x["p"]),
        )
        return _bound(F.sort_array(F.array_compact(kept)), covered)

    def counted(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ranked, places)).otherwise(F.lit(0))

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1))
        return _bound(F.transform(starts, lambda i: F.xxhash64(F.slice(codes, i, WINDOW))), counted)

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_bound(codes, windows)).cast("long")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _arrays(text: Column) -> dict[str, Column]:
    return {
        "_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != ""),
    }


def _counts(text: Column, w: Column, lines: Column, stop_words) -> dict[str, Column]:
    n = F.size(w).cast("long")
    return {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines_with_words": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated_words(w),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long"),
        "n_mark_words": F.size(F.filter(w, lambda x: x.endswith("!!") | (x == "|"))).cast("long"),
        "n_echo_words": F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(
            F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: a == b), lambda same: same,
        ))).cast("long"),
    }


def _ratios(c) -> dict[str, Column]:
    return {
        "mean_word_chars": _share(c("word_chars"), c("n_words")),
        "symbol_ratio": _share(c("n_symbols"), c("word_chars")),
        "mark_word_ratio": _share(c("n_mark_words"), c("n_words")),
        "stop_word_ratio": _share(c("n_stop_words"), c("n_words")),
        "repeat_word_ratio": _share(c("n_repeat_words"), c("n_words")),
        "echo_word_ratio": _share(c("n_echo_words"), c("n_words")),
        "dup_line_ratio": _share(c("n_dup_lines"), c("n_lines_with_words")),
    }


def measure(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Adds the counts and ratios that rules speak of, in two projections without a shuffle.

    A null text counts as an empty one: no words, all counts 0; a very long one is counted whole. Rows are independent of
    each other, so repeated rows and null ids keep their own results; columns that clash with the added names are replaced.
    An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = docs.withColumns(_arrays(text))
    counts = arrays.withColumns(_counts(text, F.col("_words"), F.col("_lines"), stop_words)).drop("_words", "_lines")
    return counts.withColumns(_ratios(F.col))


def verdict(rules=RULES, of=F.col) -> Column:
    """The threshold table as one boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (of(rule.metric) >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (of(rule.metric) <= F.lit(rule.high))
    return passed


def _base_failed(of=F.col) -> Column:
    return (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))


def keeps(text: Column, rules=RULES, stop_words=STOP_WORDS) -> Column:
    """`kept` of `judge` as one expression of a text.

    Words, counts and ratios are each bound once, so a filter on it cuts the text once and not once for every rule.
    """
    plain = F.coalesce(text, F.lit(""))
    struct = lambda parts: F.struct(*[c.alias(n) for n, c in parts.items()])

    def ruled(counts: Column) -> Column:
        every = struct({n: counts[n] for n in ("n_words", "n_repeat_words")} | _ratios(counts.__getitem__))
        return _bound(every, lambda m: ~_base_failed(m.__getitem__) & verdict(rules, m.__getitem__))

    return _bound(struct(_arrays(plain)), lambda a: _bound(
        struct(_counts(plain, a["_words"], a["_lines"], stop_words)), ruled))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every row with its counts, ratios, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 of 100 words inside repeated windows; such rows are never kept.
    """
    return measure(docs).withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
