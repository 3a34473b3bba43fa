"""Phrase collocations by multikey three-way quicksort of suffix pointers.

1. Words are counted per language, combining in each task and again before the shuffle.
2. Every word that another follows in its piece starts a suffix of at most MAX_WORDS words. Suffixes are routed
   by their shortest run of leading words that holds a word with at most `hot` occurrences, so no route takes more than
   `hot` of them; suffixes of hot words only are routed by all their words. A slab of text goes to a bucket as one row: a
   list of words and sorted rows of word numbers, equal ones counted.
3. A bucket sorts pointers to its suffixes by a multikey three-way quicksort down to MAX_WORDS words. The size of an
   equal part is the count of its phrase; parts smaller than `least` are abandoned. A phrase of hot words only may have
   other occurrences in other buckets: it is never abandoned, and its counts are added afterwards.
4. Cuts, containment and ranks are joins and aggregates over the phrases found.

A bucket's suffixes are bounded by BUCKET_WORDS on average plus one route, however frequent a word, pair or passage is. The
driver holds the words with over `hot` occurrences, at most (all words) / `hot`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import mix, slabs

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: Occurrences above which a leading word alone makes no route.
HOT = 500_000
#: Words of text for each bucket, on average.
BUCKET_WORDS = 1_000_000
NO_LANG = "und"
#: Words held by a task's counter before it passes them on.
HELD = 500_000
#: Parts up to this many pointers are ordered at once instead of being split at a pivot.
SMALL = 4096
_BREAK = b"\n"
#: Bytes that end a piece, and the blanks between words.
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", _BREAK * 9 + b" ")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _slabs_by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, text) with A-Z lower-cased, pieces ended by line breaks and texts by one more."""
    langs, texts = np.asarray(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
    for lang in dict.fromkeys(langs):
        own = [texts[i] for i in np.flatnonzero(langs == lang)]
        for a, b in slabs(own):
            yield lang, "\n".join(own[a:b]).encode().lower().translate(_CUTS)


# ---- words ----


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def out():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()),
                 pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in _slabs_by_lang(batch):
            counts = held.setdefault(lang, Counter())
            counts.update(text.replace(_BREAK, b" ").split(b" "))
            del counts[b""]
            if sum(map(len, held.values())) > HELD:
                yield from out()
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents."""
    return _texts(docs).mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ---- routing suffixes ----


class _Numbers(dict):
    """Numbers words in the order they come; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"": -1, _BREAK: 0})
        self.words = [_BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _suffixes(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words, and for every place of two words or more the numbers of up to MAX_WORDS words, 0 behind the last."""
    numbers = _Numbers()
    flow = np.fromiter(map(numbers.__getitem__, text.replace(_BREAK, b" \n ").split(b" ")), np.int32)
    flow = np.append(flow[flow >= 0], np.zeros(MAX_WORDS, np.int32))
    rows = np.lib.stride_tricks.sliding_window_view(flow, MAX_WORDS)[: len(flow) - MAX_WORDS]
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)].copy()
    for k in range(2, MAX_WORDS):
        rows[rows[:, k - 1] == 0, k] = 0
    return numbers.words, rows


def _equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each stands."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.diff(np.append(np.flatnonzero(first), len(rows)))


def _route(rows: np.ndarray, words: list[bytes], hot: set[bytes], lang: str, buckets: int) -> np.ndarray:
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    common = np.fromiter((w in hot for w in words), bool, len(words))
    route = np.full(len(rows), xxhash.xxh3_64_intdigest(lang), np.uint64)
    open_ = np.ones(len(rows), bool)
    for k in range(MAX_WORDS):
        route[open_] = mix(route[open_] + codes[rows[open_, k]] + np.uint64(k + 1))
        open_ &= common[rows[:, k]]
    return (route % np.uint64(buckets)).astype(np.int64)


_ROUTED = "bucket bigint, lang string, words binary, ids binary, counts binary"


def _route_suffixes(hot: dict[str, set[bytes]], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _slabs_by_lang(batch):
                words, rows = _suffixes(text)
                if not len(rows):
                    continue
                bucket = _route(rows, words, hot.get(lang, set()), lang, buckets)
                order = np.argsort(bucket, kind="stable")
                places = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out: dict[str, list] = {"bucket": [], "words": [], "ids": [], "counts": []}
                for a, b in zip(places, np.append(places[1:], len(order)), strict=True):
                    used, own = np.unique(rows[order[a:b]], return_inverse=True)
                    own, counts = _equal_rows(own.reshape(-1, MAX_WORDS).astype("<u4") + np.uint32(used[0] != 0))
                    narrow = "<u2" if len(used) < 1 << 16 else "<u4"
                    out["bucket"].append(bucket[order[a]])
                    out["words"].append(b" ".join(words[i] for i in used if i))
                    out["ids"].append(np.ascontiguousarray(own.T).astype(narrow).tobytes())
                    out["counts"].append(counts.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int64()), pa.array([lang] * len(places), pa.string()),
                     *(pa.array(out[c], pa.binary()) for c in ("words", "ids", "counts"))], ["bucket", "lang", "words", "ids", "counts"])

    return run


# ---- sorting a bucket ----


def quicksort_phrases(rows: np.ndarray, counts: np.ndarray, hot: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int, bool]]:
    """(phrase, count, whole) of every run of 2 or more leading words: whole ones that occur `least` times, all others.

    `rows` are word numbers with 0 behind the last word; `hot` marks words by number. A phrase is whole if one of its
    words is not hot. Parts are pointers to rows that agree in `prefix`; `key` is their next word.
    """
    columns = [np.ascontiguousarray(rows[:, k]) for k in range(rows.shape[1])]

    def equal_part(prefix, number, pointers, total, whole):
        whole = whole or not hot[number]
        if whole and total < least:
            return
        prefix = (*prefix, int(number))
        if len(prefix) > 1:
            yield prefix, int(total), bool(whole)
        if len(prefix) < len(columns):
            key = columns[len(prefix)][pointers]
            stack.append((prefix, pointers[key > 0], key[key > 0], whole))

    stack = [((), np.arange(len(rows)), columns[0], False)]
    while stack:
        prefix, pointers, key, whole = stack.pop()
        if not len(pointers) or (whole or not hot[key].any()) and counts[pointers].sum() < least:
            continue
        if len(pointers) <= SMALL:
            order = np.argsort(key, kind="stable")
            pointers, key = pointers[order], key[order]
            places = np.flatnonzero(np.diff(key, prepend=-1))
            totals = np.add.reduceat(counts[pointers], places)
            ends = np.append(places[1:], len(key))
            kept = totals >= least
            if not whole:
                kept |= hot[key[places]]
            for i in np.flatnonzero(kept):
                yield from equal_part(prefix, key[places[i]], pointers[places[i] : ends[i]], totals[i], whole)
            continue
        pivot = np.partition(key[:: len(key) // 64], 32)[32]
        for side in (key < pivot, key > pivot):
            stack.append((prefix, pointers[side], key[side], whole))
        same = pointers[key == pivot]
        yield from equal_part(prefix, pivot, same, counts[same].sum(), whole)


_FOUND = "lang string, phrase string, words int, a bigint, whole boolean"


def _sort_bucket(hot: dict[str, set[bytes]], least: int):
    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("lang", "phrase", "words", "a", "whole")}
        langs = np.asarray(table["lang"].to_pylist(), object)
        blobs = {c: table[c].to_pylist() for c in ("words", "ids", "counts")}
        for lang in dict.fromkeys(langs):
            numbers, rows, counts = _Numbers(), [], []
            for i in np.flatnonzero(langs == lang):
                times = np.frombuffer(blobs["counts"][i], "<u4")
                ids = np.frombuffer(blobs["ids"][i], "<u2" if len(blobs["ids"][i]) == 2 * MAX_WORDS * len(times) else "<u4")
                own = np.array([0, *map(numbers.__getitem__, blobs["words"][i].split(b" "))], np.int32)
                rows.append(own[ids.reshape(MAX_WORDS, -1)].T)
                counts.append(times.astype(np.int64))
            words = [w.decode() for w in numbers.words]
            common = hot.get(lang, set())
            flags = np.fromiter((w in common for w in numbers.words), bool, len(words))
            for phrase, n, whole in quicksort_phrases(np.concatenate(rows), np.concatenate(counts), flags, least):
                out["phrase"].append(" ".join(words[i] for i in phrase))
                out["words"].append(len(phrase))
                out["a"].append(n)
                out["whole"].append(whole)
            out["lang"] += [lang] * (len(out["a"]) - len(out["lang"]))
        return pa.table(out, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()), ("whole", pa.bool_())]))

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = MIN_COUNT, hot: int = HOT, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, phrase, words, a): every phrase of 2 to MAX_WORDS words that occurs `least` times, given all word counts."""
    total = words.agg(F.sum("n")).first()[0] or 0
    common: dict[str, set[bytes]] = {}
    for r in words.where(F.col("n") > hot).select("lang", "word").toLocalIterator():
        common.setdefault(r["lang"], set()).add(r["word"].encode())
    routed = _texts(docs).mapInArrow(_route_suffixes(common, max(1, math.ceil(total / bucket_words))), _ROUTED)
    found = stage(routed.groupBy("bucket").applyInArrow(_sort_bucket(common, least), _FOUND), "phrases")
    added = found.where("NOT whole").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("whole").drop("whole").unionByName(added)


# ---- scores ----


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exact beyond 64 bits."""
    whole = "CAST({} AS decimal(19,0))"
    return F.expr(f"({whole.format(a)} * CAST(2000000 AS decimal(7,0))) div ({whole.format(l)} + {whole.format(r)})")


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, hot: int = HOT, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Each language's best `top` phrases: lang, rank, phrase, a, l, r, n, score, words.

    A null text is an empty one, a null lang is `und`; empty texts, and texts of punctuation, have no words. Rows are
    documents of their own, so repeated rows count again. A very long text counts whole. Equal scores
    are ordered by a, then phrase. An empty table gives an empty table; other columns are not read.
    """
    words = stage(word_counts(docs), "words")
    phrases = stage(phrase_counts(docs, words, least, hot, bucket_words), "candidates")
    parts = stage(
        phrases.select("lang", "phrase", F.col("a").alias("f")).unionByName(
            words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))), "parts")
    named = lambda part, count: parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"])
    lowest = cuts.withColumn("score", score_of("a", "l", "r")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("words").alias("words"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pieces = phrases.where("words > 2").withColumn("_words", F.split("phrase", " ")).select(
        "lang", F.col("a").alias("f"), F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(_words, i, m), ' '))))"
        )).alias("phrase"))
    longest = pieces.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    alone = lowest.join(longest, ["lang", "phrase"], "left").where(
        F.col("f").isNull() | (_wide("f") * 100 < _wide("a") * 80))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "words")
