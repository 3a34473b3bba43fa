"""Spelling variants by blocked Gram matrices of letter counts.

1. Words are counted over all documents, in each task first.
2. One edit changes the counts of at most two letters, so it leaves all but two of PARTS groups of letters as they were.
   Letters are dealt to groups by their frequency; for every two groups left out, words that agree in the counts of the
   other groups form a block. Two near words share the block that leaves out the groups they differ in.
3. Inside a block, words stand by length; NumPy products of the letter counts of adjacent lengths (x.x + y.y - 2 x.y) are the
   squared distances. Pairs at most two apart are verified as one edit. A pair counts in one block only: the one
   that leaves out the groups it differs in and, if that is fewer than two, the first others.
4. Blocks give one row per word (near words, best near word), which are added up. Forms are followed by doubling:
   a form has at least twice the occurrences, so chains are short and without rings.

A block over TILE words is cut into parts and compared part by part, each pair of parts in a task of its own, so
a task holds at most two parts.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import blocks, mix

MIN_CHARS = 5
MIN_COUNT = 3
#: Runs whose hash this divides lose a code point.
ERRORS = 97
#: Groups of letters.
PARTS = 4
#: Words of a block that one task compares at once.
TILE = 4096
#: Rows of a product of letter counts.
STEP = 1024
#: Words held by a task's counter before it passes them on.
HELD = 500_000
# Runs of a-z and U+00C0 to U+00FF as UTF-8, of at least MIN_CHARS letters.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_CHARS)

# ---- words ----


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in Counter(_RUN.findall(text.encode().lower())).items():
                code = zlib.crc32(run, start)
                if code % ERRORS == 0:
                    letters = run.decode()
                    at = code % len(letters)
                    if len(letters) <= MIN_CHARS:
                        continue
                    run = (letters[:at] + letters[at + 1 :]).encode()
                counts[run] += n
            if len(counts) > HELD:
                yield out()
    yield out()


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least `min_count` occurrences."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---- letter counts ----


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def _letter_counts(words: list[str], letters: np.ndarray) -> np.ndarray:
    codes, lengths = _codes(words)
    flat = np.repeat(np.arange(len(words)) * len(letters), lengths) + np.searchsorted(letters, codes)
    return np.bincount(flat, minlength=len(words) * len(letters)).reshape(len(words), len(letters))


def letter_groups(words: DataFrame, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """The letters in order and the group of each: the next most frequent letter goes to the group with the fewest so far.

    The driver gets one row per letter of the alphabet.
    """
    seen = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    load, group = [0] * parts, {}
    for c, n in sorted(((r["c"], r["count"]) for r in seen), key=lambda x: (-x[1], x[0])):
        group[c] = load.index(min(load))
        load[group[c]] += n
    letters = sorted(group)
    return np.array([ord(c) for c in letters], np.uint32), np.array([group[c] for c in letters], np.int64)


def _left_out(parts: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(parts), 2))


def _block_keys(letters: np.ndarray, group: np.ndarray, parts: int):
    """A 64-bit key for each word and each two groups left out: sums of random numbers, one per letter."""
    weights = np.random.default_rng(7).integers(0, 1 << 63, len(letters), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            counts = _letter_counts(words, letters).astype(np.uint64)
            sums = [(counts[:, group == k] * weights[group == k]).sum(axis=1, dtype=np.uint64) for k in range(parts)]
            for pair, out in enumerate(_left_out(parts)):
                key = np.full(len(words), pair, np.uint64)
                for k in range(parts):
                    if k not in out:
                        key = mix(key + sums[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), pair, np.int32)), pa.array(key.view(np.int64)), batch["word"], pa.array(n)],
                    ["pair", "key", "word", "n"])

    return run


# ---- one block ----


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` and `b` (code points; `b` as wide or one wider) differ by exactly one edit."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(axis=1) == 1
    # Equal up to some place, equal behind it with one code point of b left out.
    straight, shifted = a != b[:, :width], a != b[:, 1:]
    first = np.where(straight.any(axis=1), straight.argmax(axis=1), width)
    last = np.where(shifted.any(axis=1), width - 1 - shifted[:, ::-1].argmax(axis=1), -1)
    return last < first


def _close(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a squared distance of at most two; i before j if both are of one block."""
    wide = np.float32 if max(x.max(), y.max()) < 1024 and x.shape[1] < 256 else np.float64
    x, y = x.astype(wide), y.astype(wide)
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    found = []
    for i in range(0, len(x), STEP):
        for j in range(i if same else 0, len(y), STEP):
            square = own[i : i + STEP, None] + other[None, j : j + STEP] - 2 * (x[i : i + STEP] @ y[j : j + STEP].T)
            near = square <= 2
            if same and i == j:
                near = np.triu(near, 1)
            at = np.nonzero(near)
            found.append((at[0] + i, at[1] + j))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def near_pairs(words: list[str], part: np.ndarray, pair: int, letters: np.ndarray, group: np.ndarray, parts: int):
    """(i, j): near words of one block that count in it. Words of the same `part` are not compared if there are two."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = _letter_counts(words, letters)
    counts = counts[:, counts.any(axis=0)]
    of_group = group[np.flatnonzero(_letter_counts(["".join(words)], letters)[0])]
    membership = of_group[:, None] == np.arange(parts)
    two = part.min() != part.max()
    where = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    left, right = [], []
    for n, own in where.items():
        for other in (own, where.get(n + 1)):
            if other is None:
                continue
            i, j = _close(counts[own], counts[other], other is own)
            i, j = own[i], other[j]
            if two:
                i, j = i[part[i] != part[j]], j[part[i] != part[j]]
            # The groups that the pair differs in; fewer than two are filled up with the first others.
            differs = (counts[i] != counts[j]) @ membership
            rank = np.argsort(~differs, axis=1, kind="stable")[:, :2]
            out = _left_out(parts)[pair]
            mine = (np.sort(rank, axis=1) == out).all(axis=1)
            i, j = i[mine], j[mine]
            step = max(1, (1 << 22) // (n + 1))
            for at in range(0, len(i), step):
                a, b = i[at : at + step], j[at : at + step]
                wide = len(words[b[0]])
                code = lambda rows, w: _codes([words[k] for k in rows])[0].reshape(len(rows), w)
                sure = one_edit(code(a, n), code(b, wide))
                left.append(a[sure])
                right.append(b[sure])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _compare_blocks(letters: np.ndarray, group: np.ndarray, parts: int):
    """Rows come sorted by block; a block that goes on in the next batch is kept until it is whole."""

    def of_block(words, n, part, pair):
        i, j = near_pairs(words, part, pair, letters, group, parts)
        if not len(i):
            return None
        ranks = np.empty(len(words), np.int64)
        ranks[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        own, other = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((ranks[other], -n[other], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        times = np.diff(np.append(first, len(own)))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in own[first]], pa.string()), pa.array(times), pa.array(n[other[first]]),
             pa.array([words[k] for k in other[first]], pa.string())], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]) if rest or batch else None
            if table is None or not len(table):
                continue
            table = table.combine_chunks()
            names = ("pair", "key", "tile", "part", "n")
            pair, key, tile, part, n = (table[c].to_numpy() for c in names)
            new = (np.diff(pair, prepend=-1) != 0) | (np.diff(tile, prepend=-1) != 0)
            new[1:] |= key[1:] != key[:-1]
            starts = np.append(np.flatnonzero(new), len(key))
            if batch is not None:
                rest = table.slice(starts[-2]).to_batches()[0]
                starts = starts[:-1]
            words = table["word"].slice(0, starts[-1]).to_pylist()
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 1 and (found := of_block(words[a:b], n[a:b], part[a:b], int(pair[a]))) is not None:
                    yield found

    return run


def near_words(words: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) with a near word; best: of largest n, then the smallest."""
    spark = words.sparkSession
    letters, group = letter_groups(words, parts)
    keyed = words.mapInArrow(_block_keys(letters, group, parts), "pair int, key bigint, word string, n bigint")
    large = keyed.groupBy("pair", "key").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts")).where("cuts > 1")
    # A block in c parts has tiles (i, j), i <= j: a word of part p goes to every tile that names p.
    own = F.pmod(F.xxhash64("word"), F.coalesce("cuts", F.lit(1))).cast("int")
    dealt = keyed.join(stage(large, "large"), ["pair", "key"], "left").withColumn("part", own).withColumn("other", F.explode(
        F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
    tiles = dealt.select(
        "pair", "key", (F.least("part", "other") * 65_536 + F.greatest("part", "other")).alias("tile"), "part", "word", "n")
    found = (
        tiles.repartition(blocks(spark), "pair", "key", "tile").sortWithinPartitions("pair", "key", "tile")
        .mapInArrow(_compare_blocks(letters, group, parts), _NEAR))
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best"))).alias("b"))
    return best.select("word", "n_near", (-F.col("b.down")).alias("best_n"), "b.best")


# ---- forms ----


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, over paths of doubling length."""
    reached = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(reached.join(ahead, "root", "left").select("word", "root", "_next"), "roots")
        if moved.where("_next IS NOT NULL").isEmpty():
            return reached
        reached = moved.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, min_count: int = MIN_COUNT, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """One row per word: word, n, form, root, n_near, form_n.

    A null or empty text has no words, a null doc_id is written as nothing before the colon. Rows that repeat count
    again. Ties among near words go to the smallest in code-point order; words of equal n are no form of each other.
    Very long texts count whole; a very long word is compared like any other. An empty table gives an empty table; other
    columns are not read.
    """
    words = stage(word_counts(docs, min_count), "words")
    near = words.join(near_words(words, parts, tile), "word", "left")
    formed = F.col("best_n") >= 2 * F.col("n")
    known = stage(near.select(
        "word", "n", F.when(formed, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
