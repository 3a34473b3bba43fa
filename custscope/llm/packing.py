"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Only lengths matter to a packing, and there are at most `capacity` of them. So the corpus is counted by length,
the plan is made on those counts (a pattern of lengths and how often it is repeated, so its size follows the
capacity and not the corpus), and every piece finds its own place from its length and its rank among pieces of that
length. Ranks are counted in blocks of (length, hash of the piece): a length that a third of all pieces
share is spread over all blocks. Ids never leave the task that made them unless they are asked for.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .byte_bpe import merge_side_by_side
from .common import blocks, doc_texts, slabs

CAPACITY = 2048
END_ID = 0
_CACHED_WORDS, _CACHED_CHARS = 500_000, 40
#: Marks that never belong to a contraction.
_MARKS = ".,!?;:*#$%&|"
_MARK_SET = frozenset(_MARKS)
#: Fixed rule of the vocabulary's byte alphabet: printable bytes are their own letter, the others are 256, 257, ...
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_RANK_BITS = 40


@lru_cache(1)
def tokenizer(path: str):
    """The tokenizer and a cache of word to ids; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded, {}


@lru_cache(1)
def _guests(path: str) -> list[str]:
    """Long words in the cache, which stay until the next call only."""
    return []


@lru_cache(1 << 12)
def _stays_letter(path: str, char: str) -> bool:
    """Whether the vocabulary's own rules leave a letter at the end of what they make of this one.

    Some turn into a letter and a combining mark, which the pattern keeps together with the marks behind it.
    """
    loaded, _ = tokenizer(path)
    return char.isalpha() and loaded.normalizer.normalize_str(char)[-1:].isalpha()


def _parts(path: str, word: str) -> tuple[str, str]:
    """A word and the marks after its last letter, which the vocabulary's pattern then parts."""
    core = word.rstrip(_MARKS)
    last = core[-1:]
    parted = last.isalpha() and (last.isascii() or _stays_letter(path, last))
    return (core, word[len(core) :]) if parted else (word, "")


def _letters(piece: str) -> str | None:
    """A word of small letters of the first 256 code points in the byte alphabet, else None.

    The vocabulary's rules neither rewrite nor part such a word, so its model can take it as it is.
    """
    if not (piece.isalpha() and piece.islower()):
        return None
    if piece.isascii():
        return piece
    return piece.encode().decode("latin-1").translate(_BYTE_LETTERS) if max(piece) <= "\xff" else None


def _spelled(loaded, pieces) -> dict[str, bytes]:
    """Little-endian 32-bit ids of each piece."""
    merge, found, rest = loaded.model.tokenize, {}, []
    for piece in pieces:
        if (own := _letters(piece)) is None:
            rest.append(piece)
        else:
            found[piece] = array("I", [t.id for t in merge(own)]).tobytes()
    encoded = loaded.encode_batch_fast(rest, add_special_tokens=False)
    found.update((p, np.asarray(e.ids, "<u4").tobytes()) for p, e in zip(rest, encoded, strict=True))
    return found


def ids_of_words(path: str, words: set[str]) -> dict[str, bytes]:
    """Little-endian 32-bit ids, for these words at least, until the next call; the cache behind it is emptied when full."""
    loaded, cache = tokenizer(path)
    guests = _guests(path)
    while guests:
        cache.pop(guests.pop(), None)
    if len(cache) + len(words) > _CACHED_WORDS:
        cache.clear()
    fresh = words.difference(cache)
    split = {w: _parts(path, w) for w in fresh if w[-1:] in _MARK_SET}
    pieces = {p for parts in split.values() for p in parts}
    found = _spelled(loaded, (fresh.difference(split) | pieces).difference(cache))
    ids = lambda p: found[p] if p in found else cache[p]
    found.update({w: ids(core) + ids(marks) for w, (core, marks) in split.items()})
    cache.update(found)
    guests += [w for w in found if len(w) > _CACHED_CHARS]
    return cache


@lru_cache(1)
def _merges(path: str) -> tuple[np.ndarray, ...] | None:
    """Ids of each byte inside a word and at its end, pairs of ids in order and what they make.

    None for a vocabulary whose ids do not ascend in the order of its merges.
    """
    model = json.loads(tokenizer(path)[0].to_str())["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    found = np.array([(vocab[a] << 32 | vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 2)
    if end is None or not len(found) or (np.diff(found[:, 1]) <= 0).any():
        return None
    letters = [chr(_BYTE_LETTERS.get(b, b)) for b in range(256)]
    starts = [np.array([vocab.get(c + e, -1) for c in letters], np.int64) for e in ("", end)]
    pairs, made = found[np.argsort(found[:, 0])].T.copy()
    return *starts, pairs, made


#: Bytes of plain words: small letters of ASCII, the first byte of the other small letters below U+0100, marks.
_LETTER, _LEAD, _MARK = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a") : ord("z") + 1], _KINDS[0xC3], _KINDS[[ord(c) for c in _MARKS]] = _LETTER, _LEAD, _MARK
#: The second bytes of those letters.
_SECOND = np.zeros(256, bool)
_SECOND[[b for b in range(0x9F, 0xC0) if b != 0xB7]] = True


def ids_of_plain_words(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words (not empty, UTF-8) are plain: small letters, then marks. Their ids, and how many each of them has.

    The vocabulary's rules keep such a word as it is and part it before its first mark only, so its merges can be
    made side by side.
    """
    merges = _merges(path)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    if merges is None or not len(data):
        return np.zeros(len(words), bool), np.empty(0, np.int64), np.empty(0, np.int64)
    starts, sizes = edges[:-1] - edges[0], np.diff(edges)
    kind = _KINDS[data]
    kind[1:][_SECOND[data[1:]] & (kind[:-1] == _LEAD)] = _LETTER
    mark, odd, opens = kind == _MARK, kind == 0, np.zeros(len(data), bool)
    opens[starts] = True
    odd[1:] |= mark[:-1] & ~mark[1:] & ~opens[1:]
    plain = ~np.logical_or.reduceat(odd, starts)
    begins = opens.copy()
    begins[1:] |= mark[1:] & ~mark[:-1]
    own = np.repeat(plain, sizes)
    begins, data, opens = begins[own], data[own], opens[own]
    first = np.flatnonzero(begins)
    parts = np.diff(np.append(first, len(data)))
    inside, closing, pairs, made = merges
    token = inside[data]
    token[first + parts - 1] = closing[data[first + parts - 1]]
    ids, counts = merge_side_by_side(token, parts, pairs, made)
    return plain, ids, np.add.reduceat(counts, np.flatnonzero(opens[first])) if len(first) else counts


def _plain(text: str) -> str:
    """The vocabulary has no capitals; those of the first 256 code points have one small form everywhere."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def document_ids(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text. The vocabulary drops white space, so words between blanks are encoded apart."""
    for a, b in slabs(texts):
        split = [_plain(t).replace("\n", " ").split(" ") for t in texts[a:b]]
        found = ids_of_words(path, set().union(*split))
        for words in split:
            yield b"".join(map(found.__getitem__, words))


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(
                batch["doc_id"].to_pylist(), document_ids(path, batch["text"].to_pylist()), strict=True
            ):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names[:n])

    return run


# ---- the plan ----


def _two_fit(room: int, counts: np.ndarray, below: np.ndarray) -> tuple[int, int] | None:
    """The two lengths still to be had whose sum is largest within `room`."""
    second = np.flatnonzero(counts[: room + 1])
    if not len(second):
        return None
    first = below[np.minimum(second, room - second)]
    alone = (first == second) & (counts[second] < 2)
    first = np.where(alone, below[np.maximum(second - 1, 0)], first)
    total = np.where(first > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] else None


def _largest_below(counts: np.ndarray) -> np.ndarray:
    """For each length the largest one up to it that is still to be had, 0 if none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with the number of sequences that follow it.

    A sequence is filled greedily, always with the largest length that fits. Then its smallest piece gives way to
    the two unpacked ones that fit the widened gap most tightly, for as long as that leaves less room. The
    pattern is repeated while all its lengths last, so each step uses up a length.
    """
    left, patterns = counts.astype(np.int64).copy(), []
    below = _largest_below(left)
    while below[-1]:
        free, taken, room = left.copy(), [], capacity
        view = below
        while room and (length := int(view[room])):
            # As many of this length as fit go in at once.
            n = min(room // length, int(free[length]))
            taken += [length] * n
            room -= n * length
            free[length] -= n
            if not free[length]:
                view = _largest_below(free)
        while room and len(taken) > 1:
            smallest = taken[-1]
            view = _largest_below(free)
            pair = _two_fit(room + smallest, free, view)
            if not pair or sum(pair) <= smallest:
                break
            taken = sorted([*taken[:-1], *pair], reverse=True)
            room += smallest - sum(pair)
            free[smallest] += 1
            for length in pair:
                free[length] -= 1
        used = np.bincount(taken, minlength=len(left))
        some = used > 0
        times = int((left[some] // used[some]).min())
        left[some] -= used[some] * times
        patterns.append((taken, times))
        below = _largest_below(left)
    return patterns


def placements(patterns: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) of runs, and the first sequence and offset of each run."""
    used, keys, firsts, offsets, sequence = [0] * size, [], [], [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            keys.append(length << _RANK_BITS | used[length])
            firsts.append(sequence)
            offsets.append(offset)
            used[length] += times
            offset += length
        sequence += times
    order = np.argsort(keys)
    return tuple(np.asarray(x, np.int64)[order] for x in (keys, firsts, offsets))


def _assign(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, offsets = runs.value
        for batch in batches:
            own = batch["length"].to_numpy() << _RANK_BITS | batch["_rank"].to_numpy()
            at = np.searchsorted(keys, own, "right") - 1
            rest = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(firsts[at] + own - keys[at]), pa.array(offsets[at])],
                [*rest.schema.names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and on request ids.

    A null or empty text is the end id alone. Documents longer than the capacity are cut into pieces of it;
    the last piece may be shorter. Every row is packed: rows that repeat a doc_id, or have none, are documents of their
    own. An empty table gives an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    made = stage(doc_texts(docs).mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), schema), "pieces")
    salted = made.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks(spark))))
    dealt = stage(salted.groupBy("length", "_block").agg(F.count("*").alias("_n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in dealt.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # `capacity` rows at most
        counts[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(placements(plan(counts, capacity), capacity + 1))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("_at", F.row_number().over(inside) - 1).join(first, ["length", "_block"])
        .select(*made.columns, (F.col("_first") + F.col("_at")).cast("bigint").alias("_rank"))
    )
    return ranked.mapInArrow(_assign(runs), schema + ", sequence_id bigint, offset bigint")
