"""What the text operators share: table reading, block sizes, packed word arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Fixed value: the blanks that the text contracts strip and split at.
BLANKS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session was started elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def blocks(spark: SparkSession) -> int:
    """Blocks that rows are dealt to: as many as the session has shuffle partitions, so a cluster's setting sizes them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(df: DataFrame) -> DataFrame:
    """doc_id and text, a null text read as an empty one; every other column is left behind."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_text(column) -> F.Column:
    """crc32 of a value written as text."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def slabs(texts, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` characters, so that arrays over a batch stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_RNG = np.random.default_rng(20_260_101)
_CELLS = _RNG.integers(0, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _RNG.integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS[0] = 1  # the first 64 bytes of a word count alike, whether or not a longer word stands in the same batch


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits: a bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: the joined bytes, word starts and ends, and the words before each text.

    Texts are joined by a blank, so no word spans two of them.
    """
    sizes = np.fromiter((len(d) for d in data), np.int64, len(data))
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = ~_BLANK[joined]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first_byte = np.concatenate(([0], np.cumsum(sizes + 1)))
    return joined, starts, ends, np.searchsorted(starts, first_byte)


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: sums of random numbers for (place, byte), mixed with the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    before = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(before, length)
    byte = joined[np.repeat(starts, length) + place]
    cell = _CELLS[place & 63, byte]
    if length.max() > 64:
        cell = cell * _TURNS[(place >> 6) & 4095] ^ (place >> 18).astype(np.uint64)
    return mix(np.add.reduceat(cell, before) + length.astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of each run of `width` words; a shorter text is one run, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mix(total + words[k : k + len(total)] + np.uint64(k + 1))
    return np.unique(total)
