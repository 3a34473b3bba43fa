"""Line deduplication by probing sharded minimal perfect hashes.

1. Every distinct line key of a document is hashed to 64 + 64 bits; documents and the largest id are counted
   per key, combining map-side, and keys in too few documents go.
2. The rest are dealt to shards. A shard is a minimal perfect hash (levels of bit arrays; a key takes the
   first level where it is alone) over the first 64 bits, and arrays of fingerprints (the other 64), document counts
   and largest ids, indexed by it. A shard is one row of a written table.
3. Documents send 16-byte probes to the shards, spread over `spread` copies of each, so that a line found in a
   third of all documents meets no single task. Shard rows sort before their probes: a task streams over
   its partition, holding one shard. Only hits go back to the documents, where lines are dropped.

No text moves in steps 1 to 3, nothing is broadcast and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import BLANKS, blocks, doc_texts, mix

MIN_CHARS = 40
MIN_DOCS = 5
SPREAD = 8
_STRIP = BLANKS.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer than `min_chars` code points."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key.lower()  # bytes: A-Z only


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


# ---- minimal perfect hash of 64-bit keys ----


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    return (mix(keys + turn) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Level sizes and their joined bit arrays. Each level keeps the keys that are alone in their slot."""
    sizes, bits, rest, level = [], [], keys, 0
    while len(rest):
        size = max(64, (len(rest) * 5 // 4 + 63) // 64 * 64)
        slot = _slots(rest, level, size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        rest, level = rest[~alone[slot]], level + 1
    return sizes, b"".join(bits)


class Mph:
    """Looks up slots 0..n-1; a key that was not indexed gets -1 or any slot, told apart by its fingerprint."""

    def __init__(self, sizes, bits: bytes):
        self.sizes = list(sizes)
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        self.flat = flat.view(bool)
        self.rank = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slot = base + _slots(keys[open_], level, size)
            hit = self.flat[slot]
            found[open_[hit]] = self.rank[slot[hit]]
            open_, base = open_[~hit], base + size
        return found


# ---- Spark steps ----

_KEYS = "h1 bigint, h2 bigint, doc_id bigint"
_SHARD = "shard int, levels array<bigint>, bits binary, fingerprints binary, counts binary, last_ids binary"
_PROBED = "h1 bigint, h2 bigint, doc_id bigint, n_docs bigint"


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = {key_hash(k) for line in text.encode().split(b"\n") if (k := line_key(line, min_chars))}
                digests += found
                ids += [doc_id] * len(found)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return run


def _build_shard(table: pa.Table) -> pa.Table:
    keys = table["h1"].to_numpy().view(np.uint64)
    # Two keys may agree in the first half: then the rest of their bits is folded in as well.
    keys = mix(keys ^ mix(table["h2"].to_numpy().view(np.uint64)))
    sizes, bits = build_mph(keys)
    order = np.argsort(Mph(sizes, bits).find(keys))
    pack = lambda name: table[name].to_numpy()[order].tobytes()
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "levels": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([bits], pa.binary()), "fingerprints": pa.array([pack("h2")], pa.binary()),
        "counts": pa.array([pack("n_docs")], pa.binary()), "last_ids": pa.array([pack("last_id")], pa.binary()),
    })


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard with the shard's own row first; hits in documents other than the last go out."""
    current = mph = None
    for batch in batches:
        shards = batch["shard"].to_numpy()
        index_rows = np.flatnonzero(~np.asarray(batch["bits"].is_null()))
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, index_rows, index_rows + 1)))
        cuts = cuts[cuts < len(shards)]
        for a, b in zip(cuts, np.append(cuts[1:], len(shards)), strict=True):
            if batch["bits"][int(a)].is_valid:
                row = {n: batch[n][int(a)].as_py() for n in ("levels", "bits", "fingerprints", "counts", "last_ids")}
                current, mph = int(shards[a]), Mph(row["levels"], row["bits"])
                prints, counts, last = (np.frombuffer(row[n], np.int64) for n in ("fingerprints", "counts", "last_ids"))
                continue
            if int(shards[a]) != current:
                continue  # a shard without keys: nothing to find
            part = batch.slice(a, b - a)
            h1, h2, ids = (part[n].to_numpy() for n in ("h1", "h2", "doc_id"))
            slot = mph.find(mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64))))
            hit = (slot >= 0) & (prints[slot] == h2)
            hit &= last[slot] != ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h1[hit], h2[hit], ids[hit], counts[slot[hit]])],
                ["h1", "h2", "doc_id", "n_docs"])


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, spread: int) -> DataFrame:
    """(doc_id, h1, h2, n_docs): keys that a document loses."""
    spark = docs.sparkSession
    shards = blocks(spark)
    keys = docs.where("doc_id IS NOT NULL").mapInArrow(_hash_lines(min_chars), _KEYS)
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    counted = (
        keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
        .where(F.col("n_docs") >= min_docs)
    )
    index = stage(
        counted.select(shard, "h1", "h2", "n_docs", "last_id").groupBy("shard").applyInArrow(_build_shard, _SHARD),
        "line-index",
    )
    copies = index.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("copy"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("h1", "h2", "doc_id")],
    )
    probes = keys.select(
        shard, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("levels", "array<bigint>"), ("bits", "binary"), ("fingerprints", "binary"), ("counts", "binary"),
            ("last_ids", "binary"))],
        F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("copy"), "h1", "h2", "doc_id",
    )
    return (
        copies.unionByName(probes).repartition(shards, "shard", "copy")
        .sortWithinPartitions("shard", "copy", F.col("bits").isNull())
        .mapInArrow(_probe, _PROBED)
    )


def _drop(min_chars: int, carry: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept_text": []}
            for text, lost in zip(batch["text"].to_pylist(), batch["_lost"].to_pylist(), strict=True):
                lines = text.encode().split(b"\n")
                kept = lines
                if lost:
                    gone = {np.array([h["h1"], h["h2"]], np.int64).tobytes() for h in lost}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k) not in gone]
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept_text"].append(b"\n".join(kept).decode() if lost else text)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(batch[c] for c in carry), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()),
                 pa.array(out["kept_text"], pa.string())], ["doc_id", *carry, "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, spread: int = SPREAD,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, the columns named in `carry`, n_lines (before), n_dropped, kept_text.

    A null or empty text is one empty line. Rows that share a doc_id are documents of their own when counted, and
    all of them keep a key whose largest id is theirs. A row without doc_id is neither counted nor
    changed. Lines shorter than `min_chars` always stay. An empty table gives an empty table; other columns are left out.
    """
    texts = docs.select("doc_id", *carry, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lost = (
        repeated_lines(doc_texts(texts), min_chars, min_docs, spread).dropDuplicates(["doc_id", "h1", "h2"])
        .groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("_lost"))
    )
    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return texts.join(lost, "doc_id", "left").mapInArrow(
        _drop(min_chars, carry), f"doc_id bigint, {carried}n_lines bigint, n_dropped bigint, kept_text string")


def sha256_text(column: str) -> F.Column:
    return F.sha2(F.encode(F.col(column), "UTF-8"), 256)


