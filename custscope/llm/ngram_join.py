"""N-gram Jaccard join by prefix trees.

A document is the set of hashes of its word n-grams, in one global order: rarer first, as told by bit arrays of
fixed size over hashes that occur in 2, 8, 64, 1024 documents or more. Two sets of the wanted likeness share one of
their first n - ceil(t n) + 1 members. A member that occurs in one document only cannot be shared, so most documents
take no part after that step, and members common to many documents stand last in the order and out of the prefixes.

1. Documents with equal sets are one node. Nodes that have shareable prefix members go to a table, each once.
2. Prefix members are sorted. Within a run of nodes that share one, the node with the fewest members before it is the
   hub: it is compared with the others, so a run gives at most as many pairs as it has nodes. Linked nodes become one
   component; then runs that still hold several components get another hub, until a round joins nothing.
   Every row of a run carries the place of the member in its set. Where it is the first member that two sets share,
   they share no more than what remains from there on in the shorter rest; pairs that this bound rules out are left,
   here and in step 4. If it is not the first one, the pair also meets in the run of the first one.
3. Pairs are compared in a prefix tree: the sets that meet one hub lie in the global order with the lengths of their
   common prefixes, which is the tree walked depth first. Overlaps counted along a shared prefix are used by all
   sets below it, and a branch whose remaining lengths cannot reach the wanted overlap is left.
4. Runs that still hold several components are joined across components and those pairs are compared as well, so
   no link that would join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import blocks, doc_texts, mix, shingle_hashes, slabs, word_hashes, words_of
from .components import components, extended

#: Documents in which a member of each level occurs at least, and bits over all members of that level.
LEVELS = ((2, 1 << 27), (8, 1 << 25), (64, 1 << 24), (1024, 1 << 24))
SPREAD = 16
#: Rounds of hubs at most; whatever they leave unjoined is compared pair by pair.
ROUNDS = 6


def _may_reach(n1: F.Column, at1: F.Column, n2: F.Column, at2: F.Column, num: int, den: int) -> F.Column:
    """Whether two sets that share nothing before these places can still share what the likeness takes."""
    return (num + den) * F.least(n1 - at1, n2 - at2) >= num * (n1 + n2)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """Ascending hashes of the n-grams of each text; A-Z are lower-cased."""
    for a, b in slabs(texts, 1 << 20):
        joined, starts, ends, first = words_of([t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]])
        codes = word_hashes(joined, starts, ends)
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield shingle_hashes(codes[i:j], width)


def node_of(members: np.ndarray) -> int:
    """One number for a set: equal sets have the same one."""
    return int(mix(np.array([mix(members).sum() + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def least_overlap(n: int, num: int, den: int) -> int:
    """ceil(t n): what a set of n members shares at least with a set of the wanted likeness."""
    return -(-num * n // den)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(lambda s: (node_of(s), len(s)), shingle_sets(batch["text"].to_pylist(), width)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([k for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                ["doc_id", "node", "n"])

    return run


def _place(members: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return ((members >> np.uint64(40)) % np.uint64(parts)).astype(np.int32), members.astype(np.uint32)


def _new_sets(texts: list[str], width: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets that this task has not met before."""
    for members in shingle_sets(texts, width):
        if len(members) and (node := node_of(members)) not in seen:
            seen.add(node)
            yield node, members


def _pack(width: int, parts: int):
    """The members of all sets, dealt to parts as 32-bit rests; a part's share of a batch is one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slabs(texts, 1 << 21):
                sets = [m for _, m in _new_sets(texts[a:b], width, seen)]
                if not sets:
                    continue
                part, rest = _place(np.concatenate(sets), parts)
                order = np.argsort(part, kind="stable")
                part, rest = part[order], rest[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[np.append(0, cuts)]), pa.array([x.tobytes() for x in np.split(rest, cuts)], pa.binary())],
                    ["part", "rests"])

    return run


def _levels(parts: int):
    """Bit arrays of one part: one for each level."""
    def run(table: pa.Table) -> pa.Table:
        rests, counts = np.unique(
            np.frombuffer(b"".join(table["rests"].to_pylist()), np.uint32), return_counts=True)
        out = []
        for least, bits in LEVELS:
            size = max(8, bits // parts // 8 * 8)
            flat = np.zeros(size, bool)
            flat[rests[counts >= least] % np.uint32(size)] = True
            out.append(np.packbits(flat, bitorder="little").tobytes())
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([out], pa.list_(pa.binary()))})

    return run


class Rarity:
    """The level of a member: how many of the bit arrays hold it."""

    def __init__(self, rows: list, parts: int):
        self.parts = parts
        self.sizes = [max(8, bits // parts // 8 * 8) for _, bits in LEVELS]
        self.bits = [np.zeros(parts * s // 8, np.uint8) for s in self.sizes]
        for row in rows:
            for flat, size, packed in zip(self.bits, self.sizes, row["bits"], strict=True):
                at = row["part"] * size // 8
                flat[at : at + size // 8] = np.frombuffer(packed, np.uint8)

    def code(self, members: np.ndarray) -> np.ndarray:
        """Members renumbered so that ascending numbers are the global order: level, then hash."""
        part, rest = _place(members, self.parts)
        level = np.zeros(len(members), np.uint64)
        for flat, size in zip(self.bits, self.sizes, strict=True):
            bit = part.astype(np.int64) * size + rest % np.uint32(size)
            level += flat[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
        return np.sort(level << np.uint64(60) | members >> np.uint64(4))


def _prefixes(width: int, num: int, den: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slabs(texts, 1 << 21):
                rows = []
                for node, members in _new_sets(texts[a:b], width, seen):
                    codes = rarity.value.code(members)
                    prefix = codes[: len(codes) - least_overlap(len(codes), num, den) + 1]
                    shared = prefix[prefix >= np.uint64(1 << 60)]
                    if len(shared):
                        skipped = len(prefix) - len(shared)
                        rows.append((node, len(codes), skipped, shared.view(np.int64), codes.astype(">u8").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                         pa.array([r[4] for r in rows], pa.binary())],
                        ["node", "n", "skipped", "prefix", "members"])

    return run


def _hub_pairs(num: int, den: int):
    """Rows come sorted by member: pairs of each node with the first of its run, if the bound allows and roots differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = hub = size = rest = own = None
        for batch in batches:
            out = set()
            rows = zip(*(batch[c].to_pylist() for c in ("member", "node", "n", "at", "root")), strict=True)
            for m, node, n, at, root in rows:
                if m != member:
                    member, hub, size, rest, own = m, node, n, n - at, root
                elif root != own and (num + den) * min(rest, n - at) >= num * (size + n):
                    out.add((hub, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return run


def walk_tree(hub: np.ndarray, sets: list[bytes], num: int, den: int) -> list[bool]:
    """Which sets reach the likeness with the hub. Sets are big-endian numbers in the global order."""
    order = sorted(range(len(sets)), key=sets.__getitem__)
    found = [False] * len(sets)
    path = np.empty(0, np.uint64)  # the branch walked last
    overlap = at = np.zeros(1, np.int64)  # per depth: shared members so far, hub members passed so far
    for i in order:
        own = np.frombuffer(sets[i], ">u8").astype(np.uint64)
        n = len(own)
        wanted = -(-num * (len(hub) + n) // (num + den))
        common = min(n, len(path))
        differ = np.flatnonzero(own[:common] != path[:common])
        depth = min(int(differ[0]) if len(differ) else common, len(overlap) - 1)
        overlap, at = overlap[: depth + 1], at[: depth + 1]
        # Down the own branch, in steps; the bound is what remains on the shorter side.
        while depth < n and overlap[-1] + min(n - depth, len(hub) - at[-1]) >= wanted:
            step = own[depth : depth + 256]
            place = np.searchsorted(hub, step)
            hit = hub[np.minimum(place, len(hub) - 1)] == step
            overlap = np.append(overlap, overlap[-1] + np.cumsum(hit))
            at = np.append(at, place + hit)
            depth += len(step)
        path = own
        found[i] = depth == n and overlap[-1] >= wanted
    return found


def _compare(num: int, den: int):
    """Rows come sorted by hub and copy, the hub's own set first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = hub = None
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"]
            own = np.asarray(b.is_null())
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1, np.flatnonzero(own), np.flatnonzero(own) + 1)))
            cuts = cuts[cuts < len(a)]
            for i, j in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
                sets = batch["members"].slice(i, j - i).to_pylist()
                if own[i]:
                    current, hub = a[i], np.frombuffer(sets[0], ">u8").astype(np.uint64)
                    continue
                assert current == a[i], "a hub comes before the sets that meet it"
                hit = pa.array(walk_tree(hub, sets, num, den))
                part = batch.slice(i, j - i).filter(hit)
                yield part.select(["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the likeness. One hub's sets are spread over SPREAD copies of it."""
    copy = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).alias("copy")
    met = pairs.select("a", "b", copy).join(sets.select(F.col("node").alias("b"), "members"), "b")
    hubs = pairs.select("a", copy).distinct().join(sets.select(F.col("node").alias("a"), "members"), "a")
    rows = met.select("a", "copy", "b", "members").unionByName(
        hubs.select("a", "copy", F.lit(None).cast("bigint").alias("b"), "members"))
    return (
        rows.repartition(blocks(pairs.sparkSession), "a", "copy").sortWithinPartitions("a", "copy", F.col("b").isNotNull())
        .mapInArrow(_compare(num, den), "a bigint, b bigint")
    )


def _still_open(labelled: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of runs that hold several components, without those that no other size in their run can match."""
    spread = [F.min("root").alias("_low"), F.max("root").alias("_high")]
    mixed = labelled.groupBy("member").agg(*spread, F.min("n").alias("_least")).where("_low <> _high")
    able = labelled.join(mixed.select("member", "_least"), "member").where(
        (num + den) * (F.col("n") - F.col("at")) >= num * (F.col("n") + F.col("_least"))).drop("_least")
    mixed = able.groupBy("member").agg(*spread).where("_low <> _high")
    return able.join(mixed.select("member"), "member", "left_semi")


def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when den * intersection >= num * union of their sets of `width` words; a text with fewer words is
    one n-gram, a null, empty or blank one has an empty set and links with nothing. Rows that share a doc_id
    are compared each and all get the smallest id. A row without doc_id links with nothing and has a null component. An
    empty table gives an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    parts = blocks(spark)
    texts = doc_texts(docs)
    members = stage(texts.mapInArrow(_sets(width), "doc_id bigint, node bigint, n bigint"), "sets")
    known = texts.where("doc_id IS NOT NULL")
    levels = (
        known.select("text").mapInArrow(_pack(width, parts), "part int, rests binary")
        .groupBy("part").applyInArrow(_levels(parts), "part int, bits array<binary>")
    )
    # The bit arrays have a fixed size whatever the corpus: 26 MB.
    rarity = spark.sparkContext.broadcast(Rarity(levels.collect(), parts))
    nodes = stage(
        known.select("text").mapInArrow(
            _prefixes(width, num, den, rarity),
            "node bigint, n bigint, skipped bigint, prefix array<bigint>, members binary"), "nodes")
    sets = nodes.select("node", "members").dropDuplicates(["node"])
    placed = nodes.select("node", "n", "skipped", F.posexplode("prefix").alias("_at", "member"))
    runs = stage(
        placed.select("node", "n", (F.col("skipped") + F.col("_at")).alias("at"), "member").distinct(), "prefixes")
    # Rounds of hubs, another one per run in each, until a round joins nothing.
    roots = None
    open_ = runs.withColumn("root", F.col("node"))
    for turn in range(ROUNDS):
        # The first hub has the fewest rare members of its own, so it is the nearest to what the run has in common.
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("at")
        pairs = (
            open_.repartition(parts, "member").withColumn("_order", order).sortWithinPartitions("member", "_order", "node")
            .select("member", "node", "n", "at", "root").mapInArrow(_hub_pairs(num, den), "a bigint, b bigint").distinct()
        )
        fresh = stage(linked(pairs, sets, num, den), "linked")
        if turn and fresh.isEmpty():
            break
        roots = components(fresh) if roots is None else extended(roots, fresh)
        # Only runs that still hold several components are looked at again.
        labelled = runs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = stage(_still_open(labelled, num, den), "open-runs")
    # What is left: pairs across components within a run. Two sets that share a stretch of members meet at its first
    # one only: where the members before are the same, they have met there.
    open_ = open_.withColumn("last", F.lag("member").over(Window.partitionBy("node").orderBy("member")))
    left, right = (open_.select("member", *[F.col(c).alias(c + s) for c in ("node", "n", "at", "root", "last")]) for s in "12")
    second = stage(
        left.join(right, "member").where("root1 < root2").where("last1 IS NULL OR last2 IS NULL OR last1 <> last2")
        .where(_may_reach(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), num, den))
        .select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct(), "pairs")
    merged = extended(roots, stage(linked(second, sets, num, den), "linked"))
    # A component is named by its smallest document; a node without links is its own component.
    placed = members.join(merged, "node", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("_root"))
    names = placed.groupBy("_root").agg(F.min("doc_id").alias("_name"))
    return placed.join(names.where("_root IS NOT NULL"), "_root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_name", "doc_id")).alias("component_id"))
