"""Byte-level BPE: array pre-tokenisation, cached pair merging, and decoding from ids and offsets.

Pre-tokenisation works on arrays of code points. Each code point becomes one of nine symbols (its class, and for
blanks and apostrophes what follows them); an automaton of eight states over symbols says where a piece begins.
The state before every code point comes from a scan: the text is cut into lanes, the transition functions of a lane
are composed column by column, composition is associative, so a doubling scan over lanes gives each lane's first state,
and a second pass over columns gives the rest. No regular expression is run over a text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, slabs

# Code points of white space.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe to make a piece of its own.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, OTHER, CUT2, CUT3, BLANK, LEAD, LAST_BLANK, RESET = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_LEAD, ONE_LEFT, TWO_LEFT = range(8)
_LANE = 256
_CACHED_PIECES, _CACHED_BYTES = 200_000, 40
_NO_PAIR = 1 << 40


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER of every code point, from its general category."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = BLANK
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by state and symbol."""
    state, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        state[:, symbol] = run
        begins[[run, AFTER_LEAD], symbol] = False
    for symbol, run in ((CUT2, ONE_LEFT), (CUT3, TWO_LEFT)):
        state[:, symbol] = run
        state[[IN_OTHERS, AFTER_LEAD], symbol] = IN_OTHERS
        begins[[IN_OTHERS, AFTER_LEAD], symbol] = False
    state[ONE_LEFT, LETTER], state[TWO_LEFT, LETTER] = START, ONE_LEFT
    begins[[ONE_LEFT, TWO_LEFT], LETTER] = False
    state[:, BLANK] = IN_BLANKS
    begins[IN_BLANKS, BLANK] = False
    state[:, LEAD], state[:, LAST_BLANK], state[:, RESET] = AFTER_LEAD, START, START
    return state.ravel(), begins.ravel()


def symbols_of(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of joined texts; `resets` are the places of the separators between them."""
    kind = _classes()[points]
    kind[resets] = RESET
    after = np.append(kind[1:], RESET)
    blank = kind == BLANK
    last = blank & (after != BLANK) & (after != RESET)
    symbols = kind.copy()
    symbols[last] = LAST_BLANK
    symbols[last & (points == 32)] = LEAD
    at = np.flatnonzero(points == ord("'"))
    at = at[kind[at] != RESET]
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    second, third = padded[at + 1], padded[at + 2]
    symbols[at[np.isin(second, [ord(e) for e in SHORT_ENDINGS])]] = CUT2
    for ending in LONG_ENDINGS:
        symbols[at[(second == ord(ending[0])) & (third == ord(ending[1]))]] = CUT3
    return symbols


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol."""
    step, begins = _automaton()
    n = len(symbols)
    lanes = -(-n // _LANE)
    grid = np.full(lanes * _LANE, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, _LANE).T)
    # The function of a lane: the state it ends in, for every state it may begin in.
    ends = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, 1)
    for column in grid:
        ends = step[ends.astype(np.int16) * 9 + column]
    reach = 1
    while reach < lanes:
        ends[:, reach:] = np.take_along_axis(ends[:, reach:], ends[:, :-reach].astype(np.intp), 0)
        reach *= 2
    state = np.concatenate(([START], ends[START, :-1])).astype(np.int16)
    out = np.empty((_LANE, lanes), bool)
    for k, column in enumerate(grid):
        cell = state * 9 + column
        out[k] = begins[cell]
        state = step[cell].astype(np.int16)
    return np.ascontiguousarray(out.T).ravel()[:n]


def cut_texts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts as byte strings that share one buffer, with one zero byte behind each text, and the places of those."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = piece_starts(symbols_of(points, ends))
    starts[ends] = True
    cuts = np.flatnonzero(starts)
    widths = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
    behind = np.cumsum(widths, dtype=np.int64)
    offsets = np.append(behind[cuts] - widths[cuts], behind[-1]).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
    return pieces, np.searchsorted(cuts, ends)


def split_texts(texts: list[str]) -> Iterator[list[str]]:
    """Pieces of each text."""
    pieces, places = cut_texts(texts)
    first = 0
    for last in places.tolist():
        yield [p.decode() for p in pieces[first:last].to_pylist()]
        first = last + 1


def merge_side_by_side(token: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces, and how many each has; each round merges the first pair of lowest rank of every piece.

    `token`: the first ids of all pieces, `sizes` of each. `pairs`: left id << 32 | right id, ascending, `made`: the id
    that each pair makes, which is its rank as well.
    """
    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, made[at], _NO_PAIR)

    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.append(ranks(token[:-1], token[1:]), _NO_PAIR)
    rank[np.cumsum(sizes) - 1] = _NO_PAIR
    done = []
    while len(token):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
        over = lowest == _NO_PAIR
        done.append((owner[over], token[over]))
        hit = np.flatnonzero((rank == lowest) & ~over)
        hit = hit[np.diff(owner[hit], prepend=-1) != 0]
        token[hit] = rank[hit]
        kept = ~over
        kept[hit + 1] = False
        place = np.cumsum(kept) - 1
        owner, token, rank, hit = owner[kept], token[kept], rank[kept], place[hit]
        for at in (hit[(hit > 0)] - 1, hit):
            both = at[(at + 1 < len(owner))]
            both = both[owner[both] == owner[both + 1]]
            rank[at] = _NO_PAIR
            rank[both] = ranks(token[both], token[both + 1])
    owner, token = (np.concatenate(side) for side in zip(*done, strict=True)) if done else (owner, token)
    return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


class Vocabulary:
    """Ranks of byte strings, merged pair by pair with the lowest rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.bytes = pa.array(self.tokens, pa.binary())
        # All pairs of tokens that make a token, in order, and what they make.
        halves = ((self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t)))
        pairs = np.array([(a << 32 | b, r) for a, b, r in halves if a is not None and b is not None], np.int64).reshape(-1, 2)
        self.pairs, self.made = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: a queue of neighbours by (rank, place), stale entries skipped."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(queue, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of many short pieces at once."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts = merge_side_by_side(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], sizes, self.pairs, self.made)
        flat, cuts = ids.astype(np.int32).tobytes(), 4 * np.cumsum(counts)
        return [flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def ids(self, pieces: list[str]) -> bytes:
        """Joined 32-bit ids of pieces."""
        return b"".join(self.ids_of_each([p.encode("utf-8", "surrogatepass") for p in pieces]))

    def ids_of_each(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of each piece; short pieces are remembered until the cache is full."""
        cache, ranks, whole = self.cache, self.ranks, self.of_byte.min() >= 0
        found = [cache.get(p) for p in pieces]
        short = []
        for i, known in enumerate(found):
            if known is None:
                piece = pieces[i]
                if (rank := ranks.get(piece)) is not None:
                    found[i] = rank.to_bytes(4, "little")
                elif len(piece) <= _CACHED_BYTES and whole:
                    short.append(i)
                else:
                    found[i] = np.asarray(self.merge(piece), np.int32).tobytes()
        if short:
            own = [pieces[i] for i in short]
            if len(cache) + len(own) > _CACHED_PIECES:
                cache.clear()
            for i, piece, made in zip(short, own, self.merge_all(own), strict=True):
                found[i] = cache[piece] = made
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with the end of the last.

        Only the distinct pieces are merged; the ids of all pieces are then taken from theirs.
        """
        pieces, places = cut_texts(texts)
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        own = self.ids_of_each(coded.dictionary.to_pylist())
        count = np.fromiter((len(o) // 4 for o in own), np.int64, len(own))
        begin = np.cumsum(count) - count
        sizes = count[index]
        sizes[places] = 0
        behind = np.cumsum(sizes)
        flat = np.repeat(begin[index] - (behind - sizes), sizes) + np.arange(behind[-1])
        return np.frombuffer(b"".join(own), np.int32)[flat], np.concatenate(([0], behind[places]))

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The bytes of each text, whose ids begin at `cuts`."""
        taken = self.bytes.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[cuts])), data or pa.py_buffer(b"")])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slabs(texts):
                ids, cuts = vocab.encode(texts[a:b])
                ends = np.concatenate(([0], np.cumsum(vocab.lengths[ids])))
                # Ends within the own text: those of the texts before it are taken off.
                own = ends[1:] - np.repeat(ends[cuts[:-1]], np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], _lists(cuts, ids), _lists(cuts, own.astype(np.int32))], ["doc_id", "ids", "ends"])

    return run


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and ends: the ids of each text and the byte of the text where each token ends.

    A null or empty text has no ids. Rows do not depend on each other; rows without doc_id keep a null one, repeated
    rows are encoded each. An empty table gives an empty table; other columns are left out.
    """
    return doc_texts(docs).mapInArrow(_encode(vocabulary_path), "doc_id bigint, ids array<int>, ends array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            cuts = batch["ids"].offsets.to_numpy()
            ids = batch["ids"].values.to_numpy()[cuts[0] : cuts[-1]]
            cuts = cuts - cuts[0]
            decoded = vocab.decode(ids, cuts)
            ends, size = batch["ends"].flatten().to_numpy(), np.diff(cuts)
            last = ends[cuts[1:][size > 0] - 1] if len(ends) == len(ids) else None
            if last is None or not np.array_equal(last, np.diff(np.frombuffer(decoded.buffers()[1], np.int32))[size > 0]):
                raise ValueError("ids and offsets do not belong together")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], decoded], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and decoded bytes; ids whose offsets do not add up raise an error."""
    return encoded.select("doc_id", "ids", "ends").mapInArrow(
        _decode(vocabulary_path), "doc_id bigint, ids array<int>, decoded binary")


def _round_trip(path: str):
    encode_, decode_ = _encode(path), _decode(path)
    return lambda batches: decode_(encode_(batches))


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """decode(encode(docs)) within one task, so ids and offsets do not leave the worker in between."""
    return doc_texts(docs).mapInArrow(_round_trip(vocabulary_path), "doc_id bigint, ids array<int>, decoded binary")
