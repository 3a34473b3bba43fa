"""Language-model scores: word counts of the whole corpus, and a causal self-attention model on subword ids.

Documents are dealt to blocks by a hash of their id. Each block sends its distinct words with their training
counts once; words are counted over all blocks, and each block gets back the counts of its own words. So what moves
is the text once and a vocabulary per block, whatever the corpus; nothing is broadcast that grows with it. Documents
are then written as subword ids, which the training passes and the scores read.

The attention model predicts the class of the next subword from a window; a subword's share of its class comes from
counts over all training words. Long texts are scored in overlapping windows: a window sees CONTEXT subwords of the
one before it, and every subword is scored once.

Training reads all training documents: classes come from the transitions of all of them, and every subword and END is
a target once (more often in a small corpus). Tasks train side by side on their share of the windows, and their weights are
averaged after each of ROUNDS slices of the corpus. What the driver gets has the size of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import blocks, crc_text, doc_texts
from .packing import ids_of_plain_words, ids_of_words, tokenizer

#: Fixed values of the tokenizer: its ids, the one before a text and the one that ends it.
VOCABULARY, BEGIN, END = 49408, 49406, 49407
#: Half a window, so that every subword behind the first window is predicted from more than WINDOW / 2 subwords.
WINDOW, CONTEXT = 32, 16
#: Half windows scored at once, and places whose classes are weighed at once: their arrays stay in a core's cache.
BATCH, ROWS = 128, 512
#: Documents whose words are looked up at once, and words spelled at once.
SLAB, SPELLED = 1024, 20_000
#: Windows that training passes at least: a corpus with fewer is passed several times, a larger one once.
SAMPLE = 96_000
#: Windows for each task that trains, and the slices after which tasks average their weights.
WINDOWS_A_TASK, ROUNDS = 50_000, 4
FOLDS, HELD_OUT_FOLD = 7, 2
SINGLE_CLASSES, GROUP_CLASSES, WIDTH = 64, 64, 16


# ---- the model ----


def frequent_columns(counts: np.ndarray) -> np.ndarray:
    """The place of each subword among the most frequent, or SINGLE_CLASSES."""
    column = np.full(VOCABULARY, SINGLE_CLASSES, np.int64)
    column[np.argsort(-counts, kind="stable")[:SINGLE_CLASSES]] = np.arange(SINGLE_CLASSES)
    return column


def transitions(streams: list[np.ndarray], column: np.ndarray) -> np.ndarray:
    """How often each subword follows each column, BEGIN and END included."""
    flat = _cut(streams, WINDOW)[0]
    follows = flat[1:] != BEGIN
    at = flat[1:][follows] * (SINGLE_CLASSES + 1) + column[flat[:-1][follows]]
    return np.bincount(at, minlength=VOCABULARY * (SINGLE_CLASSES + 1)).reshape(VOCABULARY, -1)


def subword_classes(table: np.ndarray, column: np.ndarray, rng) -> np.ndarray:
    """A class for each subword: the most frequent have their own, the rest are grouped by what they follow."""
    seen = table.sum(1)
    some = np.flatnonzero(seen > 0)
    rows = np.sqrt(table[some] / seen[some, None]).astype(np.float32)
    centres = rows[rng.choice(len(rows), min(GROUP_CLASSES, len(rows)), replace=False)]
    for _ in range(8):
        near = (rows @ centres.T).argmax(1)
        weighted = np.zeros_like(centres)
        np.add.at(weighted, near, rows * seen[some, None])
        centres = weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    out = np.full(VOCABULARY, SINGLE_CLASSES, np.int64)  # never seen: the first group
    out[some] = SINGLE_CLASSES + near
    frequent = column < SINGLE_CLASSES
    out[frequent] = column[frequent]
    return out


def _cut(streams: list[np.ndarray], stride: int) -> tuple[np.ndarray, ...]:
    """All streams with BEGIN and END in one array, and windows of it: owner, place in the stream, start and size.

    A first window predicts WINDOW subwords, each later one begins `stride` further on.
    """
    flat = np.concatenate([part for s in streams for part in ([BEGIN], s, [END])]).astype(np.int64)
    n = np.fromiter(map(len, streams), np.int64, len(streams)) + 1
    begins = np.cumsum(n + 1) - (n + 1)
    windows = 1 + -(-np.maximum(n - WINDOW, 0) // stride)
    owners = np.repeat(np.arange(len(streams)), windows)
    skipped = stride * (np.arange(len(owners)) - np.repeat(np.cumsum(windows) - windows, windows))
    return flat, owners, skipped, begins[owners] + skipped, np.minimum(n[owners] - skipped, WINDOW)


def _halves(streams: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """All streams cut into rows of CONTEXT places: subwords, the ones they are followed by, which places are of a
    stream, and each stream's first row."""
    n = np.fromiter(map(len, streams), np.int64, len(streams))
    parts = n // CONTEXT + 1
    rows = np.cumsum(parts) - parts
    starts = rows * CONTEXT
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    ids, want = np.full((2, parts.sum() * CONTEXT), END)
    ids[starts] = BEGIN
    ids[at + 1] = want[at] = np.concatenate(streams)
    counts = np.zeros(len(ids), bool)
    counts[at] = counts[starts + n] = True
    return *(t.reshape(-1, CONTEXT) for t in (ids, want, counts)), rows


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def _wide(values: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Each value a row of equal numbers: sums with it are faster than with a column."""
    return np.repeat(values, width).reshape(-1, width)


ROOT = np.float32(1 / np.sqrt(WIDTH))
#: No subword sees a later one.
EARLIER = np.tri(WINDOW, dtype=np.float32)


@dataclass
class AttentionLm:
    weights: dict[str, np.ndarray]
    classes: np.ndarray
    share: np.ndarray  # log10 of a subword's share of its class: as first subword of a word, and further on
    closes: np.ndarray  # subwords that end a word

    def products(self) -> dict[str, np.ndarray]:
        """The matrices that only ever meet each other, multiplied once."""
        w = self.weights
        return {"link": w["query"] @ w["key"].T * ROOT, "pull": w["value"] @ w["merge"], "size": np.exp(w["bias"])}

    def seen(self, ids: np.ndarray, products: dict[str, np.ndarray], first: int = 0) -> dict[str, np.ndarray]:
        """ids: windows of at most WINDOW subwords, one row each. Gives, from place `first` on, what the classes are
        weighed by ("h") and what led to it.

        Keys and values are never made: energy is x query key' x', and what is merged is a x value merge.
        """
        n = ids.shape[1]
        x = self.weights["embed"].take(ids, 0)
        x += self.weights["place"][:n]
        own = _flat(np.ascontiguousarray(x[:, first:]))
        turned = np.ascontiguousarray(x.transpose(0, 2, 1))
        asks = (own @ products["link"]).reshape(len(ids), n - first, WIDTH)
        a = asks @ turned
        # exp, not exp2: numpy has fast code for it on every processor, for exp2 on some only.
        a = np.exp(np.clip(a, -60, 60, out=a), out=a)
        a *= EARLIER[first:n, :n]
        weight = _wide(_flat(a) @ np.ones(n, np.float32))
        mixed = _flat(a @ x)
        mixed /= weight
        h = mixed @ products["pull"]
        h += own
        np.tanh(h, out=h)
        return {"x": x, "own": own, "turned": turned, "asks": asks, "a": a, "weight": weight, "mixed": mixed, "h": h}

    def forward(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """What each place of each window gives every class, and the sum over classes."""
        # h lies between -1 and 1 and weights are small, so the exponential stays finite without a shift.
        products = self.products()
        p = np.exp(self.seen(ids, products)["h"] @ self.weights["out"]) * products["size"]
        return {"p": p.reshape(*ids.shape, -1), "total": p.sum(1).reshape(*ids.shape, 1)}

    def _weighed(self, h: np.ndarray, target: np.ndarray, size: np.ndarray, room: np.ndarray) -> Iterator[tuple]:
        """ROWS places at a time: which they are, exp of what they give each class without the bias (in `room`, whose
        memory is used again), the sum over classes with it, where the target classes lie, and the logits of these."""
        begins = np.arange(0, ROWS * len(size), len(size))
        for k in range(0, len(h), ROWS):
            some = slice(k, k + ROWS)
            own = h[some]
            p = np.matmul(own, self.weights["out"], out=room[: len(own)])
            at = begins[: len(own)] + target[some]
            hit = p.ravel().take(at)
            np.exp(p, out=p)
            yield some, p, p @ size, at, hit

    def gradients(
        self, ids: np.ndarray, target: np.ndarray, counts: np.ndarray, room: np.ndarray | None = None,
    ) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean log loss of the target classes that count, its gradients, and the rows of "embed" that they are for."""
        w, products, (m, n) = self.weights, self.products(), ids.shape
        f, size = self.seen(ids, products), products["size"]
        x, a, h, target = f["x"], f["a"], f["h"], target.ravel()
        if room is None:
            room = np.empty((ROWS, len(size)), h.dtype)
        scale = counts.ravel() / np.float32(np.count_nonzero(counts))
        own, back = size.take(target), np.ascontiguousarray((w["out"] * size).T)
        likely, dz, out, weighed = np.empty_like(own), np.empty_like(h), np.zeros((len(size), WIDTH), h.dtype), np.zeros_like(size)
        for some, p, total, at, hit in self._weighed(h, target, size, room):
            likely[some] = hit - np.log(total)
            # p size each is the probability of each class, scaled; less the target's own it is the gradient of the logits.
            each = scale[some] / total
            spread = _wide(each)
            p.ravel()[at] = np.exp(hit) - total / own[some]
            out += p.T @ (h[some] * spread)
            weighed += each @ p
            np.multiply(p @ back, spread, out=dz[some])
        loss = -(scale @ (likely + w["bias"].take(target)))
        g = {"out": out.T * size, "bias": weighed * size}
        h *= h
        dz *= np.subtract(1, h, out=h)
        pulled = f["mixed"].T @ dz
        g["merge"], g["value"] = w["value"].T @ pulled, pulled @ w["merge"].T
        dm = dz @ np.ascontiguousarray(products["pull"].T)
        dm /= f["weight"]
        mean = _wide((dm * f["mixed"]) @ np.ones(WIDTH, np.float32), n)
        dm = dm.reshape(x.shape)
        de = dm @ f["turned"]
        de -= mean.reshape(m, n, n)
        de *= a
        asked = _flat(de @ x)
        linked = f["own"].T @ asked * ROOT
        g["query"], g["key"] = linked @ w["key"], linked.T @ w["query"]
        dx = dz
        dx += asked @ np.ascontiguousarray(products["link"].T)
        dx = dx.reshape(x.shape)
        dx += a.transpose(0, 2, 1) @ dm
        dx += de.transpose(0, 2, 1) @ f["asks"]
        g["place"] = np.zeros_like(w["place"])
        g["place"][:n] = dx.sum(0)
        short = ids.astype(np.uint16).ravel()  # few bytes to sort
        order = np.argsort(short, kind="stable")
        met = short[order]
        fresh = np.ones(len(met), bool)
        np.not_equal(met[1:], met[:-1], out=fresh[1:])
        begins = np.flatnonzero(fresh)
        g["embed"] = np.add.reduceat(_flat(dx).take(order, 0), begins)
        return float(loss), g, met[begins].astype(np.int64)

    def score(self, streams: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each stream of subwords, BEGIN before and END after it left out of the input."""
        if not streams:
            return np.empty(0)
        # The first window scores WINDOW subwords, each later one what it adds to its CONTEXT: so the first half
        # window of a stream stands alone, and any other one is seen behind the half before it.
        ids, want, counts, rows = _halves(streams)
        alone = np.zeros(len(ids), bool)
        alone[rows] = True
        products, classes = self.products(), self.classes[want]
        found, bias = np.empty(ids.shape, np.float32), self.weights["bias"]
        # The largest array is made once: fresh memory costs more than the sums in it.
        room = np.empty((ROWS, len(bias)), np.float32)
        for some, first in ((np.flatnonzero(alone), 0), (np.flatnonzero(~alone), CONTEXT)):
            for k in range(0, len(some), BATCH):
                own = some[k : k + BATCH]
                h = self.seen(np.concatenate([ids[own - 1], ids[own]], 1) if first else ids[own], products, first)["h"]
                cls, sums = classes[own].ravel(), np.empty(len(h), np.float32)
                hits = bias[cls]
                for part, _, total, _, hit in self._weighed(h, cls, products["size"], room):
                    hits[part] += hit
                    sums[part] = total
                hits -= np.log(sums)
                found[own] = hits.reshape(-1, CONTEXT)
        inside = (~self.closes[ids]).astype(np.int64)
        each = np.where(counts, found.astype(np.float64) / np.log(10) + self.share[inside, want], 0).sum(1)
        return np.add.reduceat(each, rows)


def drawn(table: np.ndarray, placed: np.ndarray, closes: np.ndarray, seed: int = 11) -> AttentionLm:
    """The model before training. `table`: transitions over all training documents; `placed` counts subwords over all
    training words, first or further on."""
    rng, counts = np.random.default_rng(seed), placed.sum(0)
    n_classes = SINGLE_CLASSES + GROUP_CLASSES
    classes = subword_classes(table, frequent_columns(counts), rng) if table.any() else np.arange(VOCABULARY) % n_classes
    smooth = counts + 0.5
    share = np.empty((2, VOCABULARY))
    for row, own in zip(share, placed, strict=True):
        # Subwords that the place has not shown borrow a little from all places.
        own = own + smooth * 1e-3 + 1e-3
        row[:] = np.log10(own / np.bincount(classes, own, n_classes)[classes])
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    weights = {
        "embed": rng.normal(0, 0.3, (VOCABULARY, WIDTH)).astype(np.float32),
        "place": rng.normal(0, 0.1, (WINDOW, WIDTH)).astype(np.float32),
        **{k: draw(WIDTH, WIDTH) for k in ("query", "key", "value", "merge")},
        "out": draw(WIDTH, n_classes), "bias": np.log(np.bincount(classes, smooth, n_classes) / smooth.sum() + 1e-9).astype(np.float32),
    }
    return AttentionLm(weights, classes, share, closes)


def train(
    model: AttentionLm, streams: list[np.ndarray], passes: int, seed, span: tuple[float, float] = (0.0, 1.0), batch: int = 48,
    rate: float = 6e-3,
) -> tuple[int, np.ndarray]:
    """Adam on all windows of the streams, `passes` times, in place. `span`: the part of the whole training that this is.

    Short windows and tails are filled up and masked. Gives the number of windows and how often each subword was met.
    """
    rng, weights, f4 = np.random.default_rng(seed), model.weights, np.float32
    flat, _, _, starts, sizes = _cut(streams, WINDOW)
    # All weights but the embeddings are parts of one array, so that a step changes them together.
    names = [k for k in weights if k != "embed"]
    dense = np.concatenate([weights[k].ravel() for k in names])
    ends = np.cumsum([weights[k].size for k in names])
    weights.update({k: part.reshape(weights[k].shape) for k, part in zip(names, np.split(dense, ends[:-1]), strict=True)})
    embed, means = weights["embed"], np.zeros((VOCABULARY, 2 * WIDTH), f4)  # of gradients and of their squares
    kept = np.repeat(np.array([0.9, 0.99], f4), WIDTH)
    dense_m, dense_v = np.zeros_like(dense), np.zeros_like(dense)
    room = np.empty((ROWS, len(weights["bias"])), f4)
    order = np.concatenate([rng.permutation(len(starts)) for _ in range(passes)])
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        place = np.arange(sizes[some].max())
        picked = np.minimum(starts[some][:, None] + place, len(flat) - 2)
        counts = place < sizes[some][:, None]
        ids = np.where(counts, flat[picked], END)
        _, grads, rows = model.gradients(ids, model.classes[flat[picked + 1]], counts, room)
        done = span[0] + (span[1] - span[0]) * (at + len(some)) / len(order)
        pace = f4(rate * min(1, 2 - 2 * done))
        g = grads["embed"]  # only the rows that were met
        fresh = means.take(rows, 0)
        fresh *= kept
        fresh += np.concatenate([f4(0.1) * g, f4(0.01) * g * g], 1)
        means[rows] = fresh
        embed[rows] = embed.take(rows, 0) - pace * fresh[:, :WIDTH] / (np.sqrt(fresh[:, WIDTH:]) + f4(1e-7))
        g = np.concatenate([grads[k].ravel() for k in names])
        dense_m[:] = f4(0.9) * dense_m + f4(0.1) * g
        dense_v[:] = f4(0.99) * dense_v + f4(0.01) * g * g
        dense -= pace * dense_m / (np.sqrt(dense_v) + f4(1e-7))
    return len(starts), np.bincount(flat, minlength=VOCABULARY)


def fit(
    streams: list[np.ndarray], placed: np.ndarray, closes: np.ndarray, steps: int = 2000, batch: int = 48,
    rate: float = 6e-3, seed: int = 11,
) -> AttentionLm:
    """A model trained on streams in one process, in as many whole passes as `steps` batches need.

    Without streams the weights stay as drawn and the model scores by its shares alone.
    """
    if not streams:
        return drawn(np.zeros((VOCABULARY, SINGLE_CLASSES + 1)), placed, closes, seed)
    model = drawn(transitions(streams, frequent_columns(placed.sum(0))), placed, closes, seed)
    train(model, streams, -(-steps * batch // len(_cut(streams, WINDOW)[3])), seed, batch=batch, rate=rate)
    return model


# ---- Spark steps ----


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _subwords(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit subword ids of all rows one after the other, and how many each row has."""
    edges = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data.view("<u2").astype(np.int64), np.diff(edges) // 2


def spelled(path: str, words: list[bytes]) -> list[bytes]:
    """16-bit subword ids of each word."""
    text = [w.decode("utf-8", "surrogatepass") for w in words]
    found = list(map(ids_of_words(path, set(text)).__getitem__, text))
    ids = np.frombuffer(b"".join(found), "<u4").astype("<u2").tobytes()
    ends = np.cumsum([len(f) // 2 for f in found]).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def spelled_words(path: str, words: pa.Array) -> pa.Array:
    """The same for an array of words: plain ones side by side, any other by the tokenizer."""
    plain, ids, counts = ids_of_plain_words(path, words)
    others = spelled(path, words.filter(pa.array(~plain)).to_pylist())
    sizes = np.empty(len(words), np.int64)
    sizes[plain], sizes[~plain] = counts, [len(o) // 2 for o in others]
    flat, edges = np.empty(sizes.sum(), "<u2"), np.append(0, np.cumsum(sizes))
    own = np.repeat(plain, sizes)
    flat[own], flat[~own] = ids, np.frombuffer(b"".join(others), "<u2")
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(flat)])


def coded_words(texts: pa.ChunkedArray) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words of texts, and for each SLAB of texts the numbers of its words and of the text that has each.

    The same words as those of `tokens`.
    """
    words, owners = [], []
    for k in range(0, len(texts), SLAB):
        found = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(texts.slice(k, SLAB).chunks)))
        kept = pc.not_equal(pc.binary_length(found.flatten()), 0)  # blanks at either end leave an empty word
        words.append(found.flatten().filter(kept).cast(pa.binary()))
        owners.append(pc.list_parent_indices(found).filter(kept).to_numpy())
    coded = pa.chunked_array(words, pa.binary()).dictionary_encode().unify_dictionaries()
    distinct = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())
    return distinct, [(c.indices.to_numpy(), o) for c, o in zip(coded.chunks, owners, strict=True)]


def _block_words(table: pa.Table) -> pa.Table:
    """The distinct words of a block and how often its training documents have each."""
    words, slabs = coded_words(table["text"])
    learned, counted = table["learned"].to_numpy(), np.zeros(len(words), np.int64)
    for k, (codes, owners) in enumerate(slabs):
        counted += np.bincount(codes[learned[k * SLAB :][owners]], minlength=len(words))
    return pa.table({
        "word": words, "block": pa.array(np.full(len(words), table["block"][0].as_py()), pa.int32()), "n": pa.array(counted)})


def closing(path: str) -> np.ndarray:
    """Which subwords end a word; BEGIN does as well."""
    out = np.zeros(VOCABULARY, bool)
    out[[i for t, i in tokenizer(path)[0].get_vocab().items() if t.endswith("</w>")]] = True
    out[BEGIN] = True
    return out


def _count_and_spell(path: str):
    """One row for each word of a partition that has all rows of its words: count, subword ids and blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("word", pa.binary()), ("block", pa.int32()), ("n", pa.int64())]))
        if not len(rows):
            return
        coded = rows["word"].dictionary_encode().unify_dictionaries()
        words, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        c = np.zeros(len(words), np.int64)
        np.add.at(c, codes, rows["n"].to_numpy())
        held = rows["block"].to_numpy()[np.argsort(codes, kind="stable")]
        ends = np.append(0, np.cumsum(np.bincount(codes)))
        for k in range(0, len(words), SPELLED):
            some = words.slice(k, SPELLED)
            at = ends[k : k + len(some) + 1]
            yield pa.RecordBatch.from_arrays([
                some, pa.array(c[k : k + len(some)]), spelled_words(path, some),
                pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(held[at[0] : at[-1]]))], ["word", "c", "ids", "blocks"])

    return run


def _subword_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, closes = np.zeros(2 * VOCABULARY, np.int64), closing(path)
        for batch in batches:
            if not len(batch):
                continue
            ids, sizes = _subwords(batch["ids"])
            inside = np.zeros(len(ids), bool)
            inside[1:] = ~closes[ids[:-1]]
            inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
            # Sums of less than 2 ** 53, so whole numbers in floats too.
            total += np.bincount(ids + VOCABULARY * inside, np.repeat(batch["c"].to_numpy(), sizes), 2 * VOCABULARY).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return run


def _streams_of_block(n_tokens: int, n_words: int, end_count: int):
    """Word counts, base score and subword ids of each document."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        words, slabs = coded_words(docs["text"])
        row_of = pc.index_in(words, value_set=counts["word"].combine_chunks()).to_numpy(zero_copy_only=False)
        count_of = counts["c"].to_numpy()[row_of]
        ids_of = pa.chunked_array([counts["ids"].combine_chunks().take(pa.array(row_of))], pa.binary()).combine_chunks()
        rare = np.log10(n_tokens + 1.0 * (n_words + 1))
        end, share_of, known_of = np.log10(end_count + 1.0) - rare, np.log10(count_of + 1.0) - rare, count_of > 0
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "ids")}
        for k, (codes, owners) in enumerate(slabs):
            n = min(SLAB, len(docs) - k * SLAB)
            sizes = np.bincount(owners, minlength=n)
            out["n_tokens"].append(pa.array(sizes + 1))
            out["n_known"].append(pa.array(np.bincount(owners[known_of[codes]], minlength=n) + (end_count > 0)))
            out["base_score"].append(pa.array(np.bincount(owners, share_of[codes], n) + end))
            ids = ids_of.take(pa.array(codes))
            edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            edges = np.ascontiguousarray(edges[np.append(0, np.cumsum(sizes))])
            out["ids"].append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), ids.buffers()[2]]))
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "ids": pa.binary()}
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "learned": docs["learned"],
            **{k: pa.chunked_array(v, kinds[k]) for k, v in out.items()}})

    return run


def _read(ids: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(i, "<u2").astype(np.int64) for i in ids]


def _transition_counts(column: np.ndarray):
    """The transitions of a partition, and under key -1 its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros(VOCABULARY * (SINGLE_CLASSES + 1), np.int64), 0
        for batch in batches:
            if len(batch):
                streams = _read(batch["ids"].to_pylist())
                total += transitions(streams, column).ravel()
                windows += sum(max(1, -(-(len(s) + 1) // WINDOW)) for s in streams)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[some], windows))], ["key", "n"])

    return run


def _rows(weights: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of WIDTH numbers, the embeddings first."""
    return np.concatenate([w.reshape(-1, WIDTH) for w in weights.values()])


def _train_task(model, passes: int, turn: int, span: tuple[float, float]):
    """Trains on the streams of a task; gives the rows of the weights that it met and how often."""
    def run(table: pa.Table) -> pa.Table:
        task = table["task"][0].as_py()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("ids", "ascending")]))
        start = model.value
        own = AttentionLm({k: w.copy() for k, w in start.weights.items()}, start.classes, start.share, start.closes)
        windows, met = train(own, _read(table["ids"].to_pylist()), passes, (11, turn, task), span)
        rows = _rows(own.weights)
        n = np.full(len(rows), windows, np.int64)
        n[:VOCABULARY] = met
        some = np.flatnonzero(n)
        return pa.table({
            "task": pa.array(np.full(len(some), task), pa.int32()), "row": pa.array(some, pa.int32()), "n": pa.array(n[some]),
            "v": pa.array([r.tobytes() for r in rows[some]], pa.binary())})

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of each row over the tasks that met it, weighted by how often."""
    row, n = table["row"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((table["task"].to_numpy(), row))
    v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    total = np.add.reduceat(v[order] * n[order, None], first) / np.add.reduceat(n[order], first)[:, None]
    return pa.table({
        "row": pa.array(row[order][first], pa.int32()),
        "v": pa.array([r.tobytes() for r in total.astype(np.float32)], pa.binary())})


def _trained(learned: DataFrame, model: AttentionLm, windows: int, sample: int) -> AttentionLm:
    """The model after every window of all training documents has been passed, `sample` windows at least."""
    spark = learned.sparkSession
    tasks = min(blocks(spark), max(1, windows // WINDOWS_A_TASK))
    rounds, passes = ROUNDS if tasks > 1 else 1, max(1, -(-sample // windows))
    dealt = learned.select(
        "doc_id", "ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(tasks)).cast("int").alias("task"),
        F.pmod(F.xxhash64("ids", "doc_id"), F.lit(rounds)).cast("int").alias("turn"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        parts = dealt.where(F.col("turn") == turn).groupBy("task").applyInArrow(
            _train_task(shared, passes, turn, (turn / rounds, (turn + 1) / rounds)), "task int, row int, n bigint, v binary")
        mean = parts.groupBy(F.pmod("row", F.lit(blocks(spark)))).applyInArrow(_average, "row int, v binary").toArrow()
        rows = _rows(model.weights)
        if len(mean):
            rows[mean["row"].to_numpy()] = np.frombuffer(b"".join(mean["v"].to_pylist()), np.float32).reshape(-1, WIDTH)
        ends = np.cumsum([w.size // WIDTH for w in model.weights.values()])[:-1]
        fresh = {k: r.reshape(model.weights[k].shape) for k, r in zip(model.weights, np.split(rows, ends), strict=True)}
        model = AttentionLm(fresh, model.classes, model.share, model.closes)
    return model


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[float] = []
            for k in range(0, len(batch), 256):
                found += model.value.score(_read(batch["ids"].slice(k, 256).to_pylist())).tolist()
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, tokenizer_path: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out. A null, empty or blank text is its end alone.
    Rows without doc_id are scored but not learned from; repeated rows count each. All other rows are trained on,
    whatever their number and length; `sample` is the number of windows that training passes at least. If nothing can be
    learned from, counts are 0. An empty table gives an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    fold = crc_text("doc_id") % FOLDS
    dealt = doc_texts(docs).select(
        "doc_id", "text", F.coalesce(fold == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        F.coalesce(fold != HELD_OUT_FOLD, F.lit(False)).alias("learned"),
        F.pmod(F.hash("doc_id"), F.lit(blocks(spark))).alias("block"))
    words = dealt.select("text", "learned", "block").groupBy("block").applyInArrow(
        _block_words, "word binary, block int, n bigint")
    counted = stage(words.repartition(blocks(spark), "word").mapInArrow(
        _count_and_spell(tokenizer_path), "word binary, c bigint, ids binary, blocks array<int>"), "word-counts")
    ends = dealt.where("learned").count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    counts = np.zeros(2 * VOCABULARY, np.int64)
    per_id = counted.where("c > 0").select("ids", "c").mapInArrow(
        _subword_counts(tokenizer_path), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    for row in per_id.collect():  # two rows at most per subword of the vocabulary
        counts[row["id"]] = row["n"]
    counts[END] += ends
    streams = stage(
        dealt.groupBy("block").cogroup(counted.select("word", "c", "ids", F.explode("blocks").alias("block")).groupBy("block")).applyInArrow(
            _streams_of_block(total, distinct, ends),
            "doc_id bigint, held_out boolean, learned boolean, n_tokens bigint, n_known bigint, base_score double, ids binary"),
        "streams")
    placed, learned = counts.reshape(2, VOCABULARY), streams.where("learned").select("doc_id", "ids")
    # As many rows at most as the vocabulary has subwords, times the columns.
    moves = learned.mapInArrow(_transition_counts(frequent_columns(placed.sum(0))), "key bigint, n bigint").groupBy(
        "key").agg(F.sum("n").alias("n")).toArrow()
    key, n = moves["key"].to_numpy(), moves["n"].to_numpy()
    follows, windows = np.zeros(VOCABULARY * (SINGLE_CLASSES + 1), np.int64), int(n[key < 0].sum())
    follows[key[key >= 0]] = n[key >= 0]
    fresh = drawn(follows.reshape(VOCABULARY, -1), placed, closing(tokenizer_path))
    model = spark.sparkContext.broadcast(_trained(learned, fresh, windows, sample) if windows else fresh)
    scored = streams.mapInArrow(
        _score_rows(model),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
