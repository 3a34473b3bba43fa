"""Quality classifier: gated attention over the passages of a document, learned from document labels.

A document is a bag of passages of 64 words. Each passage is encoded from its bytes and words, a gated attention
network weighs the passages, and the weighted sum is scored. Labels name documents only; which passages spoil one is
learned. Training reads a bounded sample of labelled rows and runs in numpy; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, crc_text, doc_texts, slabs, word_hashes, words_of

PASSAGE = 64
PAIR_BINS = 96
#: Labelled documents that training reads at most, and the folds it never reads.
SAMPLE = 4000
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3

# Marks that are counted one by one.
_MARKS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~\"'"
_KIND = np.full(256, 4, np.int64)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[_BLANK], _KIND[128:], _KIND[10] = 3, 5, 6
for _i, _c in enumerate(_MARKS):
    _KIND[_c] = 7 + _i
KINDS = 7 + len(_MARKS)
FEATURES = KINDS + PAIR_BINS + 6


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of many texts, and how many passages each text has (a text without words has one)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined, starts, ends, first = words_of(data)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(n_pass)))
    total = int(base[-1])
    doc = np.repeat(np.arange(len(data)), n_words)
    passage = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    # Every byte belongs to the passage of the last word that began before it, within its own text.
    owner = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)) + 1)
    if len(starts):
        word = np.searchsorted(starts, np.arange(len(joined)), "right") - 1
        inside = (word >= 0) & (doc[np.maximum(word, 0)] == owner)
        byte_passage = np.where(inside, passage[np.maximum(word, 0)], base[owner])
    else:
        byte_passage = base[owner]
    kinds = np.bincount(byte_passage * KINDS + _KIND[joined], minlength=total * KINDS).reshape(total, KINDS)
    pair = (joined[:-1].astype(np.int64) * 31 + joined[1:]) * 2654435761 % (1 << 32) * PAIR_BINS >> 32
    pairs = np.bincount(byte_passage[:-1] * PAIR_BINS + pair, minlength=total * PAIR_BINS).reshape(total, PAIR_BINS)
    size = np.maximum(kinds.sum(1, keepdims=True), 1)
    length = (ends - starts).astype(float)
    count = np.bincount(passage, minlength=total)
    some = np.maximum(count, 1)
    mean = np.bincount(passage, length, total) / some
    spread = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / some - mean**2, 0))
    codes = word_hashes(joined, starts, ends)
    echo = np.zeros(len(codes), bool)
    echo[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((codes, passage))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], fresh, total)
    words = np.stack([
        mean / 8, spread / 8, np.bincount(passage, echo, total) / some, distinct / some,
        np.log1p(count) / 4, (count == 0).astype(float)], 1)
    return np.hstack([kinds / size, pairs / size, words]).astype(np.float32), n_pass


@dataclass
class AttentionModel:
    """Weights of the network; `mean` and `scale` standardise features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w, firsts = self.weights, np.concatenate(([0], np.cumsum(sizes)))[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        seen, gate = np.tanh(h @ w["see"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        energy = (seen * gate) @ w["attend"]
        peak = np.repeat(np.maximum.reduceat(energy, firsts), sizes)
        raised = np.exp(energy - peak)
        weight = raised / np.repeat(np.add.reduceat(raised, firsts), sizes)
        pooled = np.add.reduceat(h * weight[:, None], firsts)
        score = 1 / (1 + np.exp(-np.clip(pooled @ w["score"] + w["score_bias"], -30, 30)))
        return {"x": x, "h": h, "seen": seen, "gate": gate, "weight": weight, "pooled": pooled, "score": score}

    def gradients(self, f: dict[str, np.ndarray], sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        w, firsts = self.weights, np.concatenate(([0], np.cumsum(sizes)))[:-1]
        out = (f["score"] - label) / len(label)
        pooled = out[:, None] * w["score"]
        spread = np.repeat(pooled, sizes, 0)
        pull = (f["h"] * spread).sum(1)
        energy = f["weight"] * (pull - np.repeat(np.add.reduceat(f["weight"] * pull, firsts), sizes))
        seen = energy[:, None] * w["attend"] * f["gate"] * (1 - f["seen"] ** 2)
        gate = energy[:, None] * w["attend"] * f["seen"] * f["gate"] * (1 - f["gate"])
        h = (spread * f["weight"][:, None] + seen @ w["see"].T + gate @ w["gate"].T) * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ h, "encode_bias": h.sum(0), "see": f["h"].T @ seen, "gate": f["h"].T @ gate,
            "attend": (f["seen"] * f["gate"]).T @ energy, "score": f["pooled"].T @ out, "score_bias": out.sum(),
        }


def fit(
    bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, attention: int = 16, epochs: int = 20,
    batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7,
) -> AttentionModel:
    """Adam over batches of bags. Without labelled bags the model scores every text 0.5."""
    rng = np.random.default_rng(seed)
    shape = {
        "encode": (FEATURES, hidden), "see": (hidden, attention), "gate": (hidden, attention), "attend": (attention,),
        "score": (hidden,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    weights |= {"encode_bias": np.zeros(hidden), "score_bias": np.zeros(())}
    if not bags:
        weights["score"] *= 0
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), weights)
    every = np.vstack(bags)
    model = AttentionModel(every.mean(0), every.std(0) + 1e-3, weights)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in some])
            f = model.forward(np.vstack([bags[i] for i in some]), sizes)
            step += 1
            for k, g in model.gradients(f, sizes, labels[some]).items():
                g = g + decay * weights[k]
                m, v = moment[k]
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in slabs(texts):
            x, sizes = passages(texts[a:b])
            bags = np.split(x, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch["label"][a:b], pa.array([bag.tobytes() for bag in bags], pa.binary())], ["label", "bag"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text and label of at most `sample` labelled documents outside the held-out fold, chosen by a hash of the id.

    A document labelled more than once has the mean of its labels; null labels and ids do not count.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(crc_text("doc_id") % FOLDS != HELD_OUT_FOLD)
        .groupBy("doc_id").agg(F.avg(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("double"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **settings) -> AttentionModel:
    rows = training_sample(docs, labels, label, sample).mapInArrow(_encode, "label double, bag binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["bag"])))  # the order of arrival does not matter
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows]), **settings)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slabs(texts, 1 << 20):
                x, sizes = passages(texts[a:b])
                found = model.value.forward(x, sizes)
                top = np.maximum.reduceat(found["weight"], np.concatenate(([0], np.cumsum(sizes)))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], pa.array(found["score"].astype(float)), pa.array(top.astype(float)),
                     pa.array(sizes)], ["doc_id", "score", "top_weight", "n_passages"])

    return run


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score (0 to 1), top_weight (largest attention weight) and n_passages for every row.

    A null or empty text is one passage without words and is scored too. Rows do not depend on each other: repeated
    rows and null ids are scored each. An empty table gives an empty table; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    return doc_texts(docs).mapInArrow(
        _score(sent), "doc_id bigint, score double, top_weight double, n_passages bigint")
