"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: the delimiter, the role, the delimiter, the text, and so on, one delimiter at the end.
The delimiter is a special token of the vocabulary, so no token crosses an edge of a turn. The rendered text is
encoded once with offsets, and the sorted spans of assistant texts are met with the sorted spans of tokens
by binary search. Control strings inside roles and texts are escaped with a backslash and can be read back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of this template and of other common ones.
DELIMITER = "<|endoftext|>"
CONTROLS = (DELIMITER, "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
_BEGINS_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ").", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: backslashes are doubled and each control string is broken after its first character."""
    return _BEGINS_CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = DELIMITER + escape(role) + DELIMITER, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body]
        at += len(head) + len(body)
    return "".join([*parts, DELIMITER]), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    fields = [unescape(x) for x in formatted.split(DELIMITER)[1:-1]]
    return list(zip(fields[::2], fields[1::2], strict=True))


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the spans; token spans and spans are both in order."""
    edge = np.zeros(len(starts) + 1, np.int32)
    a, b = np.asarray(spans, np.int64).reshape(-1, 2).T
    keep = b > a
    first, last = np.searchsorted(ends, a[keep], "right"), np.searchsorted(starts, b[keep], "left")
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, masked: np.ndarray) -> list[str]:
    """Texts under runs of masked tokens. Bytes of one character share its span, so spans are joined, not added."""
    at = np.flatnonzero(masked)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [
        formatted[starts[a] : ends[b]]
        for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)], strict=True)
    ]


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    loaded = Tokenizer.from_file(path)
    loaded.post_processor = processors.ByteLevel(trim_offsets=False)
    return loaded


_SCHEMA = (
    "conv_id bigint, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, "
    "loss array<boolean>"
)


def _format(path: str, trained_roles: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _tokenizer(path)
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 256):
                out: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "formatted", "ids", "starts", "ends", "loss")}
                chunk = [(r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]]) for r in rows[k : k + 256]]
                rendered = [render(turns) for _, turns in chunk]
                encoded = loaded.encode_batch([text for text, _ in rendered], add_special_tokens=False)
                for (conv_id, turns), (text, spans), enc in zip(chunk, rendered, encoded, strict=True):
                    starts, ends = np.asarray(enc.offsets, np.int32).reshape(-1, 2).T
                    trained = [s for s, (role, _) in zip(spans, turns, strict=True) if role in trained_roles]
                    for name, value in zip(out, (
                        conv_id, len(turns), text, enc.ids, starts, ends, mask(starts, ends, trained)), strict=True):
                        out[name].append(value)
                types = (pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return run


def format_chats(
    turns: DataFrame, tokenizer_path: str, trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, ids, token starts and ends (code points), loss.

    Turns go by turn number; equal or missing numbers by role and text, missing ones first. A null
    role or text is an empty one; repeated rows are turns of their own; rows without conv_id are one conversation
    without id. A conversation is held whole by one task. An empty table gives an empty table; other columns are
    left out.
    """
    whole = (
        turns.select(
            "conv_id", F.struct(
                F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            ).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )
    return whole.mapInArrow(_format(tokenizer_path, frozenset(trained_roles)), _SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, losses = [], []
        for text, starts, ends, loss in zip(*(batch[n] for n in ("formatted", "starts", "ends", "loss")), strict=True):
            text = text.as_py()
            turns.append("".join(f"{role}\n{said}\n" for role, said in parse(text)))
            under = masked_text(
                text, starts.values.to_numpy(), ends.values.to_numpy(),
                loss.values.to_numpy(zero_copy_only=False))
            losses.append("".join(map(unescape, under)))
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["n_turns"], batch["formatted"], pa.array(turns, pa.string()),
             pa.array(losses, pa.string())], ["conv_id", "n_turns", "formatted", "turns_text", "loss_text"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and the text under the loss mask, read from the formatted text, the token spans and the mask."""
    return formatted.mapInArrow(
        _read_back, "conv_id bigint, n_turns bigint, formatted string, turns_text string, loss_text string")
