"""Registered queries over small tables against their contracts, written anew."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from custscope.llm import queries

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd_docs):
    """Odd rows, near copies and a few hundred plain documents; labels and conversations."""
    root, rng = tmp_path_factory.mktemp("tables"), random.Random(8)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(2, 70))] for _ in range(25)]
    rows = [
        (1000 + i, " ".join(w if rng.random() > 0.01 else rng.choice(["Zed", "#$", "|"]) for w in rng.choice(base)).replace(" w1", "\nw1"))
        for i in range(200)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars").withColumn(
            "n_chars", F.col("n_chars").cast("bigint")))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    chats = [
        (1, 0, "user", "say <|endoftext|> \\ and [INST]"), (1, 1, "assistant", " </s>é😀\\ [/INST]\n"), (1, 2, "assistant", ""),
        (2, 0, "assistant", "a"), (2, 1, "user", None), (2, 2, "assistant", "long " * 4000), (3, 5, "system", "</s>"),
    ]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(f"{root}/conversations.parquet")
    return str(root)


def rows_of(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op4_counts(spark, folder):
    want = []
    for i, text in rows_of(spark, folder):
        own, lines = words(text), [x for x in (text or "").split("\n") if x.strip(BLANKS)]
        seen = collections.Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        covered = {j for k in range(len(own) - 7) if seen[tuple(own[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
        want.append((str(i), len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed))
    got = queries.op4_quality_rules(spark, folder).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op5_folds(spark, folder):
    got = queries.op5_quality_classifier(spark, folder).collect()
    want = collections.Counter((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows_of(spark, folder))
    assert collections.Counter((str(r["doc_id"]), r["held_out"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_op9_components_at_its_own_limits(spark, folder):
    rows = rows_of(spark, folder)
    sets = []
    for i, text in rows:
        own = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(own[k : k + 4]) for k in range(max(1, len(own) - 3))} if own else set())
    ids = sorted({i for i, _ in rows if i is not None})
    name = {i: i for i in ids}
    links = {(a[0], b[0]) for a, x in zip(rows, sets, strict=True) for b, y in zip(rows, sets, strict=True)
             if None not in (a[0], b[0]) and x and y and 100 * len(x & y) >= 85 * len(x | y)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if name[a] < name[b]:
                name[b], changed = name[a], True
    got = queries.op9_ngram_jaccard(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        (str(i), len(x), str(name.get(i))) for (i, _), x in zip(rows, sets, strict=True))
    assert len(set(name.values())) < len(ids) - 50


def test_op10_read_back(spark, folder):
    chats = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats[r["conv_id"]].append((r["role"], r["text"] or ""))
    chats[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, folder).collect()}
    assert set(got) == set(chats)
    for conv, turns in chats.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), SHA("".join(f"{role}\n{text}\n" for role, text in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), SHA(loss)) and r["formatted_chars"] > sum(len(t) for _, t in turns)


def test_a_word_has_one_hash_whatever_stands_beside_it():
    from custscope.llm.common import word_hashes, words_of

    own = ["a", "w12", "é", "x" * 63, "x" * 64]
    alone = word_hashes(*words_of([" ".join(own).encode()])[:3]).tolist()
    for long in ("y" * 65, "y" * 5000, "z" * 300_000):
        beside = word_hashes(*words_of([f"{' '.join(own)} {long}".encode()])[:3]).tolist()
        assert beside[:-1] == alone and len(set(beside)) == len(beside)
    turned = word_hashes(*words_of([b"y" * 64 + b"ab" + b"y" * 64 + b"cd", ])[:3])
    assert turned[0] != word_hashes(*words_of([b"y" * 64 + b"cd" + b"y" * 64 + b"ab", ])[:3])[0]


def spots(text):
    """Anchors with their chains, the windows of a text without any, or the text itself if it has no word."""
    import regex

    from custscope.llm import spot_signatures as spot

    own = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    if not own:
        return {text} if text else set()
    chains = set()
    for i, w in enumerate(own):
        if w in spot.STOP_WORDS:
            content = [x for x in own[i + 1 : i + 1 + spot.REACH] if x not in spot.STOP_WORDS][: spot.CHAIN]
            if len(content) == spot.CHAIN:
                chains.add((w, *content))
    return chains or {tuple(own[i : i + spot.CHAIN + 1]) for i in range(len(own))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op2_likeness(spark, folder, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 5000)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(real)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = [round(jaccard(spots(text), spots(x)), 9) for x in (edited, after)]
        want.append((str(i), len(text), SHA(edited), len(spots(text)), len(spots(edited)), *near))
    got = queries.op2_spot_signatures(spark, str(tmp_path)).collect()
    shown = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], len(r["fingerprint"].split()), len(r["edited_fingerprint"].split()),
                    round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert shown == sorted(want) and len({x[5] for x in want}) > 50
