import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from custscope.llm import (
    attention_lm, byte_bpe, chat_format, line_dedup, ngram_join, packing, pii, quality_model, quality_rules,
    spot_signatures,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_minimal_perfect_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    sizes, bits = line_dedup.build_mph(keys)
    slots = line_dedup.Mph(sizes, bits).find(keys)
    assert sorted(slots.tolist()) == list(range(5000))


def test_lines(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    held = collections.defaultdict(list)
    key = lambda line: line.strip(BLANKS).lower()  # noqa: E731  the texts are ASCII
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} if doc_id is not None else ():
            held[k].append(doc_id)
    gone = lambda i, x: i is not None and len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    want = sorted((str(i), len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_lines"], r["kept_text"]) for r in line_dedup.dedup_lines(odd_docs).collect())
    assert got == want
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_signatures(odd_docs, no_docs):
    got = spot_signatures.fingerprints(odd_docs).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (doc_id, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        want.append((str(doc_id), text[: len(text) - half] + after[:half]))
    assert sorted((str(r["doc_id"]), r["edited"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = [tuple(r["signs"]) for r in got if r["doc_id"] in (6, 7)]
    assert len(same) == 3 and len(set(same)) == 1
    assert spot_signatures.fingerprints(no_docs).count() == 0


def test_signature_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > 0.02 else "new" for w in rng.choice(base)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    signs = {}
    for r in docs.select("doc_id", spot_signatures.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect():
        signs.setdefault(frozenset(r["s"]), r["doc_id"])
    ids = [(i, s) for s, i in signs.items()]
    want = {(min(a, b), max(a, b)) for a, x in ids for b, y in ids if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert {(r["a"], r["b"]) for r in spot_signatures.similar_pairs(docs).collect()} == want and want


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs, WORDS, capacity=256, keep_ids=True).collect()
    loaded = Tokenizer.from_file(WORDS)
    loaded.encode_special_tokens = True
    want = [(r["doc_id"], loaded.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()]
    parts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["piece"]):
        parts[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert all(parts[i] == ids * (1 + (i == 7)) for i, ids in want)
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(no_docs, WORDS).count() == 0


def test_plan_uses_every_piece_and_fills_well():
    counts = np.bincount(np.random.default_rng(3).integers(1, 101, 5000), minlength=101)
    patterns = packing.plan(counts, 100)
    used = sum((np.bincount(lengths, minlength=101) * times for lengths, times in patterns), np.zeros(101, int))
    assert (used == counts).all() and all(sum(lengths) <= 100 for lengths, _ in patterns)
    assert sum(t for _, t in patterns) <= 1.01 * (counts * np.arange(101)).sum() / 100 + 1


def test_two_replace_the_smallest():
    # Greedy takes 6 + 3 and leaves 1; 3 gives way to 2 + 2.
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert sorted(packing.plan(counts, 10)[0][0]) == [2, 2, 6]


def test_quality_counts(odd_docs, no_docs):
    for r in quality_rules.judge(odd_docs).collect():
        own = words(r["text"])
        seen = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        covered = {j for i in range(len(own) - 7) if seen[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(own), sum(map(len, own)), len(covered))
        assert r["base_failed"] == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(no_docs).count() == 0


def test_the_verdict_as_one_expression(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    judged = quality_rules.judge(docs).withColumn("own", quality_rules.keeps(F.col("text"))).collect()
    assert all(r["own"] == r["kept"] for r in judged) and {r["kept"] for r in judged} == {True, False}
    plan = docs.where(quality_rules.keeps(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\x20\\x09-\\x0D]+") == plan.count("Filter") == 2  # once for each side of the union


def test_quality_model_learns_held_out_labels(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.train(docs, labels)
    held = labels.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0)
    rows = quality_model.score(docs, model).join(held, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in quality_model.score(odd_docs, model).collect())
    assert quality_model.score(no_docs, model).count() == 0


def test_quality_model_gradients():
    rng = np.random.default_rng(2)
    bags = [rng.random((n, quality_model.FEATURES)).astype(np.float64) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = quality_model.fit(bags, labels, epochs=1)
    x, sizes = np.vstack(bags), np.array([1, 3, 2])

    def loss():
        p = model.forward(x, sizes)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = model.gradients(model.forward(x, sizes), sizes, labels)
    for name in ("encode", "see", "gate", "attend", "score"):
        at = np.unravel_index(1, model.weights[name].shape)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-5
        up = loss()
        model.weights[name][at] = old - 1e-5
        assert found[name][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-7)
        model.weights[name][at] = old


def test_feistel_is_a_permutation():
    feistel = pii.Feistel(b"key")
    for n in (1, 2, 7, 97, 1000):
        assert sorted(feistel.permute(i, n, "t") for i in range(n)) == list(range(n))


def test_pseudonyms_keep_formats_and_links():
    feistel = pii.Feistel(b"key")
    run = lambda t: pii.pseudonymise(t, feistel)
    text, found = run("card 4532015112830366, not 4532015112830367")
    fresh = text.split()[1].rstrip(",")
    assert len(found) == 1 and fresh != "4532015112830366" and pii.luhn_digit(fresh[:-1]) == fresh[-1]
    assert text.endswith("4532015112830367")
    assert [k for k, _, _ in run("DE89 3704 0044 0532 0130 00 or 1999-12-31 or 31.02.1999 or 10.0.0.256")[1]] == ["iban", "day"]
    assert run("a.b@mail7.example.com x")[0].split()[0] == run("y a.b@mail7.example.com")[0].split()[1]
    mixed, kinds = run('+1 (974) 555-3436 190.137.223.204 TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!')
    assert [k for k, _, _ in kinds] == ["phone", "address", "secret"]
    assert re.fullmatch(r'\+1 \(\d{3}\) \d{3}-\d{4} [\d.]+ TOKEN = "[0-9A-F]{40}"!!', mixed)


@pytest.mark.parametrize(("kind", "value"), [
    *[("phone", v) for v in (
        "+44 7911 123456", "+49 170 1234567", "+33 612345678", "(212) 555-0187", "212-555-0187", "+14155550123", "+1 (415) 555-0123",
        "+351 912 345 678", "+4915112345678", "030 12345678", "(030) 1234567", "01 42 68 53 00", "+34 912-345-678")],
    *[("iban", v) for v in ("ES91 2100 0418 4502 0005 1332", "DE89370400440532013000", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19")],
    *[("day", v) for v in ("2024-03-05", "2024/03/05", "05/03/2024", "05.03.2024", "1999-12-31")],
])
def test_pseudonyms_find_valid_values(kind, value):
    feistel = pii.Feistel(b"key")
    for before, after in (("", ""), ("call ", " BIC CAIX"), ("(", ")."), ("x: ", " 2024 and"), *([("at ", "T10:15:00Z")] if value[4] == "-" and kind == "day" else [])):
        if kind == "phone" and value[0] != "+" and after == " 2024 and":
            continue  # a group of digits behind a blank belongs to the number
        text, found = pii.pseudonymise(before + value + after, feistel)
        assert found == [(kind, len(before), len(before) + len(value))]
        assert text.startswith(before) and text.endswith(after) and value not in text


def test_phones_link_in_all_spellings():
    feistel = pii.Feistel(b"key")
    same = [pii.pseudonymise(t, feistel)[0] for t in ("+14155550123", "+1 (415) 555-0123", "+1 415 555 0123")]
    assert len({re.sub(r"\D", "", t) for t in same}) == 1 and same[0].startswith("+1")
    assert pii.pseudonymise("+1234", feistel)[1] == [] and pii.pseudonymise("version 1.2.3 of 10 and 20", feistel)[1] == []


@pytest.mark.parametrize(("kind", "value"), [
    *[("email", v) for v in ("иван@почта.рф", "ş@ğ.tr", "łukasz@żółć.pl", "νίκος@παράδειγμα.gr", "a@b.c", "名前@例え.jp")],
    *[("address", v) for v in ("2001:db8::8a2e:370:7334", "2001:0DB8:85A3:0:0:8A2E:370:7334", "190.137.223.204")],
    ("iban", "de89370400440532013000"), ("phone", "+٤٩ ١٧٠ ١٢٣٤٥٦٧"), ("day", "٢٠٢٤-٠٣-٠٥"), ("card", "٤٥٣٢٠١٥١١٢٨٣٠٣٦٦"),
])
def test_pseudonyms_change_whatever_they_report(kind, value):
    """Every letter and digit but those of the last label, the country and the check digits may change; the value as a whole does."""
    for key in (b"key", b"other", b"3"):
        text, found = pii.pseudonymise(f"see {value} here", pii.Feistel(key))
        assert [k for k, _, _ in found] == [kind] and value not in text and text.startswith("see ") and text.endswith(" here")
        if kind == "email":
            parts, fresh = re.split("[@.]", value), re.split("[@.]", text[4:-5])
            assert len(parts) == len(fresh) and parts[-1] == fresh[-1]
            assert all(a != b and len(a) == len(b) for a, b in zip(parts[:-1], fresh[:-1], strict=True))
        if value[-1] in "٤٥٦٧":
            assert not re.search("[0-9]", text)
    ascii_ = pii.pseudonymise("+49 170 1234567", pii.Feistel(b"key"))[0]
    assert pii._ascii_digits(pii.pseudonymise("+٤٩ ١٧٠ ١٢٣٤٥٦٧", pii.Feistel(b"key"))[0])[0] == ascii_


@pytest.mark.parametrize("text", [
    "release 01.02.03", "chapter 01 02 03", "room 0123 4567", "total 0800 1200 5000", "at 12:34:56 or 1:2:3", "std::vector a::b", "::1",
    "section 02.10.11", "order 0123 4567 8901", "x = 3.14159, y = 100000"])
def test_other_numbers_are_left_alone(text):
    assert pii.pseudonymise(text, pii.Feistel(b"key")) == (text, [])


def test_small_formats_have_no_fixed_points():
    feistel = pii.Feistel(b"key")
    for n in (2, 3, 26, 1000):
        found = [feistel.permute(i, n, "t") for i in range(n)]
        assert sorted(found) == list(range(n)) and all(i != x for i, x in enumerate(found))


def test_values_stay_linked_across_a_table_and_none_is_left(spark):
    values = ["4532015112830366", "DE89 3704 0044 0532 0130 00", "+1 (974) 555-3436", "a.b@mail7.example.com", "иван@почта.рф",
              "190.137.223.204", "1999-12-31", "123-45-6789", "2001:db8::8a2e:370:7334"]
    rows = [(i, f"Text {chr(65 + i % 26)} of its own. " + " and ".join(values[i % 3 :: 3]) + " end") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    done = {r["doc_id"]: r for r in pii.pseudonyms(docs, b"key").collect()}
    fresh = {}
    for i, text in rows:
        got = done[i]["text"]
        assert len(done[i]["pii"]) == 3 and not any(v in got for v in values)
        assert got[:16] == text[:16] and got.endswith(" end")
        fresh.setdefault(i % 3, set()).add(got[16:])
    assert all(len(x) == 1 for x in fresh.values())  # equal values, equal pseudonyms, in twenty documents each
    other = pii.pseudonyms(docs, b"another").where("doc_id = 0").first()["text"]
    assert other != done[0]["text"]


def test_pseudonyms_of_odd_rows(odd_docs, no_docs):
    before = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    done = pii.pseudonyms(odd_docs, b"key")
    assert {(r["doc_id"], r["text"]) for r in done.collect()} == before
    assert done.columns == [*odd_docs.columns, "pii"] and pii.pseudonyms(no_docs, b"key").count() == 0


def test_lm_counts_and_probabilities(odd_docs, no_docs):
    import zlib

    got = attention_lm.score(odd_docs, WORDS, sample=20).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in odd_docs.collect()]
    counted = collections.Counter()
    for doc_id, own in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counted.update([*own, "end"])
    total, distinct = sum(counted.values()), len(counted)
    want = []
    for doc_id, own in rows:
        c = np.array([counted[w] for w in [*own, "end"]])
        want.append((str(doc_id), len(c), int((c > 0).sum()), round(float(np.log10((c + 1) / (total + distinct + 1)).sum()), 4)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and r["train_tokens"] == total for r in got)
    assert attention_lm.score(no_docs, WORDS).count() == 0


def test_lm_sums_to_one_and_sees_no_future():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 300, 200) for _ in range(4)]
    placed = np.ones((2, attention_lm.VOCABULARY))
    model = attention_lm.fit(streams, placed, attention_lm.closing(WORDS), steps=5)
    f = model.forward(np.array([[attention_lm.BEGIN, 5, 9]]))
    p = (f["p"] / f["total"])[0, 2]
    inside = int(~model.closes[9])
    assert (p[model.classes] * 10 ** model.share[inside]).sum() == pytest.approx(1, abs=1e-3)
    other = model.forward(np.array([[attention_lm.BEGIN, 5, 200]]))
    assert np.allclose((other["p"] / other["total"])[0, :2], (f["p"] / f["total"])[0, :2], atol=1e-6)
    both = model.score([streams[0], streams[1]])
    assert both[0] == pytest.approx(model.score([streams[0]])[0], rel=1e-5)


def test_lm_predicts_later_windows_from_half_a_window():
    rng = np.random.default_rng(6)
    streams = [rng.integers(0, 300, n) for n in (5, 31, 32, 33, 47, 48, 49, 150)]
    model = attention_lm.fit(streams, np.ones((2, attention_lm.VOCABULARY)), attention_lm.closing(WORDS), steps=5)
    window, half = attention_lm.WINDOW, attention_lm.WINDOW // 2
    for stream, got in zip(streams, model.score(streams), strict=True):
        full, want = np.concatenate(([attention_lm.BEGIN], stream, [attention_lm.END])), 0.0
        for at in range(1, len(full)):
            start = 0 if at <= window else half * ((at - window - 1) // half + 1)
            assert start == 0 or at - start > half
            f = model.forward(full[None, start:at])
            p = f["p"][0, -1, model.classes[full[at]]] / f["total"][0, -1, 0]
            want += np.log10(p) + model.share[int(~model.closes[full[at - 1]]), full[at]]
        assert got == pytest.approx(want, rel=1e-5)


def test_lm_trains_short_texts_and_their_ends():
    streams = [np.array(s) for s in ([700, 800, 900], [900, 800, 700], [5], [])] * 5
    placed = np.zeros((2, attention_lm.VOCABULARY))
    placed[0, [700, 800, 900, 5, attention_lm.END]] = 10, 10, 10, 5, 20
    model = attention_lm.fit(streams, placed, attention_lm.closing(WORDS), steps=300)
    good, bad = model.score([np.array([700, 800, 900]), np.array([700, 900, 800])])
    assert good > -1.2 and good > bad + 1


def test_lm_trains_all_documents(spark, monkeypatch):
    rng, texts = random.Random(8), ["river stone cloud", "seven green apples fall", "x", ""]
    rows = [(i, rng.choice(texts)) for i in range(2500)]
    # Ids of the one document in 2,500 with a subword of its own, learned from, and of two held-out ones.
    rows += [(2501, "glacier stone cloud"), (2502, "river stone cloud"), (2503, "cloud stone river")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = {}
    monkeypatch.setattr(attention_lm, "WINDOWS_A_TASK", 500)
    drawn, trained = attention_lm.drawn, attention_lm._trained

    def drawn_(table, *rest):
        seen["table"] = table
        return drawn(table, *rest)

    def trained_(learned, model, windows, sample):
        seen["learned"], seen["windows"] = learned.count(), windows
        return trained(learned, model, windows, sample)

    monkeypatch.setattr(attention_lm, "drawn", drawn_)
    monkeypatch.setattr(attention_lm, "_trained", trained_)
    got = {r["doc_id"]: r["score"] for r in attention_lm.score(docs, WORDS, sample=60_000).collect()}
    import zlib

    own = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    coded = attention_lm.spelled(WORDS, sorted({w for t in own for w in attention_lm.tokens(t)}))
    size = dict(zip(sorted({w for t in own for w in attention_lm.tokens(t)}), (len(c) // 2 for c in coded), strict=True))
    assert seen["learned"] == seen["windows"] == len(own)
    assert seen["table"].sum() == sum(1 + sum(size[w] for w in attention_lm.tokens(t)) for t in own)
    assert got[2502] > got[2503] + 2


def test_byte_bpe_against_the_library(odd_docs, no_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, letters = random.Random(1), "aZé'sstdmrevl  \n\t 　½12٣.,!中😀'll're"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["", "'", " '", "'s's", "x" * 900 + " " * 700 + "\n"]
    vocab = byte_bpe.vocabulary(BYTES)
    for text, pieces in zip(texts, byte_bpe.split_texts(texts), strict=True):
        assert np.frombuffer(vocab.ids(pieces), np.int32).tolist() == library.encode_ordinary(text)
    encoded = byte_bpe.encode(odd_docs, BYTES)
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in byte_bpe.decode(encoded, BYTES).collect()) == want
    assert byte_bpe.round_trip(no_docs, BYTES).count() == 0


def test_similar_documents_against_all_pairs(spark, odd_docs, no_docs):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        own = [w if rng.random() > 0.012 else "Zed" for w in rng.choice(base)]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    sets = []
    for r in docs.collect():
        own = words((r["text"] or "").lower())
        sets.append((r["doc_id"], {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()))
    name = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and name[a] < name[b] and 100 * len(x & y) >= 80 * len(x | y):
                    name[b], changed = name[a], True
    want = sorted((str(i), len(x), str(name.get(i))) for i, x in sets)
    got = ngram_join.similar_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert ngram_join.similar_documents(no_docs).count() == 0


def test_chats(spark):
    rows = [
        (1, 0, "user", "say <|endoftext|> \\ and \\\\"), (1, 1, "assistant", " <|endoftext|>é😀\\ [INST]\n"), (1, 2, "assistant", ""),
        (2, None, None, None), (2, 3, "assistant", "x"), (2, 3, "assistant", "x"), (None, 0, "assistant", "lost"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = chat_format.format_chats(turns, path)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    for conv in (1, 2, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert got[conv]["turns_text"] == "".join(f"{a}\n{b}\n" for a, b in own)
        assert got[conv]["loss_text"] == "".join(b for a, b in own if a == "assistant")
    assert chat_format.format_chats(turns.limit(0), path).count() == 0
    assert hashlib.sha256(got[1]["formatted"].encode()).digest()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.unionByName(source.limit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    docs, before = source, source.count()
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == source.columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    empty = source.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_rows_apart(spark, odd_docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    plain = [" ".join(f"w{rng.randint(0, 9000)}" for _ in range(60)) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [
        (100, plain[0], "en", "a", 0), (100, plain[1], "de", "b", 0), (101, near(plain[0]), "fr", "c", 0), (99, near(plain[1]), "es", "d", 0),
        (102, plain[2], "en", "e", 0), (102, plain[2], "en", "e", 0), (102, near(plain[2]), "de", "f", 0), (None, plain[3], "en", "g", 0),
        (None, plain[3], "en", "h", 0), (103, near(plain[3]), "en", "i", 0), (104, plain[4], "en", "j", 0), (104, plain[5], None, "k", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.unionByName(odd_docs.select(*docs.columns))
    shown = lambda df: sorted(map(str, ((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())))
    all_rows = [tuple(r) for r in docs.collect()]

    # Lines: each row with its own columns, by brute force.
    key = lambda line: line.strip(BLANKS).lower()
    held = collections.defaultdict(list)
    for i, t, *_ in all_rows:
        for k in {key(x) for x in (t or "").split("\n")} if i is not None else ():
            held[k].append(i)
    gone = lambda i, x: i is not None and len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    want = []
    for i, t, lang, source, _ in all_rows:
        text = "\n".join(x for x in (t or "").split("\n") if not gone(i, x))
        if text.strip(BLANKS):
            want.append((i, text, lang, source, len(text)))
    assert shown(corpus_pipeline.lines(spark, docs, str(tmp_path))) == sorted(map(str, want))

    # Near copies: the least row of each group of rows, by brute force.
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words((r[1] or "").lower())) else set() for r in all_rows]
    group, changed = list(range(len(all_rows))), True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                linked = x and y and None not in (all_rows[a][0], all_rows[b][0]) and 100 * len(x & y) >= 80 * len(x | y)
                if linked and group[a] < group[b]:
                    group[b], changed = group[a], True
    ids = collections.defaultdict(list)
    for g, r in zip(group, all_rows, strict=True):
        ids[g].append(r)
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(min((r[0] is not None, r[0] or 0) for r in g)[1] if g[0][0] is not None else None) for g in ids.values())
    for r in kept:
        assert tuple(r) in all_rows
    assert {r["source"] for r in kept} >= {"a", "d", "g", "h", "i", "j", "k"} and not {"b", "c"} & {r["source"] for r in kept}


def test_document_ids_of_every_code_point():
    """Each assigned code point at the end of a word, before marks, before a combining mark and in random mixes."""
    import unicodedata

    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    ends = ("", "a", "!!", ".", ".́", "̇!", "#b")
    texts = [" ".join(f"a{c}{end} {c}{end}" for end in ends) for c in chars]
    rng = random.Random(6)
    odd = ["İ", "ß", "Σ", "ς", "̇", "́", "क़", "יִ", "̈́", "!", "#", "'s", " ", "a", "E", "1", "‍", "İ"]
    texts += ["".join(rng.choices(odd + rng.sample(chars, 3), k=12)) for _ in range(20_000)]
    texts += ["Kitap İKİ. Son", "aİ.", "İ!!"]
    loaded = Tokenizer.from_file(WORDS)
    loaded.encode_special_tokens = True
    want = loaded.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, w, g in zip(texts, want, packing.document_ids(WORDS, texts), strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids]
    assert wrong == []


def test_lm_passes_each_scored_place_once(monkeypatch):
    """Places that a window only adds as context are neither asked nor given classes."""
    rng, asked = np.random.default_rng(3), []
    streams = [rng.integers(0, 300, n) for n in (0, 5, 16, 200, 999)]
    model = attention_lm.fit(streams, np.ones((2, attention_lm.VOCABULARY)), attention_lm.closing(WORDS), steps=3)
    tanh = np.tanh
    monkeypatch.setattr(attention_lm.np, "tanh", lambda h, **k: (asked.append(len(h)), tanh(h, **k))[1])
    model.score(streams)
    half = attention_lm.WINDOW // 2
    assert sum(asked) == sum(-(-(len(s) + 1) // half) * half for s in streams)


def test_lm_gradients_follow_the_loss():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 300, 64) for _ in range(4)]
    model = attention_lm.fit(streams, np.ones((2, attention_lm.VOCABULARY)), attention_lm.closing(WORDS), steps=3)
    ids, target = rng.integers(0, 300, (4, 32)), rng.integers(0, 128, (4, 32))
    counts = np.arange(32) < np.array([[32], [7], [32], [1]])
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    plain = lambda: model.gradients(ids, target, counts)[0]
    _, grads, rows = model.gradients(ids, target, counts)
    assert list(rows) == sorted({*ids.ravel()})
    for name, weight in model.weights.items():
        at = (rows[3], 2) if name == "embed" else tuple(d // 2 for d in weight.shape)
        got = grads["embed"][3, 2] if name == "embed" else grads[name][at]
        before, step = weight[at], 1e-2
        weight[at] = before + step
        above = plain()
        weight[at] = before - step
        assert got == pytest.approx((above - plain()) / (2 * step), rel=0.02, abs=2e-4), name
        weight[at] = before


def test_lm_words_are_those_between_blanks():
    import pyarrow as pa

    texts = ["", " ", "a  B\tc\r\n\x0b\x0c d ", "\x1cx\x85y z  É Ça", "A\x1fb a", " " * 3 + "tail"] * 400
    words, slabs = attention_lm.coded_words(pa.chunked_array([texts[:7], texts[7:]], pa.string()))
    got = [[] for _ in texts]
    for k, (codes, owners) in enumerate(slabs):
        for code, owner in zip(codes, owners, strict=True):
            got[k * attention_lm.SLAB + owner].append(words[code].as_py())
    assert got == [attention_lm.tokens(t) for t in texts]


def test_lm_spells_plain_words_side_by_side(monkeypatch):
    """Only words that are no small letters with marks behind them go to the tokenizer; ids are the library's."""
    import pyarrow as pa

    rng, letters, asked = random.Random(12), "abcdefinorstzßàéñöøÿ", []
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) + "".join(rng.choices(".,!?;:*#$%&|", k=rng.choice((0, 0, 1, 3)))) for _ in range(3000)]
    plain = sorted({*texts, "...", "a" * 300})
    odd = ["it's", "a.b", "ab1", "\u00c9", "\u00f7", "a\u00aa", "\u00b5", "a-b.", "\u4e2d", "(a", "\u00e9.\u0301", "e\u0301", "x\u00b7", "<s>"]
    assert not any(attention_lm.tokens(w) != [w.encode()] for w in plain)
    loaded = Tokenizer.from_file(WORDS)
    loaded.encode_special_tokens = True
    want = [np.asarray(e.ids, "<u2").tobytes() for e in loaded.encode_batch_fast(plain + odd, add_special_tokens=False)]
    slow = attention_lm.ids_of_words
    monkeypatch.setattr(attention_lm, "ids_of_words", lambda path, words: (asked.extend(words), slow(path, words))[1])
    words = pa.array([b"?", *(w.encode() for w in plain + odd)], pa.binary())[1:]
    assert attention_lm.spelled_words(WORDS, words).to_pylist() == want
    assert set(asked) == set(odd)
    assert attention_lm.spelled_words(WORDS, words[:0]).to_pylist() == []
