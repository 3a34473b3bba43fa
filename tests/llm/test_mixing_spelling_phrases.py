import collections
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from custscope.llm import collocations, mixing, spelling

BLANKS = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


# ---- mixing ----


def water(sizes, weights, most):
    """Targets by sharing again and again, in exact arithmetic."""
    full, total = set(), sum(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in full)
        shares = sum(w for i, w in enumerate(weights) if i not in full)
        goal = [Fraction(most * s) if i in full else Fraction(left * w, shares) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, s in enumerate(sizes) if goal[i] > most * s}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1, 1, 97], [0, 5, 0, 9], [300, 1, 2, 40, 3, 3], [7]])
def test_targets_share_the_excess(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).orderBy("source").collect()
    want = water(sizes, [i % 3 + 1 for i in range(len(sizes))], 3)
    assert [r["target"] for r in got] == pytest.approx([float(x) for x in want])
    assert sum(want) == sum(sizes)


def test_mix_of_sources(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 3, 40, 400])), "hot" if i % 3 == 0 else rng.choice([None, "", "a", "ä", "Z", "tiny"]))
            for i in range(1500)]
    rows = [(i, t, "tiny" if i < 3 else s if s != "tiny" else "a") for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
        assert got[i]["size"] == len(words(t)) and got[i]["taken"] == got[i]["size"] * got[i]["copies"] <= 3 * got[i]["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    goal = dict(zip(order, water([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3), strict=True))
    for s in order:
        own = [got[i] for i, _, x in rows if x == s]
        assert own[0]["target"] == pytest.approx(float(goal[s])) and own[0]["source_size"] == sizes[s]
        taken = sum(r["taken"] for r in own)
        assert abs(taken - goal[s]) <= (0.02 * goal[s] if len(own) > 100 else max(r["size"] for r in own))
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {i: r["taken"] for i, r in got.items()}
    full = mixing.mixed_rows(docs)
    assert full.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in full.groupBy("doc_id").count().collect()}
    assert copies == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = mixing.mix(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), len(words(r["text"]))) for r in rows)
    total = sum(len(words(r["text"])) for r in rows)
    assert all(r["target"] == r["source_size"] == total and r["taken"] == r["size"] for r in got)  # one source: all, once
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


# ---- spelling ----


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def spelled(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    known = {w: n for w, n in counts.items() if n >= 3}
    letters, form, out = {c for w in known for c in w}, {}, {}
    near = {w: {e for e in edits(w, letters) if e in known and e != w} for w in known}
    for w, others in near.items():
        best = min(others, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), known.get(form[w]))
    return out


@pytest.mark.parametrize("tile", [spelling.TILE, 12])
def test_spelling_variants(spark, tile):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdéÿ÷") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["x" * 3000, "aaaaa", "aaaaaa"]
    def typo(w):
        return rng.choice([w, w, w, *itertools.islice(edits(w, "abÉz"), rng.randrange(20) * (len(w) < 50), None, 7)][: 8])
    rows = [(i, " ".join(rng.choice([typo(w), w.upper(), w]) + rng.choice([" ", ", 7", "-"]) for w in rng.choices(base, k=60))) for i in range(150)]
    rows += [(200 + i, "chainaa " * 3 + "chainab " * 8 + "chainabc " * 20 + "chainabcd " * 60) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, tile=tile).collect()}
    want = spelled(rows)
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 50 and any(x[0] != x[1] for x in want.values() if x[0])


def test_one_edit():
    code = lambda w: np.array([[ord(c) for c in w]])
    for a in map("".join, itertools.product("ab", repeat=4)):
        for b in map("".join, itertools.chain(itertools.product("ab", repeat=4), itertools.product("ab", repeat=5))):
            assert spelling.one_edit(code(a), code(b))[0] == (b in set(edits(a, "ab")) - {a})


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    got = {r["word"]: r["n"] for r in spelling.variants(odd_docs).collect()}
    assert got == {w: x[2] for w, x in spelled([(r["doc_id"], r["text"]) for r in odd_docs.collect()]).items()}
    assert spelling.variants(no_docs).count() == 0
    long = spark.createDataFrame([(1, f"{'ab' * 30_000} {'ab' * 30_000}c " * 3)], "doc_id bigint, text string")
    assert [r["n_near"] for r in spelling.variants(long).collect()] == [1, 1]


# ---- phrases ----


def mined(rows, least, top):
    """lang -> [(phrase, a, l, r, n, score)] by definition."""
    out, langs = {}, collections.defaultdict(list)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(AZ)):
            langs[lang or "und"].append([w for w in re.split("[ \t]+", piece) if w])
    for lang, pieces in langs.items():
        f = collections.Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, 5) for i in range(len(p) - m + 1))
        n, some = sum(c for p, c in f.items() if len(p) == 1), {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = collections.Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows_ = []
        for p, a in some.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longest[p] < 80 * a:
                rows_.append((" ".join(p), a, l, r, n, score))
        out[lang] = sorted(rows_, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("lang", "rank").collect():
        out[r["lang"]].append((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
        assert r["rank"] == len(out[r["lang"]])
    return dict(out)


@pytest.mark.parametrize("hot, bucket_words", [(collocations.HOT, collocations.BUCKET_WORDS), (300, 500), (0, 700)])
def test_phrases(spark, monkeypatch, hot, bucket_words):
    rng = random.Random(2)
    vocab = ["the", "of", "The", "x", "é", "Éa", " ", "#", *[f"w{i}" for i in range(30)]]
    def text():
        kept = rng.choices(vocab, [30, 20, 10, 5, 5, 5, 2, 2, *[1] * 30], k=60)
        return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in kept) + "one two three four " * rng.randint(0, 2)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "SMALL", 64)
    got = found(collocations.collocations(docs, least=5, top=40, hot=hot, bucket_words=bucket_words))
    assert got == mined(rows, 5, 40) and min(map(len, got.values())) == 40


def test_quicksort_against_counting(monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", 70)
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 9, (4000, 4)) * (np.arange(4) < rng.integers(2, 5, 4000)[:, None])
    counts, hot = rng.integers(1, 4, 4000), np.arange(9) < 3
    want = collections.Counter()
    for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
        for m in range(2, 5):
            if row[m - 1]:
                want[tuple(row[:m])] += n
    got = {p: (n, whole) for p, n, whole in collocations.quicksort_phrases(rows, counts, hot, 10)}
    assert got == {p: (n, w) for p, n in want.items() if (w := not all(hot[list(p)])) is False or n >= 10}


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    got = found(collocations.collocations(odd_docs, least=2, top=50))
    assert got == mined(rows, 2, 50) and got["und"]
    assert collocations.collocations(no_docs).count() == 0


def test_scores_pass_64_bits(spark):
    """a * 2,000,000 has no room in 64 bits once a phrase occurs 10^13 times."""
    big = spark.range(1).select(F.lit(9 * 10**15).alias("a"), F.lit(10**16).alias("l"), F.lit(10**16).alias("r"))
    assert big.select(collocations.score_of("a", "l", "r").alias("s")).first()["s"] == 900_000


def test_components_of_links_in_parts(spark):
    from custscope.llm.components import components, extended

    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    frame = lambda some: spark.createDataFrame(some, "a bigint, b bigint")
    roots = components(frame(links[:80]))
    for part in (links[80:150], links[150:150], links[150:]):
        roots = extended(roots, frame(part))
    whole = {r["node"]: r["root"] for r in components(frame(links)).collect()}
    assert {r["node"]: r["root"] for r in roots.collect()} == whole and len(set(whole.values())) > 5
