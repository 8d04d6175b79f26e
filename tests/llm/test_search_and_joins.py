"""Ranked search, spelling variants and the MinHash join against brute force, with nulls, empties, ties, repeats and clashing columns."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import minhash, ranked, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: names that the operators use themselves
EXTRA = "a int, b int, id int, key int, n int, word string, root int, item int, score int, terms int"


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "w", 6, 7, 8, 9) for r in rows], f"{name} long, text string, {EXTRA}").repartition(4)


def words(rng, n, size=300):
    vocabulary = ["".join(rng.choice(list("abcdeéßœ"), rng.integers(2, 9))) for _ in range(size)]
    return lambda k: list(rng.choice(vocabulary, k, p=(w := 1 / np.arange(1, size + 1)) / w.sum()))


# ranked search


def ranking(docs, items):
    terms = [(i, Counter(re.findall(ALNUM, (t or "").translate(LOW)))) for i, t in docs]
    n_docs, total = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in terms:
            n = sum(c.values())
            score = 0
            for t, q in Counter(re.findall(ALNUM, (text or "").translate(LOW))).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:20])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [ranked.BLOCK, 40])
def test_ranked_search(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "_CELLS", 3000)  # several chunks in a task
    rng = np.random.default_rng(2)
    spell = words(rng, 0)
    docs = [(i, " ".join(spell(int(rng.integers(1, 90))))) for i in range(400)] + [(i, "same text") for i in range(500, 530)]
    docs += [(600, None), (601, ""), (602, "  \n"), (None, "same text"), (603, "SAME, Text!"), (5, "same text"), (604, " ".join(spell(20000)))]
    items = [(k, " ".join(spell(12))) for k in range(12)] + [(50, "same same text"), (51, None), (52, ""), (None, "text"), (53, "unseenword"), (54, "text"), (54, "text"), (54, docs[3][1])]
    got = ranked.search(frame(spark, docs), frame(spark, items, "item_id"))
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got.collect()), key=str) == ranking(docs, items)


def test_pair_bounds_hold_and_skip_more_than_single_maxima():
    rng = np.random.default_rng(4)
    n_docs, n_terms = 300, 30
    rare = rng.integers(2, 60, n_terms)
    block = ranked.Block([(7, list(range(n_terms)), [1 + t % 3 for t in range(n_terms)])], {t: int(rare[t]) for t in range(n_terms)}, n_docs, 6000)
    impact = np.where(rng.random((n_terms, n_docs)) < rare[:, None] / n_docs, rng.integers(1, 1000, (n_terms, n_docs)), 0)
    single, joint = impact.max(1), np.array([((impact[x] + impact[y]) * ((impact[x] > 0) & (impact[y] > 0))).max() for x, y in block.pairs])
    block.bounds(single, joint)
    own, times, below = block.own[0], block.times[0], block.below[0]
    for k in range(len(own) + 1):
        assert below[k] >= (times[:k, None] * impact[own[:k]]).sum(0).max(initial=0)
        assert below[k] <= (times[:k] * single[own[:k]]).sum()
    assert below[-1] < (times * single[own]).sum()


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [(1, "a")], "item_id")
    assert ranked.search(docs.limit(0), items).count() == ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(frame(spark, [(1, None)]), items).count() == 0


# spelling variants


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = next((k for k, (a, c) in enumerate(zip(x, y)) if a != c), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def grouped(counts):
    by = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        by[w] = (n, len(others), best[1] if best and -best[0] >= 2 * n else None)
    out = []
    for w, (n, k, form) in by.items():
        root = w
        while by[root][2] is not None:
            root = by[root][2]
        out.append((w, form, root, n, k, counts[form] if form else None))
    return sorted(out, key=str)


def test_variants_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    seeds = ["".join(rng.choice(list("abcéÿ"), rng.integers(5, 12))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "b" * 300]
    counts = {}
    for s in seeds:
        for _ in range(12):
            w = list(s)
            for _ in range(int(rng.integers(0, 3))):
                i = int(rng.integers(0, len(w)))
                w[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abcéÿ"), int(rng.integers(0, 2))))
            if len(w) >= 4:
                counts["".join(w)] = int(rng.choice([3, 6, 12, 24, 24, 50]))
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()), key=str) == grouped(counts)


def test_vocabulary(spark):
    text = "École étude naïve×straße NAÏVE über_uber Łódź foo1barbaz " * 40
    docs = [(i, text) for i in range(60)] + [(None, text), (None, None), (61, ""), (3, text), (62, "longest" * 3000)]
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    want = {w: n for w, n in counts.items() if n >= 3}
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame(spark, docs)).collect()} == want and len(want) > 6
    assert spelling.variants(spelling.vocabulary(frame(spark, docs).limit(0))).count() == 0


# MinHash join


def linked(docs):
    sets = []
    for _, t in docs:
        w = re.findall(SPACED, (t or "").translate(LOW))
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, s in enumerate(sets):
        for y in range(x):
            common = len(s & sets[y])
            if common and 100 * common >= 85 * len(s | sets[y]):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), c := least.get(find(x)), i == c) for x, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def test_minhash_join(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefé"), 5)) for _ in range(900)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    docs, passage = [], prose(50)
    for size, copies in ((150, 120), (60, 40), (300, 30)):  # families whose members lie within and beyond the limit
        base = prose(size)
        for _ in range(copies):
            own = list(base)
            for at in rng.choice(size, int(rng.integers(0, 5)) * size // 150 + int(rng.integers(0, 2)), replace=False):
                own[at] = str(rng.choice(vocabulary))
            docs.append(" ".join(own))
    docs += [" ".join(prose(12) + passage + prose(12)) for _ in range(80)]  # one passage in many, none alike
    docs += [docs[0].upper(), docs[0].replace(" ", "\n\t"), None, "", " \n", None, "one", "ONE", "one two", "a b c d", "a b c d", "a b c d e", "x " * 500, "x " * 700]
    order = rng.permutation(len(docs))
    rows = [(int(i), docs[k]) for i, k in enumerate(order)] + [(7, docs[order[7]]), (None, docs[0]), (None, "null alone here"), (3, "another text of id three")]
    got = minhash.near_duplicates(frame(spark, rows))
    have = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got.collect()), key=str)
    want = linked(rows)
    # kept compares nulls as equal
    assert have == sorted(((i, n, c, i == c) for i, n, c, _ in want), key=str)
    assert len({c for _, _, c, _ in want}) < 300
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    held = np.concatenate([np.sort(pool[:3700]), np.sort(pool[300:4000])])
    x, y = minhash.signatures(held, np.array([0, 3700, 7400]))
    assert abs((x == y).mean() - 3400 / 4000) < 0.15
    p, q = minhash.parities(held, np.array([0, 3700, 7400])).view(np.uint64)
    assert np.bitwise_count(p ^ q).sum() <= 600
