"""Chat formatting and the factorisation machine against plain loops."""

import random
from itertools import combinations

import numpy as np
import pytest

from quantloom.llm import factorisation, preference


def plain_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    shown = lambda turns: "".join(f"<|start|>{r}\n{t}<|end|>\n" for r, t in turns)

    def taught(turns):
        return [shown(turns[:i]).__len__() + len(f"<|start|>{r}\n") for i, (r, _) in enumerate(turns) if r == "assistant"], [
            t + "<|end|>" for r, t in turns if r == "assistant"
        ]

    return n, shown(chosen[:n]), shown(chosen[n:]), shown(rejected[n:]), taught(chosen[n:]), taught(rejected[n:])


def read_row(r):
    masks = []
    for side in ("chosen", "rejected"):
        spans = r[f"{side}_mask"]
        masks.append(([s["start"] for s in spans], [r[side][s["start"] : s["end"]] for s in spans]))
    return r["n_shared"], r["prompt"], r["chosen"], r["rejected"], *masks


def test_pairs_of_any_two_conversations(spark):
    draw = random.Random(5)
    made = []
    for i in range(300):
        turn = lambda: (draw.choice(["user", "assistant", "system", ""]), draw.choice(["", "a", "é\n漢", "<|end|>", "long " * 50]))
        front = [turn() for _ in range(draw.randrange(5))]
        made.append((i, front + [turn() for _ in range(draw.randrange(4))], front + [turn() for _ in range(draw.randrange(4))]))
    made += [(900, [], []), (901, [("user", "x")] * 3, [("user", "x")] * 3), (902, [("assistant", "x")], []), (903, [("assistant", "t")] * 400, [("assistant", "t")] * 399)]
    kind = "array<struct<role:string,text:string>>"
    got = preference.formatted(spark.createDataFrame(made, f"pair_id long, chosen {kind}, rejected {kind}"))
    assert {r["pair_id"]: read_row(r) for r in got.collect()} == {i: plain_pair(a, b) for i, a, b in made}


def test_swapped_replies_whole(spark):
    draw = random.Random(6)
    rows = []
    for conv in sorted(draw.sample(range(200), 120)) + [None]:
        for turn in range(draw.randrange(1, 7)):
            role, text = draw.choice(["user", "assistant", None]), draw.choice([None, "", f"t{draw.randrange(4)}", "ß" * 30])
            rows += [(conv, draw.choice([turn, turn, None]), role, text, 1)] * draw.choice([1, 1, 2])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last int").repartition(3)
    got = preference.formatted(preference.swapped_replies(preference.conversations(frame)))
    talks = [(None, [(r or "", t or "")]) for c, _, r, t, _ in rows if c is None]
    named = {}
    for c, k, r, t, _ in rows:
        if c is not None:
            named.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    talks += [(c, [(r, t) for _, r, t in sorted(x)]) for c, x in named.items()]
    reply = lambda turns: next((t for r, t in reversed(turns) if r == "assistant"), None)
    replies, want = {c: reply(x) for c, x in talks if c is not None}, []
    for c, turns in talks:
        other, swapped = replies.get(c + 1) if c is not None else None, list(turns)
        if reply(turns) is not None:
            at = max(i for i, (r, _) in enumerate(turns) if r == "assistant")
            swapped[at] = ("assistant", other or "")
        want.append((c, plain_pair(turns, swapped)))
    assert sorted(((r["pair_id"], read_row(r)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.formatted(preference.swapped_replies(preference.conversations(none))).count() == 0


def test_sum_of_squares_is_the_sum_over_pairs():
    draw = np.random.default_rng(8)
    m = factorisation.Machine(0.3, draw.normal(size=40), draw.normal(size=(40, factorisation.RANK)))
    rows = [draw.choice(40, n, replace=False) for n in (0, 1, 2, 9, 25)]
    slots, values = np.concatenate(rows).astype(np.int32), draw.random(sum(map(len, rows)))
    edges = np.cumsum([0, *map(len, rows)])
    want = []
    for a, z in zip(edges, edges[1:]):
        s, x = slots[a:z], values[a:z]
        pairs = sum(float(m.vectors[s[i]] @ m.vectors[s[j]]) * x[i] * x[j] for i, j in combinations(range(len(s)), 2))
        want.append(0.3 + float(m.weights[s] @ x) + pairs)
    assert m.logits(slots, values, edges) == pytest.approx(want, abs=1e-9)


def test_trained_scores_of_odd_rows(spark):
    draw = random.Random(9)
    good, bad = [f"word{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(good if i % 2 else bad, k=40)), 240) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    odd = [(1000, None, None), (1001, "", 0), (1002, rows[1][1], 240), (1002, rows[1][1], 240), (None, rows[1][1], 240), (1003, "x " * 100_000, 200_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, n_chars long")
    got = factorisation.score(docs, factorisation.train(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.9
    same = {r["score"] for r in got if r["doc_id"] in (1, 1002, None)}
    assert len(same) == 1
