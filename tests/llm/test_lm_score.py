import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import blocks as B
from rxframe.llm import lm_score
from rxframe.llm.queries import lm_training


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Automaton:
    """States, arcs and failure arcs in dictionaries, walked token by token."""

    def __init__(self, texts, order, prior):
        self.order, self.prior, self.seen = order, prior, Counter()
        for t in texts:
            w = ["<s>", *words(t)]
            for n in range(1, order + 1):
                for i in range(1, len(w)):
                    if i - n + 1 >= 0:
                        self.seen[tuple(w[i - n + 1:i + 1])] += 1
            self.seen[("<s>",)] += 1
        one = {k: c for k, c in self.seen.items() if len(k) == 1 and k != ("<s>",)}
        self.n, self.v = sum(one.values()), len(one)

    def unigram(self, w):
        return (self.seen[(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def arc(self, state, w):
        if not state:
            return self.unigram(w)
        c = self.seen[state]
        return (self.seen[(*state, w)] + self.prior * self.arc(state[1:], w)) / (c + self.prior)

    def score(self, text):
        state, total = ("<s>",) if self.order > 1 else (), 0.0
        for w in words(text):
            while state and not self.seen[state]:
                state = state[1:]
            total += math.log10(self.arc(state, w))
            state = (*state, w)[-(self.order - 1):] if self.order > 1 else ()
        return total


def expected(rows, order, prior):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    m = Automaton([t for (_, t), h in zip(rows, held) if not h], order, prior)
    out = []
    for (i, t), h in zip(rows, held):
        w = words(t)
        out.append((i, h, len(w), sum(m.seen[(x,)] > 0 for x in w), m.n, sum(math.log10(m.unigram(x)) for x in w), m.score(t)))
    return sorted(out, key=str)


def check(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_the_walked_automaton(sf_docs, order):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    df = lm_score.score(sf_docs, lm_training("doc_id"), order=order, block_bytes=40_000, range_bytes=100_000)
    check(df, expected(rows, order, lm_score.PRIOR))


def test_edge_rows(make_docs):
    docs = make_docs(EDGE).withColumn("_text", F.lit("clash")).withColumn("score", F.lit(1))
    check(lm_score.score(docs, lm_training("doc_id")), expected(EDGE, 2, lm_score.PRIOR))
    assert lm_score.score(make_docs([]), lm_training("doc_id")).count() == 0
    none = lm_score.score(make_docs([(1, "a b")]), F.lit(False)).first()
    assert none["train_tokens"] == 0 and none["n_known"] == 0 and none["base_score"] == 0


def test_arcs_of_a_state_sum_to_one():
    m = Automaton(["a b a c", "a b b", "c a"], 2, 4.0)
    tokens = {k[0] for k in m.seen if len(k) == 1 and k != ("<s>",)}
    for state in [("a",), ("b",), ("<s>",)]:
        assert sum(m.arc(state, w) for w in tokens) + m.arc(state, "unseen") == pytest.approx(1.0)


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2 ** 64 - 1, 1000, np.uint64))
    assert (B.unpack(B.pack(keys)) == keys).all()
    parts = B.split_ranges(keys, 8)
    assert sum(e - s for _, s, e in parts) == len(keys) and all((keys[s:e] >> np.uint64(61) == r).all() for r, s, e in parts)
    counts = np.array([0, 5, -1, 2 ** 40])
    assert (B.unpack_counts(B.pack_counts(counts)) == counts).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_states_arcs_and_failure_arcs(order):
    """Arcs lead to the longest context seen in training, failure arcs to the next shorter one."""
    learnt, held = ["a b a c", "a b b", "c a b a b c"], ["a b c x a b", "x", "", "c c a b a"]
    train = np.array([True] * len(learnt) + [False] * len(held))
    sizes, number, keys, total = lm_score._counts([t.encode() for t in learnt + held], train, order)
    m = Automaton(learnt, order, 4.0)
    auto = lm_score.automaton(number, sizes, keys, total, m.n + 0.5 * (m.v + 1), 4.0)
    assert auto.score(sizes) == pytest.approx([m.score(t) for t in learnt + held], rel=1e-12)
    arcs = set(auto.arcs.values()) | set(number[0])
    states = {0, auto.start} | {(k + 1) * auto.width for k in arcs if auto.target[k] == (k + 1) * auto.width}
    assert {auto.target[k] for k in arcs} <= states
    for s in states - {0}:
        k = s // auto.width - 1
        assert auto.failure[k + 1] in states and total[k] > 0
        assert auto.failure_weight[k + 1] == pytest.approx(math.log10(4 / (total[k] + 4)))
    assert len(auto.arcs) == sum(len(k) > 1 for k in m.seen)


def test_one_very_long_text(make_docs):
    rows = [(1, "a b c " * 60_000), (2, "x" * 300_000), (3, "a b c"), (None, None)]
    check(lm_score.score(make_docs(rows), lm_training("doc_id")), expected(rows, lm_score.ORDER, lm_score.PRIOR))
