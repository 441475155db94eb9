import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm import toxicity
from rowgate.llm.common import Scratch
from rowgate.llm.queries import op10_toxicity


def symbols(text, order):
    """Symbols of a text with the blanks around it."""
    out = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    out = [c for i, c in enumerate(out) if c or (i and out[i - 1])]
    out = [c if c < 1024 else 768 + c % 256 for c in out]
    return [0] * (order - 1) + out + ([] if out and out[-1] == 0 else [0])


class Plain:
    """Interpolated Kneser-Ney of one class, written from its definition with dictionaries."""

    def __init__(self, texts, labels, order, shared):
        self.order, self.shared = order, shared
        top = {0: Counter(), 1: Counter()}
        for t, y in zip(texts, labels, strict=True):
            s = symbols(t, order)
            top[y].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
        self.own = {order: top}
        self.pool = {}
        seen = {y: set(top[y]) for y in top}
        every = seen[0] | seen[1]
        for k in range(order - 1, 0, -1):
            self.own[k] = {y: Counter(g[1:] for g in seen[y]) for y in seen}
            self.pool[k] = Counter(g[1:] for g in every)
            seen = {y: {g[1:] for g in seen[y]} for y in seen}
            every = {g[1:] for g in every}
        self.cache = {}

    def table(self, k, y):
        if (k, y) not in self.cache:
            counts = self.pool[k] if k <= self.shared else self.own[k][y]
            parts = [self.pool[k]] if k <= self.shared else [self.own[k][0], self.own[k][1]]
            n1, n2 = (sum(v == n for c in parts for v in c.values()) for n in (1, 2))
            sums, types = defaultdict(int), Counter()
            for g, v in counts.items():
                sums[g[:-1]] += v
                types[g[:-1]] += 1
            self.cache[k, y] = counts, sums, types, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return self.cache[k, y]

    def p(self, g, y):
        k = len(g)
        counts, sums, types, d = self.table(k, y)
        if k == 1:
            return counts[g] / sums[()]
        h = g[:-1]
        if not sums[h]:
            return self.p(g[1:], y)
        return max(counts[g] - d, 0) / sums[h] + d * types[h] / sums[h] * self.p(g[1:], y)

    def ratio(self, text):
        s = symbols(text, self.order)
        total = 0.0
        for i in range(self.order - 1, len(s)):
            g = tuple(s[i - self.order + 1 : i + 1])
            if self.pool[1][g[-1:]]:
                total += math.log(self.p(g, 1)) - math.log(self.p(g, 0))
            else:  # neither class has the symbol: only the backoff weights differ
                for k in range(self.order, self.shared, -1):
                    h = g[self.order - k : -1]
                    total += sum(sign * math.log(t[3] * t[2][h] / t[1][h]) for y, sign in ((1, 1), (0, -1)) if (t := self.table(k, y))[1][h])
        return total


WORDS = "the cat sat on a mat and saw some more of it then went home".split()


def sample(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(3, 30))]
        labels.append(int(i % 4 == 0))
        for _ in range(2 * labels[-1]):
            words.insert(rng.randrange(len(words)), rng.choice(["blurgh", "snarkface"]))
        texts.append(" ".join(words).capitalize() + rng.choice([".", "!", ""]))
    return texts, labels


@pytest.mark.parametrize(("order", "shared"), [(4, 2), (3, 1), (5, 3)])
@pytest.mark.parametrize("at_once", [toxicity.WEIGHTS_AT_ONCE, 400])
def test_ratios_are_those_of_the_definition(spark, monkeypatch, order, shared, at_once):
    monkeypatch.setattr(toxicity, "WEIGHTS_AT_ONCE", at_once)
    texts, labels = sample(60, 1)
    plain = Plain(texts, labels, order, shared)
    known = spark.createDataFrame(list(zip(texts, labels, strict=True)), "t string, toxic bigint")
    scratch = Scratch(spark, "test")
    table = scratch.table(toxicity.weights(scratch.table(toxicity.count_grams(known, order)), order, shared, scratch))
    asked = [*texts[:5], texts[0], "xyzzy blurgh", "", None, "Žluťoučký кот 日本", "blurgh blurgh", "the " * 30_000]
    got = toxicity.ratios(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, t string"), table, order, shared).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(asked)))
    for r in got:
        s = symbols(asked[r.doc_id], order)
        assert r.n == len(s) - order + 1
        if r.doc_id < len(asked) - 1:
            assert r.ratio == pytest.approx(plain.ratio(asked[r.doc_id]), rel=1e-4, abs=1e-4)


def frames(spark, n=400):
    texts, labels = sample(n, 2)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, ratio string, score double")
    marks = [(i, y, 1) for i, y in enumerate(labels)] + [(0, 1, 1), (1, None, 1), (2, 7, 1), (None, 1, 1), (99_999, 1, 1)]
    return docs, spark.createDataFrame(marks, "doc_id bigint, toxic bigint, score bigint"), labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = frames(spark)
    model = toxicity.learn(docs, labels, lambda c: c % 4 != 1)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3, bool(truth[r.doc_id])) for r in got if r.doc_id % 8 in (1, 5)]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "12 !?"), (None, "blurgh snarkface")], "doc_id bigint, text string")
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == 5 and len({r.score for r in scores if r.doc_id is not None}) == 1
    assert max(scores, key=lambda r: r.score).doc_id is None
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_labels_joined_by_a_shuffle_teach_the_same(spark, monkeypatch):
    docs, labels, _ = frames(spark, 120)
    one = toxicity.learn(docs, labels, lambda c: F.lit(True))
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    two = toxicity.learn(docs, labels, lambda c: F.lit(True))
    assert np.allclose(sorted(r.weight for r in one.table.collect()), sorted(r.weight for r in two.table.collect()))


def test_nothing_to_learn(spark):
    docs, labels, _ = frames(spark, 20)
    for marks in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.learn(docs, marks, lambda c: F.lit(True))
        assert model is None and {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**62, 5000))
    values = rng.normal(size=len(keys)).astype(np.float32)
    lookup = toxicity.Lookup(keys, values)
    found, known = lookup.get(keys[::-1].copy())
    assert (found == values[::-1]).all() and known.all()
    found, known = lookup.get(keys + 1)
    assert (known == np.isin(keys + 1, keys)).all() and (found[~known] == 0).all()
    assert not toxicity.Lookup(keys[:0], values[:0]).get(keys)[1].any()


def test_query_is_held_out_by_id(spark):
    got = op10_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
