import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from rowgate.llm import periodic
from rowgate.llm.queries import op13_runs

SF = "/root/testdata/sf0.01"


def plain_runs(words, min_words=24, min_periods=3):
    """By the definition: every period, every maximal stretch, smallest period only."""
    out, n = [], len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, min_periods * q):
                smaller = (p for p in range(1, q) if all(words[x] == words[x + p] for x in range(i, i + length - p)))
                if next(smaller, None) is None:
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark):
    got = sorted(tuple(r) for r in op13_runs(spark, SF).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = {d for d, t in docs if len((t or "").split()) <= 700}  # the brute force takes the square of the words
    assert len(got) == len(docs)
    assert [r for r in got if r[0] in short] == sorted(plain_row(d, t) for d, t in docs if d in short)
    assert len(short) > 800 and sum(r[1] > 0 for r in got if r[0] in short) > 50


@pytest.mark.parametrize("seed", range(4))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 3)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                words[rng.randrange(n)] = rng.choice([9, words[0]])
            texts.append([b"%d" % w for w in words])
        least = rng.choice([1, 6, 24])
        assert periodic.runs_of_texts(texts, least, 3) == [plain_runs(t, least) for t in texts]
        assert periodic.runs_of_texts(texts, least, 4) == [plain_runs(t, least, 4) for t in texts]


def test_long_words_of_few_kinds():
    a, b = [b"0"], [b"0", b"1"]
    while len(b) < 3000:
        a, b = b, b + a
    square = [b"%d" % (bin(i).count("1") % 2) for i in range(2048)]  # holds no cube
    got = periodic.runs_of_texts([b, square, [b"x"] * 300_000], 24, 3)
    assert got[0] == plain_runs(b) and not got[1] and got[2] == [(0, 300_000, 1)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 24), (4, "a " * 24), (None, "b " * 23), (5, "a\x0bb\x0c" * 12), (6, "a\xa0b " * 30), (7, "x " + "p q r " * 40_000 + "y")]
    docs = spark.createDataFrame([(d, t, [1], "z") for d, t in rows], "doc_id bigint, text string, runs array<int>, best string")
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.best and tuple(r.best), r.collapsed) for r in periodic.find_runs(docs).collect()}
    assert periodic.find_runs(docs).count() == len(rows) and periodic.find_runs(docs.limit(0)).count() == 0
    assert got == {
        (1, 0, (), None, ""), (2, 0, (), None, ""), (3, 0, (), None, ""), (4, 24, ((0, 24, 1),), (0, 24, 1), "a"),
        (None, 23, (), None, " ".join("b" * 23)), (5, 24, ((0, 24, 2),), (0, 24, 2), "a b"), (6, 30, ((0, 30, 1),), (0, 30, 1), "a\xa0b"),
        (7, 120_002, ((1, 120_000, 3),), (1, 120_000, 3), "x p q r y"),
    }


def test_best_is_the_first_of_equals(spark):
    text = " ".join(["a"] * 24 + ["z"] + ["b", "c"] * 24 + ["z2"] + ["d"] * 24)
    best = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().best
    assert tuple(best) == (0, 24, 1)
    with pytest.raises(ValueError):
        periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string"), min_periods=2)
