import random
from collections import defaultdict

import numpy as np
import pytest

from rowgate.llm import tiling
from rowgate.llm.queries import op9_tiling


def plain_tiles(doc, test, seed):
    """Greedy string tiling as it is defined: look for the longest unmarked common run, first in the document, then in the test."""
    marked_doc, marked_test, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(test)):
                n = 0
                while i + n < len(doc) and j + n < len(test) and doc[i + n] == test[j + n] and i + n not in marked_doc and j + n not in marked_test:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < seed:
            return out
        out.append(best)
        marked_doc.update(range(best[0], best[0] + best[2]))
        marked_test.update(range(best[1], best[1] + best[2]))


def test_tiles_against_the_definition():
    rng = random.Random(5)
    for _ in range(120):
        test = [rng.choice("abcd") for _ in range(rng.randrange(1, 18))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        cut = rng.randrange(len(test))
        doc += test[cut:] + ["z"] + test[:cut]
        index = tiling.Tests([(7, " ".join(test))], 3)
        got = [(round(share, 9), sorted(found)) for _, share, found in index.leaked(" ".join(doc), 1e-9)]
        want = plain_tiles(doc, test, min(3, len(test)))
        share = round(sum(n for *_, n in want) / len(test), 9)
        assert [s for s, _ in got] == ([share] if want else [])
        if got:
            assert sorted(n for *_, n in got[0][1]) == sorted(n for *_, n in want)


def test_running_hash():
    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6])
    got = tiling.karp_rabin(ids, 3)
    for i, h in enumerate(got.tolist()):
        assert h == (int(ids[i]) * int(tiling._BASE) ** 2 + int(ids[i + 1]) * int(tiling._BASE) + int(ids[i + 2])) % 2**64
    assert len(tiling.karp_rabin(ids[:2], 3)) == 0


def test_query_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: tiling.words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tests = {r.item_id: tiling.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    seeds = defaultdict(set)
    for i, w in tests.items():
        for k in range(len(w) - 4):
            seeds[tuple(w[k : k + 5])].add(i)
    want = set()
    for d, w in docs.items():
        for i in {x for k in range(len(w) - 4) for x in seeds.get(tuple(w[k : k + 5]), ())}:
            near = {x for k in range(len(w) - 4) if i in seeds.get(tuple(w[k : k + 5]), ()) for x in range(k - 60, k + 65)}
            part = [w[k] if k in near else None for k in range(len(w))]
            part = [x for k, x in enumerate(part) if x is not None or k == 0 or part[k - 1] is not None]
            share = sum(n for *_, n in plain_tiles(part[:400], tests[i], 5)) / len(tests[i]) if len(part) <= 400 else None
            if share is None or share >= 0.8:
                want.add((d, i))
    got = op9_tiling(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.8 <= r.coverage <= 1 for r in got)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
HALVES = PASSAGE.split()[10:], PASSAGE.split()[:10]


def frames(spark):
    texts = [PASSAGE, "before " + PASSAGE.upper() + "! after", " ".join(HALVES[0]) + " between the halves " + " ".join(HALVES[1]), " ".join(HALVES[0]), None, "", "nothing of it", "w " * 100_000 + PASSAGE]
    docs = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, PASSAGE, "x", 1), (None, PASSAGE, None, None)]
    tests = [(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, PASSAGE, None), (1, "other words that no document has here at all", "x")]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, coverage int"),
        spark.createDataFrame(tests, "item_id bigint, text string, doc_id string"),
    )


@pytest.mark.parametrize("block_bytes", [tiling.BLOCK_BYTES, 60])
def test_reordered_passages_and_odd_rows(spark, block_bytes):
    docs, tests = frames(spark)
    got = tiling.leaks(docs, tests, block_bytes=block_bytes).collect()
    want = [d for d in (0, 0, 1, 2, 7, None) for _ in (1, None)]
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == sorted(d if d is not None else -1 for d in want)
    assert {r.item_id for r in got} == {1, None} and {r.coverage for r in got} == {1.0}
    assert sorted(len(r.tiles) for r in got if r.doc_id == 2) == [2, 2]
    assert tiling.leaks(docs.limit(0), tests).count() == tiling.leaks(docs, tests.limit(0)).count() == 0


def test_leaking_documents_are_dropped_with_their_copies(spark):
    docs, tests = frames(spark)
    kept = tiling.drop_leaking(docs, tests)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert tiling.drop_leaking(docs, tests.limit(0)).count() == docs.count()


def test_short_tests_and_scripts_without_blanks():
    tests = [("one", "Rome"), ("two", "too short"), ("four", "A b, c-d"), ("han", "水は百度で沸く"), ("long han", "東京は日本の首都であり人口が多い"), ("none", "?!"), ("thai", "กรุงเทพ")]
    index = tiling.Tests(tests, 5)

    def found(text):
        return {index.items[k]: share for k, share, _ in index.leaked(text, 0.8)}

    assert found("all roads lead to ROME now") == {"one": 1.0}
    assert found("a text that is too short. b c d a b c d") == {"two": 1.0, "four": 1.0}
    assert found("short too, Romes, a b c") == {} == found("") == found(None)
    assert found("あの水は百度で沸くのです") == {"han": 1.0}
    assert found("実は、東京は日本の首都であり人口が多いのである") == {"long han": 1.0}
    assert found("東京は日本の首都であり") == {}  # 11 of 16
    assert found("ไปกรุงเทพมา") == {"thai": 1.0}
    assert not tiling.Tests([("none", "?!"), ("null", None)], 5).items
