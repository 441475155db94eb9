"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits; characters of scripts that put no blanks between words are words of their own. A running Karp-Rabin hash over `seed` words finds the places that a document shares with a
test; seeds in a row on one diagonal are a maximal match. The longest match that overlaps no marked word is marked again and again,
as long as `seed` words remain, so reordered passages count too. A test whose words are covered by `coverage` or more is leaked. A test of fewer than
`seed` words is its own seed and must be found whole.

Tests are a stated query set. They are held in blocks of bounded size, each block is sent to the tasks and meets all rows in one
pass without a shuffle. Hash matches are verified on the words.

Defined results: null and empty documents and tests, and those without a letter or digit, share nothing;
repeated documents and tests give a row each; null ids are kept; empty tables give no rows. Of equally long matches the
first in the document, then in the test, is marked. Other columns of the input are not looked at."""

from __future__ import annotations

import heapq
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch, map_batches, match, quoted, unused

SEED_WORDS, COVERAGE = 5, 0.8
#: Bytes of test text in one block.
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Thai, Lao, Burmese, Khmer, kana and Han characters, fixed ranges of code points.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def karp_rabin(ids: np.ndarray, size: int) -> np.ndarray:
    """Running hash of every window of `size` ids, modulo 2^64."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


def tiles(at_doc: np.ndarray, at_test: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed matches: (start in the document, start in the test, words), by size."""
    order = np.lexsort((at_doc, at_doc - at_test))
    d, t = at_doc[order], at_test[order]
    new = np.flatnonzero((np.diff(d - t, prepend=d[0] - t[0] - 1) != 0) | (np.diff(d, prepend=d[0] - 2) != 1))
    heap = [(-int(n) - seed + 1, int(d[i]), int(t[i])) for i, n in zip(new, np.diff(new, append=len(d)), strict=True)]
    heapq.heapify(heap)
    doc_marks, test_marks, out = set(), set(), []
    while heap:
        size, i, j = heapq.heappop(heap)
        free = [k for k in range(-size) if i + k not in doc_marks and j + k not in test_marks]
        if len(free) == -size:
            doc_marks.update(range(i, i - size))
            test_marks.update(range(j, j - size))
            out.append((i, j, -size))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= seed:
                    heapq.heappush(heap, (start - k, i + free[start], j + free[start]))
                start = k
    return out


class Tests:
    """A block of tests. Short ones are in indexes of their own, by their number of words."""

    __test__ = False

    def __init__(self, rows: list[tuple], seed: int) -> None:
        cut = [(item, words_of(text)) for item, text in rows]
        self.parts = [Index([x for x in cut if len(x[1]) == n], n, True) for n in range(1, seed)] + [Index([x for x in cut if len(x[1]) >= seed], seed, False)]
        self.parts = [p for p in self.parts if p.items]
        self.items = [item for p in self.parts for item in p.items]

    def leaked(self, text: str | None, coverage: float):
        """(test number, share covered, tiles) for every test that the text gives away."""
        words, before = words_of(text) if self.parts else [], 0
        for part in self.parts:
            for k, share, found in part.leaked(words, 1.0 if part.whole else coverage):
                yield before + k, share, found
            before += len(part.items)


class Index:
    """Words and seeds of some tests, and where they are. whole: each test is one seed."""

    def __init__(self, tests: list[tuple], seed: int, whole: bool) -> None:
        self.seed, self.whole, self.vocabulary, kept, ids = seed, whole, {}, [], []
        for item, words in tests:
            kept.append(item)
            ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.items, self.ids = kept, ids
        hashes = [karp_rabin(x, seed) for x in ids]
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if ids else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if ids else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def leaked(self, words: list[str], coverage: float):
        """(test number, share covered, tiles) for every test that the words give away."""
        if len(words) < self.seed or not len(self.keys):
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        inside = np.concatenate(([0], np.cumsum(ids == 0)))
        where = np.flatnonzero(inside[self.seed :] == inside[: -self.seed])
        if not len(where):
            return
        hashes = karp_rabin(ids, self.seed)[where]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        at, where = at[hit], where[hit]
        if not len(where):
            return
        n = self.count[at]
        pick = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc, test, place = np.repeat(where, n), self.owner[pick], self.place[pick]
        for k in np.unique(test):
            own = test == k
            d, t, item = doc[own], place[own], self.ids[k]
            same = (ids[d[:, None] + np.arange(self.seed)] == item[t[:, None] + np.arange(self.seed)]).all(axis=1)
            d, t = d[same], t[same]
            reach = np.zeros(len(item) + 1, np.int64)
            np.add.at(reach, np.unique(t), 1)
            np.add.at(reach, np.minimum(np.unique(t) + self.seed, len(item)), -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(item):
                continue  # even with all seeds marked
            found = tiles(d, t, self.seed)
            share = sum(n for _, _, n in found) / len(item)
            if share >= coverage:
                yield int(k), share, found


def leaks(
    docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    seed: int = SEED_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and test that it gives away: doc_id, text_hash, item_id, coverage and tiles (start in the document, start
    in the test, words), longest first."""
    if seed < 1 or not 0 < coverage <= 1:
        raise ValueError("seed must be at least 1 and coverage above 0 and at most 1")
    asked = tests.select(quoted(item_col).alias("i"), quoted(item_text).alias("t")).where("t IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    narrow = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).alias("t"))
    kinds = docs.schema[id_col].dataType.simpleString(), tests.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, text_hash bigint, item_id {kinds[1]}, coverage double, tiles array<struct<doc_start:bigint,test_start:bigint,words:bigint>>"
    tile = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_start", "test_start", "words")]))
    item_type = asked.select("i").limit(0).toArrow().schema.field(0).type

    def one(block: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        index = Tests([tuple(r) for r in rows], seed)

        def found(batches):
            for batch in batches:
                out = [
                    (n, k, share, [dict(zip(("doc_start", "test_start", "words"), x, strict=True)) for x in marks])
                    for n, text in enumerate(batch.column(2).to_pylist())
                    for k, share, marks in index.leaked(text, coverage)
                ]
                if out:
                    n, k, share, marks = zip(*out, strict=True)
                    picked = [c.take(pa.array(n)) for c in batch.columns[:2]]
                    data = [*picked, pa.array([index.items[x] for x in k], item_type), pa.array(share), pa.array(marks, tile)]
                    yield pa.RecordBatch.from_arrays(data, ["doc_id", "text_hash", "item_id", "coverage", "tiles"])

        return map_batches(narrow, found, schema)

    return reduce(DataFrame.unionAll, [one(b) for b in range(blocks)])


def drop_leaking(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that give no test away, with all their columns."""
    th, key, own = unused(docs, "text_hash_", "key_", "own_")
    bad = leaks(docs, tests, id_col, text_col, **how).select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct()
    bad = Scratch(docs.sparkSession, "leaks").table(bad)
    marked = docs.withColumn(th, F.xxhash64(quoted(text_col)))
    return match(marked, bad, quoted(id_col).eqNullSafe(F.col(key)) & (F.col(th) == F.col(own)), "left_anti").drop(th)
