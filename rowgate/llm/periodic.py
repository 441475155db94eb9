"""Periodic runs in texts: stretches of words that repeat with a period, found by a dictionary of basic factors.

The words of a batch of texts are numbered, each text with numbers of its own. For each power of two L, the factors of L words get equal names if they
are equal; the names of 2L come from pairs of names of L, and only factors that occur again stay in the dictionary. Where the next
occurrence of a factor is at most 2L words away, its distance is a candidate period; stretches of places with one distance
are the arithmetic progressions of the factor and its neighbours. A stretch that covers enough is extended in both directions as far as the
words go on repeating, and the runs that several lengths propose are kept once.

Why none is missed: a run of smallest period q and at least three periods holds, for the L with q <= L < 2q, two factors at a distance
of q from its first word on. No occurrence lies between them, as two such periods would have a smaller one in common (Fine and Wilf).

Each text is worked on in one task, with memory in proportion to its words; nothing is shuffled.

Defined results: null and blank texts have no words, no runs and an empty collapsed text; every row is a text of its own, so repeated rows
and null ids give a row each; of equally strong runs the first, then the one of the smaller period is the best; an empty table gives an
empty result. Words are what blanks (20, 09 to 0D) leave, compared exactly. Other columns of the input are not looked at."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import map_batches, quoted

MIN_WORDS, MIN_PERIODS = 24, 3


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur more than once, a dense name for each key)."""
    _, names, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[names] > 1, names


def _stretches(at: np.ndarray, names: np.ndarray, size: int, min_words: int, min_periods: int):
    """(first place, last place, distance) of consecutive places whose factors come again at one distance of at most 2 * size, if the
    words they cover are enough for a run. `at` is sorted."""
    order = np.argsort(names, kind="stable")
    place, name = at[order], names[order]
    distance = np.diff(place)
    near = (name[1:] == name[:-1]) & (distance <= 2 * size)
    i, d = place[:-1][near], distance[near]
    if not len(i):
        return
    order = np.argsort(i)
    i, d = i[order], d[order]
    first = np.flatnonzero((np.diff(i, prepend=-2) != 1) | (np.diff(d, prepend=-1) != 0))
    last = np.append(first[1:], len(i)) - 1
    start, end, period = i[first], i[last], d[first]
    enough = end - start + size + period >= np.maximum(min_words, min_periods * period)
    yield from zip(start[enough].tolist(), end[enough].tolist(), period[enough].tolist(), strict=True)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal items at the front of two arrays."""
    at, size, n = 0, 64, min(len(a), len(b))
    while at < n:
        other = np.flatnonzero(a[at : min(at + size, n)] != b[at : min(at + size, n)])
        if len(other):
            return at + int(other[0])
        at, size = at + size, 2 * size
    return n


def runs(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period. `words` are numbers, equal only inside a text, and ends[i]
    is where the text of word i ends."""
    found, n = set(), len(words)
    live, names = _again(words)
    at = np.flatnonzero(live)
    names, size = names[at], 1
    while len(at):
        for i, j, d in _stretches(at, names, size, min_words, min_periods):
            left = _same(words[:i][::-1], words[: i + d][::-1])
            right = j + size + _same(words[j + size :], words[j + size + d :])
            found.add((i - left, right + d - i + left, d))
        named = np.full(n, -1, np.int64)
        named[at] = names
        at = at[at + 2 * size <= ends[at]]
        at = at[named[at + size] >= 0]
        live, names = _again(named[at] * n + named[at + size])
        at, names, size = at[live], names[live], 2 * size
    return sorted((s, n, d) for s, n, d in found if n >= max(min_words, min_periods * d))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by blanks."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def runs_of_texts(texts: list[list[bytes]], min_words: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    borders = np.concatenate(([0], np.cumsum(sizes)))
    vocabulary = defaultdict(count().__next__)
    numbers = np.fromiter((vocabulary[w] for t in texts for w in t), np.int64, borders[-1])
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = [[] for _ in texts]
    for start, length, period in runs(owner * len(vocabulary) + numbers, borders[owner + 1], min_words, min_periods):
        out[owner[start]].append((start - int(borders[owner[start]]), length, period))
    return out


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period), best (the run of the greatest length
    by period) and collapsed (the text without repeated periods, words joined by one blank)."""
    if min_words < 1 or min_periods < 3:
        raise ValueError("a run has at least one word and three periods")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def told(found: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), found, strict=True))

    def looked(batches):
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            found = runs_of_texts(texts, min_words, min_periods)
            best = [told(max(x, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if x else None for x in found]
            cols = [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[told(r) for r in x] for x in found], pa.list_(run)),
                pa.array(best, run),
                pa.array([collapsed(t, x) for t, x in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "best", "collapsed"])

    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("t"))
    shape = "struct<start:bigint,length:bigint,period:bigint>"
    return map_batches(narrow, looked, f"doc_id {kind}, n_words bigint, runs array<{shape}>, best {shape}, collapsed string")
