"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed letter pairs and triples. Document frequencies come from all training texts. The
centroids, several for each language, are clustered (spherical k-means) from a bounded sample of each language. A text has the language
of the centroid with the largest cosine; it is accepted if its distance is not beyond what the sample's own texts have.

Defined results: `und`, score 0, for null texts and texts without a letter, and for all texts if nothing could be learned; texts are
taken whole; equal cosines go to the language that sorts first; repeated rows get a row each; null ids are kept; an empty table gives no rows.
Languages are taken from `lang` of the training rows only; other columns are not looked at."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgate.llm.common import map_batches, quoted

BUCKETS = 4096
#: Different training texts of each language in the sample that centroids are clustered from.
SAMPLE_TEXTS = 400
CENTROIDS = 4
#: Languages whose centroids may be sent to the tasks (BUCKETS * 4 bytes for each centroid).
MAX_LANGUAGES = 1000
#: Characters that are turned into vectors at a time.
_BLOCK = 1 << 20


class Letters:
    """Letters of texts as lower-case code points, everything else as 0."""

    EXACT = 0x3000

    def __init__(self) -> None:
        chars = [chr(i) for i in range(self.EXACT)]
        self.table = np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], np.uint32)

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(raw, self.EXACT - 1)]
        for c in np.unique(raw[raw >= self.EXACT]).tolist():
            out[raw == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]


class Vectors:
    def __init__(self, buckets: int) -> None:
        self.letters, self.buckets = Letters(), buckets

    def counts(self, texts: list[str | None]):
        """Blocks of (number of the first text, matrix of n-gram counts, whether a text has a letter)."""
        at = 0
        while at < len(texts):
            codes, size, end = [], 0, at
            while end < len(texts) and (end == at or size < _BLOCK and end - at < 256):
                codes.append(np.concatenate(([0], self.letters.codes(texts[end] or ""), [0])).astype(np.uint32))
                size += len(codes[-1])
                end += 1
            yield at, self._grams(codes), np.array([bool(c.any()) for c in codes])
            at = end

    def _grams(self, codes: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(codes)
        doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        shift = np.uint32(32 - (self.buckets - 1).bit_length())
        a, b = every[:-1] * np.uint32(2654435761), every[1:]
        pair = (a ^ (b * np.uint32(2246822519))) * np.uint32(3266489917)
        triple = (pair[:-1] ^ (every[2:] * np.uint32(668265263))) * np.uint32(374761393)
        total = np.zeros(len(codes) * self.buckets, np.int64)
        for grams, real, last in ((pair, (every[:-1] | b) != 0, 1), (triple, every[1:-1] != 0, 2)):
            same = real & (doc[: len(grams)] == doc[last:])
            where = doc[: len(grams)][same] * self.buckets + (grams[same] >> shift)
            total += np.bincount(where, minlength=len(total))
        return total.reshape(len(codes), self.buckets)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = (np.log1p(counts) * idf).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """centroids: rows of unit length, by language, then cluster; reach: largest distance that is accepted."""

    buckets: int
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    reach: np.ndarray


def _clusters(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, started from the texts that are farthest from each other."""
    mean = rows.mean(axis=0)
    seeds = [int(np.argmax(rows @ mean))]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin((rows @ rows[seeds].T).max(axis=1))))
    centres = rows[seeds]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.array([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def learn(
    docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS,
    sample_texts: int = SAMPLE_TEXTS, centroids: int = CENTROIDS,
) -> Model | None:
    """Model from the rows for which `training` holds and text and language are not null; None if there are none."""
    rows = docs.where(training & quoted(text_col).isNotNull() & quoted(lang_col).isNotNull())
    rows = rows.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("t"), F.xxhash64(quoted(text_col)).alias("h"))

    def frequencies(batches):
        vectors, df, n = Vectors(buckets), np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, counts, _ in vectors.counts(batch.column(0).to_pylist()):
                df += (counts > 0).sum(axis=0)
                n += len(counts)
        if n:
            data = [pa.array(np.arange(buckets + 1)), pa.array(np.append(df, n))]
            yield pa.RecordBatch.from_arrays(data, ["bucket", "n"])

    df = map_batches(rows.select("t"), frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    if not df:
        return None
    found = dict(map(tuple, df))
    idf = np.log((1 + found[buckets]) / (1 + np.array([found[i] for i in range(buckets)]))).astype(np.float32) + 1

    order = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_texts)
    langs = chosen.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    hashes = sorted({r.h for r in chosen.select("h").collect()})
    sample = rows.where(F.col("h").isin(hashes)).groupBy("lang", "h").agg(F.first("t").alias("t"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("h")["t"].tolist()
        data = np.concatenate([unit(c[real], idf) for _, c, real in Vectors(buckets).counts(texts)])
        if not len(data):
            return pd.DataFrame({"lang": [], "centroid": [], "reach": []})
        centres = _clusters(data, centroids)
        near = data @ centres.T
        own = near.argmax(axis=1)
        reach = [float(1 - near[own == j, j].min()) if (own == j).any() else 0.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(centres), "reach": reach})

    got = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, reach double").collect()
    if not got:
        return None
    got.sort(key=lambda r: r.lang)
    return Model(buckets, idf, [r.lang for r in got], np.array([r.centroid for r in got], np.float32), np.array([r.reach for r in got]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score (cosine, 0 to 1) and accepted (false: too far from every centroid)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def named(batches):
        vectors = Vectors(model.buckets) if model else None
        for batch in batches:
            n = batch.num_rows
            langs, scores, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if model:
                for at, counts, real in vectors.counts(batch.column(1).to_pylist()):
                    near = unit(counts, model.idf) @ model.centroids.T
                    best = near.argmax(axis=1)
                    top = near[np.arange(len(best)), best]
                    scores[at : at + len(best)] = np.where(real, np.clip(top, 0, 1), 0)
                    accepted[at : at + len(best)] = real & (1 - top <= model.reach[best] + 1e-6)
                    for i in np.flatnonzero(real):
                        langs[at + i] = model.langs[best[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("t"))
    return map_batches(narrow, named, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
