import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rowgate.llm import langid
from rowgate.llm.queries import op1_langid


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op1_langid(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def plain_counts(text, buckets):
    """Bucket counts of pairs and triples, one at a time."""
    codes = [ord(c.lower()[0]) if c.isalpha() else 0 for c in f" {text or ''} "]
    codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
    if codes[-1] == 0 and len(codes) > 1 and codes == [0]:
        codes = [0, 0]
    out, shift = defaultdict(int), 32 - (buckets - 1).bit_length()
    for i, c in enumerate(codes):
        if i + 1 < len(codes) and (c or codes[i + 1]):
            pair = ((c * 2654435761 % 2**32) ^ (codes[i + 1] * 2246822519 % 2**32)) * 3266489917 % 2**32
            out[pair >> shift] += 1
            if i + 2 < len(codes) and codes[i + 1]:
                out[((pair ^ (codes[i + 2] * 668265263 % 2**32)) * 374761393 % 2**32) >> shift] += 1
    return out


def test_counts_against_one_text_at_a_time():
    texts = ["", None, "Ab", "Straße  12 ÉTÉ!\nдом 日本", "a", "9 9", "x" * 5000, "one two"]
    vectors = langid.Vectors(256)
    ((at, counts, real),) = vectors.counts(texts)
    assert at == 0 and real.tolist() == [False, False, True, True, True, False, True, True]
    for text, row in zip(texts, counts, strict=True):
        if text and any(c.isalpha() for c in text) and "  " not in text and "!" not in text:
            assert {i: n for i, n in enumerate(row) if n} == dict(plain_counts(text, 256))
    one = np.concatenate([c for _, c, _ in vectors.counts(["one two"])])
    assert (one[0] == counts[-1]).all()


ROWS = [("en", "the cat and the dog are in the house"), ("en", "this is the other thing that they have"), ("de", "der hund und die katze sind im haus"),
        ("de", "das ist nicht die andere sache die sie haben"), (None, "no language here"), ("fr", None)]


def docs(spark):
    rows = [(i, t, lang, "x", 1.5) for i, (lang, t) in enumerate(ROWS * 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")


def test_prediction_and_odd_rows(spark):
    model = langid.learn(docs(spark), F.lit(True))
    assert model.langs == sorted(model.langs) and set(model.langs) == {"en", "de"}
    texts = ["the thing", "die sache", None, "", "123 !?", "日本語", "the house and the dog " * 20_000, "the thing"]
    asked = spark.createDataFrame([(i if i < 7 else 0, t, None) for i, t in enumerate(texts)] + [(None, "the cat", None)], "doc_id bigint, text string, lang string")
    got = langid.predict(asked, model).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.lang_pred for r in by[0]] == ["en", "en"] and by[1][0].lang_pred == "de" and by[6][0].lang_pred == "en" and by[None][0].lang_pred == "en"
    for i in (2, 3, 4):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].accepted) == ("und", 0, False)
    assert by[5][0].lang_pred in ("en", "de") and not by[5][0].accepted
    assert langid.predict(asked.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    model = langid.learn(docs(spark), F.lit(False))
    assert model is None
    assert {r.lang_pred for r in langid.predict(docs(spark), model).collect()} == {"und"}


def test_sample_bound_does_not_depend_on_copies(spark):
    rows = docs(spark).unionAll(docs(spark)).unionAll(docs(spark))
    one, many = langid.learn(docs(spark), F.lit(True), sample_texts=1), langid.learn(rows, F.lit(True), sample_texts=1)
    assert one.langs == many.langs and np.allclose(one.centroids, many.centroids, atol=0.05)


def plain_grams(text, buckets):
    """Counts of a whole text by the definition: letters as lower-case code points, all else 0, with a 0 at both ends."""
    codes = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text), 0]
    out, shift = defaultdict(int), 32 - (buckets - 1).bit_length()
    for i in range(len(codes) - 1):
        pair = ((codes[i] * 2654435761 % 2**32) ^ (codes[i + 1] * 2246822519 % 2**32)) * 3266489917 % 2**32
        if codes[i] or codes[i + 1]:
            out[pair >> shift] += 1
        if codes[i + 1]:
            out[((pair ^ (codes[i + 2] * 668265263 % 2**32)) * 374761393 % 2**32) >> shift] += 1
    return out


def test_query_against_brute_force(spark):
    """Document frequencies, weights, clusters and the nearest centroid, with dictionaries and one text at a time."""
    sf, size = "/root/testdata/sf0.001", langid.BUCKETS
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).collect()
    grams = {r.doc_id: plain_grams(r.text or "", size) for r in rows}
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None]
    df = defaultdict(int)
    for r in train:
        for g in grams[r.doc_id]:
            df[g] += 1
    idf = np.array([np.log((1 + len(train)) / (1 + df[g])) + 1 for g in range(size)])

    def vector(counts):
        out = np.zeros(size)
        for g, n in counts.items():
            out[g] = np.log1p(n) * idf[g]
        return out / max(np.linalg.norm(out), 1e-12)

    centres, reach = [], []
    for lang in sorted({r.lang for r in train}):
        texts = {r.h: r for r in train if r.lang == lang and any(c.isalpha() for c in r.text)}
        assert len(texts) < langid.SAMPLE_TEXTS
        data = np.array([vector(grams[texts[h].doc_id]) for h in sorted(texts)])
        seeds = [int(np.argmax([v @ data.mean(axis=0) for v in data]))]
        while len(seeds) < min(langid.CENTROIDS, len(data)):
            seeds.append(int(np.argmin([max(v @ data[s] for s in seeds) for v in data])))
        own = data[seeds]
        for _ in range(10):
            near = [int(np.argmax([v @ c for c in own])) for v in data]
            sums = [data[[i for i, k in enumerate(near) if k == j]].mean(axis=0) if j in near else own[j] for j in range(len(own))]
            own = np.array([c / np.linalg.norm(c) for c in sums])
        near = [int(np.argmax([v @ c for c in own])) for v in data]
        centres += [(lang, c) for c in own]
        reach += [max((1 - v @ own[j] for v, k in zip(data, near, strict=True) if k == j), default=0.0) for j in range(len(own))]
    got = {r.doc_id: r for r in op1_langid(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].accepted) == ("und", 0, False)
            continue
        cosines = [vector(grams[r.doc_id]) @ c for _, c in centres]
        best = int(np.argmax(cosines))
        assert got[r.doc_id].lang_pred == centres[best][0] and abs(got[r.doc_id].score - cosines[best]) < 1e-4
        if abs(1 - cosines[best] - reach[best]) > 1e-4:
            assert got[r.doc_id].accepted == (1 - cosines[best] <= reach[best])
