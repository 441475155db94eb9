import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rowgate.llm import quality
from rowgate.llm.oracles import QUALITY
from rowgate.llm.queries import op5_quality

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_shouts": len(re.findall("[!?]", text)),
    }


TEXTS = [None, "", " \n\t\x0b", "a b c a b c", "a a a a a", "a b c d a b c e a b", "x\nx\n x\n\nx", "é日 <b>|#*$%&</b>\x85\xa0z", "A b! C? " * 30, "one two three four five six seven " * 12, "w\x1cx \x00 y", "a b\r\nc d\r\na b\r\n"]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, kept string, n_words int")


def test_counts_against_plain_python(spark):
    docs = frame(spark, [*TEXTS, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.counts(F.col("text"), docs, F.col("doc_id")).collect():
        assert {c: r[c] for c in quality.COUNTS} == plain_counts(texts[r.doc_id]), texts[r.doc_id]


def test_a_very_long_text(spark):
    text = " ".join(str(i % 9_000) for i in range(100_000)) + " end"
    r = quality.counts(F.col("text"), frame(spark, [text]), F.col("doc_id")).first()
    assert (r.n_words, r.n_repeat_words, r.n_distinct) == (100_001, 100_000, 9_001)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 1, 0.3), (0, 500, 0.01), (3, 700, 0.01), (20, 30, 0.9), (2, 21, 0.2), (900, 100_000, 0.01), (40, 50, 0.5), (0, 0, 0.1), (150, 20_000, 0.008)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(F.lit(k).cast("bigint").alias("k"), F.lit(n).cast("bigint").alias("n")).select(quality.binomial_tail("k", "n", p)).first()[0]
    if k >= n * p:
        assert got == 1
    else:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == pytest.approx(exact, rel=1e-9)


def holdout(spark, n, lost):
    """n good documents of which `lost` have many symbols, and as many bad ones that all have."""
    def body(i):
        return " ".join(f"w{i}x{j}" + "##" * (i < lost or i >= n) for j in range(60))

    rows = [(i, body(i), "en") for i in range(2 * n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id bigint, quality int")


def test_cutoffs_need_proof(spark):
    docs, labels = holdout(spark, 1800, 0)
    got = quality.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id < 1800) for r in got)
    few = quality.judge(*holdout(spark, 100, 0)).collect()
    assert all(r.kept for r in few)
    noisy = quality.judge(*holdout(spark, 1800, 60)).collect()
    assert all(r.kept for r in noisy)


def test_strata_and_odd_rows(spark):
    docs, labels = holdout(spark, 1800, 0)
    bad = " ".join(f"n{i}##" for i in range(60))
    more = spark.createDataFrame([(None, bad, "en"), (5000, bad, None), (5001, bad, "xx"), (5002, None, "en"), (5003, bad, "en"), (5003, bad, "en")], docs.schema)
    marks = labels.unionAll(spark.createDataFrame([(None, 1), (3, None), (3, 5), (7_000_000, 1)], labels.schema))
    got = [r for r in quality.judge(docs.unionAll(more), marks).collect() if r.doc_id is None or r.doc_id >= 5000]
    assert sorted((r.doc_id or 0, r.kept, r.base_failed) for r in got) == [(0, False, False), (5000, True, False), (5001, True, False), (5002, False, True), (5003, False, False), (5003, False, False)]
    kept = quality.keep_good(docs.unionAll(more).withColumn("text_hash_", F.lit(1)), marks)
    assert kept.columns == ["doc_id", "text", "lang", "text_hash_"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(1800), 5000, 5001]
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_query_agrees_with_sql_and_runs_no_python(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = op5_quality(spark, SF)
    cursor = con.execute(QUALITY)
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())
    plan = quality.counts(F.col("text"), spark.read.parquet(f"{SF}/documents.parquet"), F.col("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
