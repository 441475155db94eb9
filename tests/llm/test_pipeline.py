import os

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rowgate.llm import common, tiling
from rowgate.llm.queries import op5_quality
from tests.llm.test_packing import check
from tests.llm.test_pii import plain_spans
from tests.llm.test_shingles import plain_classes

SF = "/root/testdata/sf0.001"


def staged(spark):
    """What each stage returns, written and read again."""
    out, docs = [], corpus_pipeline.read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.run_folder(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_against_brute_force(spark):
    docs = corpus_pipeline.read(spark, SF, "documents")
    good, unique, clean, hidden, packed = staged(spark)
    for df in (good, unique, clean, hidden):
        assert df.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in op5_quality(spark, SF).where("kept").collect()}
    texts = {r.doc_id: r.text for r in good.collect()}
    classes = plain_classes(texts)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(classes.values()))
    index = tiling.Tests([tuple(r) for r in corpus_pipeline.read(spark, SF, "benchmark").collect()], 5)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d in set(classes.values()) if not list(index.leaked(texts[d], 0.8)))
    final = {r.doc_id: r.text for r in hidden.collect()}
    assert sorted(final) == sorted(r.doc_id for r in clean.collect())
    for d, text in final.items():
        assert not plain_spans(text)
        assert (text == texts[d]) or "[" in text
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(packed.collect(), final, lambda x: t.encode(x, add_special_tokens=False).ids, 4096)


def test_run_leaves_no_scratch_table(spark, monkeypatch):
    made, folder = [], common.run_folder
    monkeypatch.setattr(common, "run_folder", lambda *args: made.append(folder(*args)) or made[-1])
    before = set(common._written)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(made) > 10 and set(common._written) == before
    assert not any(os.path.exists(p.removeprefix("file://")) for p in made)


def test_run_gives_the_rows_of_the_last_stage(spark):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(staged(spark)[-1].collect())


def test_stages_of_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 30, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).count()
