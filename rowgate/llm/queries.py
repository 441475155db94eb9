"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.llm import chat, langid, lexical, licences, linededup, materialise, oracles, packing, periodic, pii, quality, simhash, tiling, toxicity
from rowgate.llm.common import Scratch, map_batches, quoted, read
from rowgate.session import run_folder


def fold_of(ids: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def fold(id_col: str, folds: int) -> Column:
    return fold_of(F.col(id_col), folds)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs, ~fold("doc_id", 3).isin(1, -1))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents, and the known sentences found."""
    found = licences.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    docs = read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))
    text = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    base = F.transform(F.filter("spans", lambda s: s.base), lambda s: F.concat_ws(":", s.kind, s.start, s.end))

    def n_base(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("bigint").alias(f"n_{kind}")

    count = [n_base(k) for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))


#: Both texts of the extra conversation of op4_chat.
TRICKY = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted, written and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    formatted = chat.format_turns(turns.unionAll(extra), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return chat.read_back(Scratch(spark, "chat").table(formatted))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of all documents; strata are the languages."""
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride shards in training order, read back record by record."""
    ranks = materialise.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))  # the documents are in four languages
    docs = read(spark, sf_dir, "documents")
    shards = materialise.materialise(docs, run_folder(spark, "shards"), ranks, public_tokenizers.PATTERN, end_id=50256, key=2024)
    records = materialise.read_records(spark, shards)
    return records.select("slot", "shard", "byte_offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, at most 2 of 64 bits apart."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, radius=2, segments=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer, end_id=2, max_tokens=4096)
    return packing.piece_digests(pieces)


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that give a benchmark item away, with the item and the tiles."""
    found = tiling.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    tile = F.transform("tiles", lambda t: F.concat_ws(":", t.doc_start, t.test_start, t.words))
    words = F.aggregate("tiles", F.lit(0).cast("bigint"), lambda a, t: a + t.words)
    return found.select("doc_id", "item_id", "coverage", words.alias("matched_words"), F.array_join(tile, ",").alias("tiles"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), lambda c: ~fold_of(c, 4).isin(2, -1))
    held = fold("doc_id", 4) == 2
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "ratio", "n")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that three or more share, told by count and digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.drop_shared_lines(docs, min_chars=20, min_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text by h, the crc32 of its id, goes on periodically from a word on. Null ids have no h."""
    kind = docs.schema[id_col].dataType.simpleString()

    def planted(batches):
        for batch in batches:
            out = []
            for text, h in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if text and h is not None and h % 10 == 0 and (words := text.split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    ids = quoted(id_col)
    narrow = docs.select(ids.alias("doc_id"), quoted(text_col).cast("binary").alias("t"), F.crc32(ids.cast("string").cast("binary")).alias("h"))
    return map_batches(narrow, planted, f"doc_id {kind}, text string")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents with planted ones: number, the strongest, and digests of the runs and of the collapsed text."""
    found = periodic.find_runs(with_planted_runs(read(spark, sf_dir, "documents")), min_words=24, min_periods=3)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    digests = [F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best, exponent, *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_licences": op2_licences,
    "op3_pii": op3_pii,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_materialise": op6_materialise,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_tiling": op9_tiling,
    "op10_toxicity": op10_toxicity,
    "op11_search": op11_search,
    "op12_lines": op12_lines,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op2_licences": oracles.LICENCES,
    "op5_quality": oracles.QUALITY,
    "op11_search": oracles.SEARCH,
    "op12_lines": oracles.LINES,
}
