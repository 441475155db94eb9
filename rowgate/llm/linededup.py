"""Line de-duplication: lines that several documents share stay in one of them.

Lines are cut at line feeds and exploded to keys: blanks at both ends are stripped and the letters A to Z are lower-cased. Keys of at
least `min_chars` code points are hashed to 128 bits, the documents of each hash are counted, and hashes of at least `min_docs` documents
lose all their lines but those of the document with the largest id. The other lines are put together again by position.

A key is told by two 64-bit halves of a 128-bit hash; two different lines of a corpus of 10^13 meet with a probability below 10^-12. What is
shuffled is hashes: 32 bytes for each different line of a document, added up before the shuffle, so a line that a third of
all documents hold costs one row for each task. The texts move once, if Spark does not find the list of what goes small enough to be sent to them.

Defined results: a null or empty text is one empty line; every row is a document of its own, so repeated rows and ids count once each, and all
rows of the largest id keep their lines; a null id is smaller than any other, and lines held by null ids only stay; an empty table gives an empty
result; of a very long text only its own lines are held. All input columns stay, with clashing names set aside."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rowgate.llm.common import Scratch, map_batches, quoted, unused

MIN_CHARS, MIN_DOCS = 20, 3
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of UTF-8 that go on with a code point.
_INNER = bytes(range(0x80, 0xC0))


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line's key; None if the key is too short to count."""
    key = line.strip(_BLANKS)
    if len(key) < min_chars or (not key.isascii() and len(key.translate(None, _INNER)) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, a, b): a row for each different key of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def exploded(batches):
        for batch in batches:
            at, halves = [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                found = {h for line in (text or b"").split(b"\n") if (h := line_hash(line, min_chars))}
                at += [n] * len(found)
                halves += found
            two = pa.py_buffer(b"".join(halves))
            cols = [pa.Array.from_buffers(pa.int64(), 2 * len(at), [None, two])[half::2] if at else pa.array([], pa.int64()) for half in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:2]), *cols], ["doc_id", "text_hash", "a", "b"])

    narrow = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).cast("binary").alias("t"))
    return map_batches(narrow, exploded, f"doc_id {kind}, text_hash bigint, a bigint, b bigint")


def shared_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, n_docs, keeper): keys of at least min_docs documents and the largest id among them."""
    return keys.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"),
) -> DataFrame:
    """The documents with all their columns and, under the given names, the text without its shared lines, the number of lines before
    and the number of lines dropped. A name that the documents use already gets a line in front."""
    if min_chars < 1 or min_docs < 1:
        raise ValueError("min_chars and min_docs must be at least 1")
    scratch = Scratch(docs.sparkSession, "lines")
    keys = scratch.table(_keys(docs, id_col, text_col, min_chars))
    shared = scratch.table(shared_lines(keys, min_docs))
    # Merged joins deal both sides out by hash; Spark splits the partition of a line that very many documents hold.
    gone = keys.hint("merge").join(shared.hint("merge"), ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    th, key, own, lost = unused(docs, "text_hash_", "key_", "own_", "lost_")
    # A document's list holds its own lines only. Equal rows have equal lists.
    lists = gone.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).agg(F.collect_set(F.struct("a", "b")).alias(lost))
    lists = scratch.table(lists)
    marked = docs.withColumn(th, F.xxhash64(quoted(text_col)))
    joined = marked.join(lists, quoted(id_col).eqNullSafe(F.col(key)) & (F.col(th) == F.col(own)), "left")
    columns, text_at, list_at = docs.columns, joined.columns.index(text_col), joined.columns.index(lost)
    more = [StructField(n, t) for n, t in zip(unused(docs, *names), (StringType(), LongType(), LongType()), strict=True)]

    def cut(batches):
        for batch in batches:
            texts, lists = batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(list_at)
            kept, n_lines, n_dropped = [], [], []
            for n, text in enumerate(texts):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if lists[n].is_valid:
                    pairs = lists[n].values
                    pairs = zip(pc.struct_field(pairs, 0).to_pylist(), pc.struct_field(pairs, 1).to_pylist(), strict=True)
                    drop = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in pairs}
                    lines = [x for x in lines if line_hash(x, min_chars) not in drop]
                kept.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], [*columns, *(f.name for f in more)])

    return map_batches(joined, cut, StructType([*docs.schema, *more]))
