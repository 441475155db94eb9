"""SimHash near-duplicates, found by multi-index hashing.

Fingerprints have 64 bits, one for each bit position that is set in over half of a text's shingle hashes. A fingerprint
is cut into segments. Two fingerprints within `radius` bits have a segment in which they differ in at most
radius // segments bits, so a table keyed by segment value is asked for all keys of that small Hamming ball, and the
matches are verified on all 64 bits inside the join. Equal fingerprints are one node throughout: copies are never paired.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; texts with fewer words than
a shingle are hashed as a whole; repeated rows and ids give a row each; null ids keep their row and do not count for the
smallest id; an empty table gives an empty result. Other columns of the input are not looked at."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch, map_batches, match, quoted, unused
from rowgate.llm.components import components

SEED = 42
BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time; bounds the memory for one very long text.
_BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, width: int):
    """Hashes of the shingles of `width` words of a UTF-8 text, in blocks. bytes.split() cuts at 09-0D and 20 only."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")


def fingerprint(text: bytes | None, width: int) -> np.uint64:
    """Fingerprint of a UTF-8 text from its shingles of `width` words."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
        total += len(hashes)
    return np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; fp holds the 64 bits as a bigint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    narrow = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).cast("binary").alias("t"))
    return map_batches(narrow, hashed, f"doc_id {kind}, text_hash bigint, fp bigint")


def links(fps: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints that differ in at most `radius` bits. Input: distinct fp."""
    if BITS % segments or not 0 <= radius < BITS:
        raise ValueError("segments must divide 64 and radius must be below 64")
    size = BITS // segments
    ball = [sum(1 << i for i in at) for r in range(radius // segments + 1) for at in combinations(range(size), r)]
    mask = (1 << size) - 1
    cut = [F.shiftrightunsigned("fp", s * size).bitwiseAND(F.lit(mask if size < BITS else -1)) for s in range(segments)]
    parts = fps.select("fp", F.posexplode(F.array(*cut)).alias("s", "key"))
    table = parts.select("s", "key", F.col("fp").alias("b"))
    masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in ball])
    asked = parts.select("s", F.col("fp").alias("a"), "key", F.explode(masks).alias("m"))
    asked = asked.select("s", "a", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    # Merged, never broadcast: Spark takes the enumerated side to be as small as the file that it comes from.
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return asked.hint("merge").join(table.hint("merge"), ["s", "key"]).where(near).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, segments: int = 2
) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, root (smallest fingerprint of the class, as a signed number) and
    component_id (smallest doc_id of the class)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, id_col, text_col, width))
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = scratch.table(components(links(nodes.select("fp"), radius, segments)))
    classes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = classes.join(first, "root").select("fp", "root", "component_id")
    return rows.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Callable = near_duplicates, **how) -> DataFrame:
    """The documents with all their columns, one of each class: the one with the smallest id (null ids last), of repeated
    rows any one. The choice is made on narrow rows; the texts are only asked whether they were chosen. `classes` gives
    doc_id, text_hash and root of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = classes(docs, id_col, text_col, **how)
    keys = scratch.table(found.groupBy("doc_id", "text_hash").agg(F.min("root").alias("root"), F.count("*").alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = keys.groupBy("root").agg(F.min(place).alias("first"))
    th, key, own, n = unused(docs, "text_hash_", "key_", "own_", "copy_")
    names = [F.col("doc_id").alias(key), F.col("text_hash").alias(own)]
    judged = keys.join(first, "root").withColumn("chosen", F.col("first").eqNullSafe(place))
    gone = scratch.table(judged.where("NOT chosen").select(*names))
    same = quoted(id_col).eqNullSafe(F.col(key)) & (F.col(th) == F.col(own))
    kept = match(docs.withColumn(th, F.xxhash64(quoted(text_col))), gone, same, "left_anti")
    repeated = scratch.table(judged.where("chosen AND n > 1").select(*names))
    if repeated.isEmpty():
        return kept.drop(th)
    copies = Window.partitionBy(quoted(id_col), F.col(th)).orderBy(F.col(th))
    one = match(kept, repeated, same, "left_semi").withColumn(n, F.row_number().over(copies)).where(F.col(n) == 1).drop(n)
    return match(kept, repeated, same, "left_anti").unionAll(one).drop(th)
