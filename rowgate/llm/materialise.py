"""Token ids in training order, as binary shards of fixed stride.

Documents become ids, each with an end id, and the ids of a task are cut into sequences of a fixed length (the last one of a task is padded).
A keyed Feistel network over the smallest even number of bits that holds all sequences permutes their global numbers; numbers beyond the last one walk on
along their cycle. The result is the sequence's slot. Ranges of slots are shards, and Spark writes each as one file of equal records:

    ids in use (4 bytes, little-endian) | ids (2 bytes each, little-endian) | newline

so slot s is record s mod shard_records of shard s div shard_records, and a reader can start anywhere. Ids are made twice, once to
count sequences and once to write them; a task that finds another number than was counted fails. Nearly all of the time goes into cutting
texts by the tokenizer's pattern and merging; where a pattern without a look ahead cuts a text the same way, it is taken.

Defined results: a null or empty text is the end id alone; texts are taken whole; repeated rows are repeated; ids of documents and other
columns are not looked at; an empty table gives no shard."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.llm.common import map_batches, quoted

ROUNDS = 6
#: Characters that the tokenizer gets at a time; longer texts are cut before a blank that follows no white space.
_CUT = 100_000


class Permutation:
    """Keyed bijection of 0 ... size - 1."""

    def __init__(self, size: int, key: int) -> None:
        self.size, self.half = size, max(1, -(-max(1, size - 1).bit_length() // 2))
        state, keys = key % (1 << 64), []
        for _ in range(ROUNDS):
            state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
            keys.append(int(_mixed(np.array([state], np.uint64))[0]))
        self.keys = [np.uint64(k) for k in keys]

    def _once(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for key in self.keys:
            left, right = right, left ^ (_mixed(right ^ key) & mask)
        return (left << half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        out = self._once(numbers.astype(np.uint64))
        while (beyond := np.flatnonzero(out >= self.size)).size:
            out[beyond] = self._once(out[beyond])
        return out.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator; the round function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stride(length: int) -> int:
    return 4 + 2 * length + 1


def record_type(length: int) -> np.dtype:
    return np.dtype([("used", "<u4"), ("ids", "<u2", (length,)), ("end", "u1")])


def vocabulary(path: str) -> list[tuple[bytes, int]]:
    """Ranks of a byte-level vocabulary, read on the driver and sent to the tasks; its size is checked."""
    if os.path.getsize(path) > 32 << 20:
        raise ValueError(f"{path} is larger than 32 MB")
    with open(path, "rb") as file:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, file)]


def _pieces(text: str):
    """The text in pieces that do not change its ids."""
    at = 0
    while len(text) - at > _CUT:
        cut = at + _CUT
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1].isspace():
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: A usual pattern, and one that cuts in the same places where no two characters of white space meet, in little more than half the time.
PATTERN, PLAIN_PATTERN = rf"{_WORDS}|\s+(?!\S)|\s+", rf"{_WORDS}|\s+"
#: Two characters of white space, as these patterns know it.
_RUN = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
#: A special token that no text is read for: without any, the library's call that gives arrays tries one at every character.
_UNREAD = "<|unread|>"


class Encoder:
    """Ids of texts; coders are made when they are first needed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.coders = ranks, pattern, {}

    def _coder(self, pattern: str):
        if pattern not in self.coders:
            import tiktoken

            unread = {_UNREAD: 1 + max(self.ranks.values())}
            coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=unread)
            self.coders[pattern] = partial(coder.encode_to_numpy, disallowed_special=())
        return self.coders[pattern]

    def __call__(self, texts: pa.Array):
        """For each text the ids of its pieces, as arrays; null is empty."""
        texts = texts.fill_null("")
        plain = pc.invert(pc.match_substring_regex(texts, _RUN)).to_pylist() if self.pattern == PATTERN else [False] * len(texts)
        for text, is_plain in zip(texts.to_pylist(), plain, strict=True):
            encode = self._coder(PLAIN_PATTERN if is_plain else self.pattern)
            yield map(encode, _pieces(text))


def _sequences(texts, encode: Encoder, end_id: int, length: int):
    """Full sequences of a stream of texts, then the rest."""
    kept, end = np.zeros(0, "<u2"), np.array([end_id], "<u2")
    for batch in texts:
        parts = [kept]
        for pieces in encode(batch):
            parts += (p.astype("<u2") for p in pieces)
            parts.append(end)
        every = np.concatenate(parts)
        full = len(every) - len(every) % length
        yield every[:full].reshape(-1, length), length
        kept = every[full:]
    if len(kept):
        yield np.concatenate((kept, np.full(length - len(kept), end_id, "<u2"))).reshape(1, length), len(kept)


@dataclass
class Shards:
    """What was written: a reader needs nothing else."""

    path: str
    sequences: int
    length: int
    shard_records: int


def materialise(
    docs: DataFrame, path: str, ranks: list[tuple[bytes, int]], pattern: str, end_id: int, key: int, text_col: str = "text", length: int = 2048,
    shard_records: int = 8192,
) -> Shards:
    """Writes the shards below path (shard=0, shard=1, ...), which must not exist."""
    if end_id > 0xFFFF or max((r for _, r in ranks), default=0) > 0xFFFF:
        raise ValueError("ids must fit 16 bits")
    spark, texts = docs.sparkSession, docs.select(quoted(text_col).cast("string").alias("t"))
    sent = spark.sparkContext.broadcast(dict(ranks))  # read once by each Python worker, not by each task

    def cut(batches):
        return _sequences((b.column(0) for b in batches), Encoder(sent.value, pattern), end_id, length)

    def counted(batches):
        encode = Encoder(sent.value, pattern)
        ids = sum(1 + sum(map(len, pieces)) for b in batches for pieces in encode(b.column(0)))
        n = -(-ids // length)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], ["part", "n"])

    counts = dict(map(tuple, map_batches(texts, counted, "part bigint, n bigint").collect()))
    total, first = 0, {}
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    if not total:
        return Shards(path, 0, length, shard_records)
    permutation = Permutation(total, key)

    def placed(batches):
        part, done = TaskContext.get().partitionId(), 0
        for block, used in cut(batches):
            if len(block):
                number = first.get(part, 0) + done + np.arange(len(block))
                done += len(block)
                if done > counts.get(part, 0):
                    raise RuntimeError("the input has changed since it was counted")
                records = np.zeros(len(block), record_type(length))
                records["used"], records["ids"], records["end"] = used, block, 10
                data = [r.tobytes()[:-1] for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(permutation(number)), pa.array(data, pa.binary())], ["slot", "record"])
        if done != counts.get(part, 0):
            raise RuntimeError("the input has changed since it was counted")

    shard = F.floor(F.col("slot") / shard_records).cast("int")
    rows = map_batches(texts, placed, "slot bigint, record binary").withColumn("shard", shard)
    shards = -(-total // shard_records)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    rows.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)
    return Shards(path, total, length, shard_records)


def read_records(spark: SparkSession, shards: Shards) -> DataFrame:
    """Every record as it lies in the files: slot, shard, byte_offset, n_tokens (ids in use) and ids (little-endian, 2 bytes each)."""
    schema = "slot bigint, shard bigint, byte_offset bigint, n_tokens bigint, ids binary"
    if not shards.sequences:
        return spark.createDataFrame([], schema)
    kind, records = record_type(shards.length), shards.shard_records
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(shards.path)
    files = files.select(F.regexp_extract("path", "shard=([0-9]+)/", 1).cast("bigint").alias("shard"), "content")

    def parsed(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), kind)
                for at in range(0, len(data), 1024):
                    some = data[at : at + 1024]
                    number = np.arange(at, at + len(some))
                    columns = [pa.array(shard * records + number), pa.array(np.full(len(some), shard)), pa.array(number * kind.itemsize), pa.array(some["used"].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in some["ids"]], pa.binary())], ["slot", "shard", "byte_offset", "n_tokens", "ids"])

    return map_batches(files, parsed, schema)
