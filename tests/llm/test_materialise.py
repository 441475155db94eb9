import glob
import sys
import tempfile
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rowgate.llm import materialise
from rowgate.llm.queries import op6_materialise

SF = "/root/testdata/sf0.001"
RANKS = materialise.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
END = 50256


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(size):
    one, other = (materialise.Permutation(size, key)(np.arange(size)) for key in (1, 2))
    assert sorted(one) == sorted(other) == list(range(size))
    assert size < 100 or (one != other).any()


@pytest.mark.parametrize("text", ["a b " * 60_000, " " * 250_000, "a" * 120_000, "a \n \n b  c\t" * 20_000, "é 日本 " * 50_000, "x" * 99_999 + "  \n  y z " * 5])
def test_cut_texts_have_the_same_ids(text):
    pieces = list(materialise._pieces(text))
    assert "".join(pieces) == text
    if not (text.isspace() or len(text.split()) == 1):
        assert [i for p in pieces for i in CODER.encode_ordinary(p)] == CODER.encode_ordinary(text)


def test_plain_texts_need_no_look_ahead(monkeypatch):
    made, real = [], tiktoken.Encoding
    monkeypatch.setattr(tiktoken, "Encoding", lambda *a, **b: made.append(b["pat_str"]) or real(*a, **b))
    texts = ["", "one", " it's 3 o'clock!?\n'tis\u3000日本 ", "\n", "x" * 150_000 + " y z ", *(f"{c}a{c}b1{c}.{c}" for c in "\t\r\u0085\u00a0\u2028")]
    encode = materialise.Encoder(dict(RANKS), public_tokenizers.PATTERN)
    got = [[i for p in pieces for i in p] for pieces in encode(pa.array([*texts, None]))]
    assert got == [CODER.encode_ordinary(t) for t in texts] + [[]]
    assert made and not any("(?!" in p for p in made)


def test_ids_come_as_arrays_and_no_special_token_is_read():
    texts = [materialise._UNREAD, f"é{materialise._UNREAD} {materialise._UNREAD * 2}日 <|unread", "<|endoftext|> a  b", f"  {materialise._UNREAD}\n\n"]
    got = [list(pieces) for pieces in materialise.Encoder(dict(RANKS), public_tokenizers.PATTERN)(pa.array(texts))]
    assert all(isinstance(p, np.ndarray) for pieces in got for p in pieces)
    assert [np.concatenate(pieces).tolist() for pieces in got] == [CODER.encode_ordinary(t) for t in texts]


def test_white_space_of_any_kind_is_cut_as_the_pattern_says():
    signs = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf")]
    texts = [t for c in signs for t in (c, c * 2, f"a{c}{c}b", f"a{c} b", f"a {c}b", f"a{c}\n{c}", f"{c}.{c}'s{c}{c}")]
    encode = materialise.Encoder(dict(RANKS), public_tokenizers.PATTERN)
    assert [[i for p in pieces for i in p] for pieces in encode(pa.array(texts))] == [CODER.encode_ordinary(t) for t in texts]
    other = r"\S+|\s"
    plain = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=dict(RANKS), special_tokens={})
    assert [[i for p in pieces for i in p] for pieces in materialise.Encoder(dict(RANKS), other)(pa.array(["a b  c"]))] == [plain.encode_ordinary("a b  c")]


def stream(texts, length):
    """The ids of one task, cut by hand."""
    ids = [i for t in texts for i in [*CODER.encode_ordinary(t or ""), END]]
    return [(len(ids[a : a + length]), (ids[a : a + length] + [END] * length)[:length]) for a in range(0, len(ids), length)]


def written(spark, docs, length, records, key=5):
    path = tempfile.mkdtemp(prefix="shards-") + "/out"
    return materialise.materialise(docs, path, RANKS, public_tokenizers.PATTERN, END, key, length=length, shard_records=records)


def test_shards_hold_every_sequence_at_its_slot(spark):
    texts = [None, "", "one two three " * 40, "same", "same", "Ünï çödé\n", "word " * 700]
    docs = spark.createDataFrame([(t, 1, "x") for t in texts], "text string, slot int, record string").coalesce(1)
    shards = written(spark, docs, 16, 10)
    expected = stream(texts, 16)
    assert shards.sequences == len(expected)
    slots = materialise.Permutation(len(expected), 5)(np.arange(len(expected)))
    got = {r.slot: r for r in materialise.read_records(spark, shards).collect()}
    assert sorted(got) == list(range(len(expected)))
    for slot, (used, ids) in zip(slots.tolist(), expected, strict=True):
        r = got[slot]
        assert (r.shard, r.byte_offset, r.n_tokens) == (slot // 10, slot % 10 * materialise.stride(16), used)
        assert np.frombuffer(r.ids, "<u2").tolist() == ids
    # A reader may start anywhere: the bytes at a record's place are the record.
    for shard in range(-(-len(expected) // 10)):
        (path,) = glob.glob(f"{shards.path}/shard={shard}/part-*")
        data = np.memmap(path, materialise.record_type(16))
        assert len(data) == min(10, len(expected) - shard * 10)
        assert data["ids"][-1].tobytes() == got[shard * 10 + len(data) - 1].ids


def test_several_tasks_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    shards = written(spark, docs, 128, 50)
    got = materialise.read_records(spark, shards).collect()
    assert [r.slot for r in sorted(got)] == list(range(shards.sequences))
    total = sum(len(CODER.encode_ordinary(r.text)) + 1 for r in docs.collect())
    assert sum(r.n_tokens for r in got) == total
    none = written(spark, docs.limit(0), 128, 50)
    assert none.sequences == 0 and materialise.read_records(spark, none).count() == 0


def test_query_reads_back_all_ids(spark):
    got = op6_materialise(spark, SF).collect()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = Counter((n, zlib.crc32(np.array(ids, "<u2").tobytes())) for n, ids in stream(texts, 2048))
    assert Counter((r.n_tokens, r.ids_crc32) for r in got) == expected
    assert sorted(r.slot for r in got) == list(range(len(got)))
