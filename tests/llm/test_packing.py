import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowgate.llm import packing, tokens
from rowgate.llm.queries import op8_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)  # as the contract calls it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(tokens.model_text(PATH))


ODD = ["", " ", "  a  b ", "It's THE end\n\n of\tx2y22 ###!! don't", "Éàß ǅ İI ſ ΑΣ Σ", "á e ́b", "\x00\x1c a\x85b c", "<|endoftext|> <|startoftext|>",
       "A<|endoftext|>b<|ENDOFTEXT|> <|StartOfText|>'s", "<|endoftext|><|endoftext|>  e<|startoftext|>́", "<|endoftext| >", "<|endoftext|>" * 300,
       "日本語 テスト １２３ ²½ Ⅷ", "🙂🙂 a🙂b", "x" * 5000, "'s 'S 'll'd", "a b　c", "\r\n\v\f", "3.14 1,000 a_b __"]


def test_ids_are_those_of_the_library(encoder, library, spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library(text)


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*" '\n\tsSlLaA1.É", *SPECIAL]))).map("".join))
def test_ids_of_any_text(text):
    if not hasattr(test_ids_of_any_text, "both"):
        pairs = []
        for literal in (False, True):
            t = Tokenizer.from_file(PATH)
            t.encode_special_tokens = literal
            pairs.append((tokens.WordEncoder(tokens.model_text(PATH), literal), t))
        test_ids_of_any_text.both = pairs
    for ours, t in test_ids_of_any_text.both:
        assert ours.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_of_letters_are_merged_together(encoder, library):
    """Words of one to 48 bytes, with repeated letters and of Latin-1, with marks and line ends beside them, have the library's ids; no call per word."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abelnrsta\xe9\xe8\xdf" if i % 3 else "aab"), 1 + i % 30)) for i in range(3000)] + ["x" * 48, "é" * 24, "é" * 25]
    own = tokens.WordEncoder(tokens.model_text(PATH))
    singly = []
    own._plain_ids = lambda word: singly.append(word) or encoder._plain_ids(word)
    text = "".join(w + (" ", ". ", ",\n", "\n")[i % 4] for i, w in enumerate(words[:-1]))
    assert own.encode([text, None, words[0]])[0].tolist() == library(text)
    assert set(singly) <= {"", ".", ","}
    assert encoder.encode([words[-1], "ÉÖ É.", "a.,b .c,,d"])[0].tolist() == library(words[-1])
    assert encoder.encode(["a.,b .c,,d it's. 's, é.,É., ."])[0].tolist() == library("a.,b .c,,d it's. 's, é.,É., .")


def check(rows, texts, library, most):
    """Pieces cover each document once, sequences are gapless and full or a power of two."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids, at = [*library(texts[d]), 2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            piece = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(piece))
            at += p.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= most and (at == most or at & (at - 1) == 0)
    return seqs


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op8_packing(spark, SF).collect(), texts, library, 4096)


@pytest.mark.parametrize(("most", "segments", "loss"), [(64, 3, 64), (64, 100, 40), (100, 2, 100), (1, 1, 1)])
def test_limits_and_odd_rows(spark, library, most, segments, loss):
    texts = {i: t for i, t in enumerate([None, "", *ODD, "word " * 300, "same", "same"])}
    texts[None] = "without an id"
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in texts.items()], "doc_id bigint, text string, start int, ids string").repartition(3)
    pieces = packing.pack(docs, PATH, max_tokens=most, max_segments=segments, max_loss_tokens=loss)
    rows = packing.piece_digests(pieces).collect()
    full = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        full[r.sequence_id][0] += r.length
        full[r.sequence_id][1] += 1
        full[r.sequence_id][2] += r.length - (r.start == 0)
    assert all(t <= most and n <= segments and b <= loss for t, n, b in full.values())
    if most & (most - 1) == 0:
        check(rows, texts, library, most)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two")], "doc_id bigint, text string")
    rows = packing.piece_digests(packing.pack(docs, PATH)).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("most", "loss"), [(256, 24), (64, 64), (128, 1)])
def test_instruction_data_under_a_loss_limit(spark, library, most, loss):
    """Only the loss limit binds where answers are long for it; each piece bears the loss of its document's last ids that it holds."""
    rows = [(i, "prompt word " * (i % 20) + "answer " * (i % 7), i % 7 + 1) for i in range(300)] + [(300, "all prompt " * 90, 0), (301, "answer " * 500, 9999), (302, "a b", -4), (303, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, answer int").repartition(2)
    found = packing.piece_digests(packing.pack(docs, PATH, max_tokens=most, max_loss_tokens=loss, loss_col="answer")).collect()
    check(found, {d: t for d, t, _ in rows}, library, most)
    of, given = {r.doc_id: r.doc_tokens for r in found}, {d: n for d, _, n in rows}
    free = {d: 1 if given[d] is None else of[d] - min(max(given[d], 0), of[d]) for d in of}
    total = defaultdict(int)
    for r in found:
        total[r.sequence_id] += max(0, r.start + r.length - max(r.start, free[r.doc_id]))
    assert max(total.values()) <= loss and sum(total.values()) == sum(of[d] - free[d] for d in of)
    if loss == 24:
        assert len(total) > 2 * sum(of.values()) / most  # sequences end long before the token limit
