"""Token ids of whole texts from a file of the tokenizers library.

A word-level cache does most of the work: the vocabularies here never join ids across white space, so a text's ids are the
ids of its words. Words are encoded once a batch and looked up as arrays."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The cache starts anew beyond so many words or ids.
CACHE_WORDS, CACHE_IDS = 200_000, 2_000_000
#: Parts of words up to this length are kept, too: marks, and the short words that stand beside them.
SHORT = 4


def _byte_signs() -> dict[int, int]:
    """Bytes that byte-level vocabularies write as another sign: those that are no visible Latin-1 character take the code points from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + i for i, b in enumerate(hidden)}


#: Bytes of a word of letters that is merged with others of its length; longer ones go to the library by themselves.
MERGED_BYTES = 48
#: No merge.
_NONE = np.int32(2**31 - 1)


class Merger:
    """Ids of words, many at a time: in each round every word merges its pair of the lowest rank, the leftmost of them, as the library does."""

    def __init__(self, model: dict, signs: dict[int, int]) -> None:
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end, sign = model["end_of_word_suffix"], [chr(signs.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab.get(c + e, -1) for c in sign], np.int64) for e in ("", end))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        #: Merges by rank, hashed with open places: a pair is searched from its place on until a free one.
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        keys, left, step = self._key(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs)), 0
        while left.size:
            at = self._place(keys[left], step)
            there, first = np.unique(at, return_index=True)
            first = first[self.keys[there] < 0]
            self.keys[at[first]], self.ranks[at[first]] = keys[left[first]], left[first]
            left, step = np.delete(left, first), step + 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a << 32) | b

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        hashed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (hashed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; _NONE if there is none, as for the -1 behind a word."""
        keys = self._key(a, b)
        out, left, step = np.full(keys.shape, _NONE, np.int32), np.flatnonzero((a >= 0) & (b >= 0)), 0
        while left.size:
            at = self._place(keys[left], step)
            found = self.keys[at]
            same = found == keys[left]
            out[left[same]] = self.ranks[at[same]]
            left, step = left[~same & (found >= 0)], step + 1
        return out

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, filled up with -1, with all merges done."""
        done, rows, (n, width) = ids.copy(), np.arange(len(ids)), ids.shape
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        columns = np.arange(width)
        while rows.size:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            live = best < _NONE
            if not live.all():
                done[rows[~live]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not rows.size:
                    break
            every = np.arange(len(rows))
            ids[every, at] = self.made[best]
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ranks[every, at] = self._rank(ids[every, at], ids[every, np.minimum(at + 1, width - 1)])
            some = np.flatnonzero(at)
            ranks[some, at[some] - 1] = self._rank(ids[some, at[some] - 1], ids[some, at[some]])
        return done

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and numbers of the ids of each word in the third array. Words have at least one byte."""
        words = pa.concat_arrays([words.cast(pa.string())])  # without an offset
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
        content, lengths = np.frombuffer(words.buffers()[2], np.uint8), np.diff(ends)
        order, flat, total = np.argsort(lengths, kind="stable"), [], 0
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for some in np.array_split(order, max(1, len(order) // 4096)):
            columns = np.arange(lengths[some].max())
            within = columns < lengths[some][:, None]
            content_of = content[np.where(within, ends[some][:, None] + columns, 0)]
            ids = np.where(within, self.inner[content_of], -1)
            every, end = np.arange(len(some)), lengths[some] - 1
            ids[every, end] = self.last[content_of[every, end]]
            ids = self._merged(ids)
            used = ids >= 0
            sizes[some] = used.sum(axis=1)
            starts[some] = total + np.cumsum(sizes[some]) - sizes[some]
            flat.append(ids[used].astype(np.uint32))
            total += len(flat[-1])
        return starts, sizes, np.concatenate(flat)


class WordEncoder:
    """Ids of a BPE with word ends that drops white space; without such a file, use the tokenizers library itself."""

    def __init__(self, model: str, literal: bool = False) -> None:
        """model: the content of the file, so that executors need no copy of it. The strings of special tokens in a text are read as
        these tokens, as the library does by default; literal: as the characters they are."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        content = json.loads(model)
        if not content["model"].get("end_of_word_suffix"):
            raise ValueError("the file is no BPE with word ends")
        added = [] if literal else content["added_tokens"]
        if any(not t["special"] or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("the file has added tokens that are not plain special ones")
        self.special = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.whole = Tokenizer.from_str(model)
        self.whole.encode_special_tokens = True
        self.model, self.signs = self.whole.model, _byte_signs()
        # Of ASCII and the letters of Latin-1 it is known how the tokenizer cuts them; everything else goes through all of it.
        self.plain = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+").findall
        self.merger = Merger(content["model"], self.signs)
        usual = "a-z\xdf-\xf6\xf8-\xff"
        self.letters = f"^[{usual}\xc0-\xd6\xd8-\xde]+$"
        self.before_mark = f"([{usual}])([.,])"
        # All letters have ids, and no merge can be made from two pairs, so that ranks tell all.
        sure = content["model"].get("unk_token") is None and not content["model"].get("dropout") and not content["model"].get("ignore_merges")
        self.sure = sure and min(self.merger.inner.min(), self.merger.last.min()) >= 0 and len(np.unique(self.merger.made)) == len(self.merger.made)
        self._clear()

    def _clear(self) -> None:
        self.short: dict[str, list[int]] = {}
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _plain_ids(self, word: str) -> list[int]:
        out, short = [], self.short
        for part in self.parts(word.lower()):
            ids = short.get(part)
            if ids is None:
                sign = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
                ids = [t.id for t in self.model.tokenize(sign)]
                if len(part) <= SHORT:
                    short[part] = ids
            out += ids
        return out

    def _learn(self, words: pa.Array) -> None:
        """Takes words into the cache: those of letters together, the others one by one."""
        if not len(words):
            return
        alone = pc.and_(pc.match_substring_regex(words, self.letters), pc.less_equal(pc.binary_length(words), MERGED_BYTES))
        alone = alone.to_numpy(zero_copy_only=False) if self.sure else np.zeros(len(words), bool)
        if alone.any():
            together = words.filter(pa.array(alone))
            self._keep(together.to_pylist(), *self.merger(pc.utf8_lower(together)))
        rest = words.filter(pa.array(~alone)).to_pylist()
        plain, ids_of = self.plain, self._plain_ids
        odd = [w for w in rest if not plain(w)]
        known = dict(zip(odd, (e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)), strict=True))
        ids = [known[w] if w in known else ids_of(w) for w in rest]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._keep(rest, np.cumsum(sizes) - sizes, sizes, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())))

    def _keep(self, words: list[str], starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + starts))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers; null is empty."""
        if len(self.index) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self._clear()
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if self.special and pc.any(pc.match_substring_regex(column, self.cut.pattern)).as_py():
            return self._around_special(column.to_pylist())
        return self._encode_plain(column)

    def _around_special(self, texts: list[str]) -> list[np.ndarray]:
        """Special tokens split a text before anything else; the parts between them are texts of their own."""
        parts = [self.cut.split(t) for t in texts]
        between = iter(self._encode_plain(pa.array([x for p in parts for x in p[::2]], pa.string())))
        return [np.concatenate([next(between) if i % 2 == 0 else self.special[x] for i, x in enumerate(p)]) for p in parts]

    def _encode_plain(self, column: pa.Array) -> list[np.ndarray]:
        # A line end is white space like a blank, and what begins with a dot or comma behind a letter is a part of its own: fewer words to know.
        column = pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(column, self.before_mark, r"\1 \2"), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        index = self.index
        self._learn(coded.dictionary.filter(pa.array([w not in index for w in distinct], pa.bool_())))
        if collecting:
            gc.enable()
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        out = []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = at[start:end]
            sizes = self.sizes[own]
            last = np.cumsum(sizes)
            shift = np.repeat(self.starts[own] - last + sizes, sizes)
            out.append(self.flat[shift + np.arange(len(shift))])
        return out


#: Name of the module that holds encoders in a Python worker; functions of this package travel by value and keep nothing there.
_KEPT = "rowgate_kept_encoders"


def kept_encoder(model: str, literal: bool = False) -> WordEncoder:
    """The encoder of this Python worker. It stays for the worker's next tasks, so that they need not learn the same words."""
    kept = vars(sys.modules.setdefault(_KEPT, ModuleType(_KEPT))).setdefault("encoders", {})
    if (model, literal) not in kept:
        kept[model, literal] = WordEncoder(model, literal)
    return kept[model, literal]


def model_text(path: str) -> str:
    """Content of a tokenizer file on the driver, to be sent to the tasks; a few MB at most, which is checked."""
    size = os.path.getsize(path)
    if size > 32 << 20:
        raise ValueError(f"{path} has {size} bytes; a vocabulary of at most 32 MB is expected")
    with open(path, encoding="utf-8") as file:
        return file.read()
