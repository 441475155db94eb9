"""Vector bin packing of documents into training sequences.

An example has three sizes: tokens, segments (one) and loss-bearing tokens, which are its last ones: an answer behind a prompt. Their number is given by
a column of instruction data; without it, all tokens but a document's first bear loss. A sequence has a limit on each size. One sequence is open at a time; of the waiting pieces that fit, the one whose sizes have the largest dot product with
what is left of the limits goes in, each size as a share of its limit. When none fits, the best of the rest is cut at the
free tokens. A sequence that must end below the limit (by the number of segments, or at a task's end) is cut into lengths that are
powers of two, so nothing is padded. Every task packs its own input in a stream; nothing is shuffled, and a repeated task gives the same rows.

Defined results: a null or empty text is the end id alone; a null number of loss-bearing tokens means all but the first, numbers outside 0 to the
document's length count as the nearest of these; strings of special tokens in a text are these tokens, as the library reads them; repeated rows and ids are packed each; a null id is kept; an empty table
gives no rows. Other columns of the input are not looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import map_batches, quoted
from rowgate.llm.tokens import kept_encoder, model_text

#: Pieces that wait for a sequence in a task; more only widens the choice.
WAITING = 512


class Packer:
    """Packs pieces (document, start, ids, all tokens of the document, its first token with loss) in the order of their arrival."""

    def __init__(self, tokens: int, segments: int, loss: int, first: int) -> None:
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.next = first
        self.waiting: list[tuple] = []
        self.sizes = np.zeros((0, 3))
        self.open: list[tuple] = []
        self.left = self.limits.copy()

    @staticmethod
    def _size(piece: tuple) -> tuple[int, int, int]:
        _, start, ids, _, free = piece
        return len(ids), 1, len(ids) - min(len(ids), max(0, free - start))

    @staticmethod
    def _most(start: int, free: int, tokens: float, loss: float) -> int:
        """Tokens from `start` on that fit into what is left."""
        return int(min(tokens, loss + max(0, free - start)))

    def _close(self, whole: bool) -> list[tuple]:
        """Rows of the open sequence; if it is not full, cut into powers of two."""
        total = sum(len(p[2]) for p in self.open)
        cuts = [total] if whole else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        rows, rest = [], self.open[::-1]
        for room in cuts:
            offset = 0
            while offset < room:
                doc, start, ids, of, free = rest.pop()
                n = min(len(ids), room - offset)
                rows.append((doc, start, ids[:n], of, self.next, offset))
                if n < len(ids):
                    rest.append((doc, start + n, ids[n:], of, free))
                offset += n
            self.next += 1
        self.open, self.left = [], self.limits.copy()
        return rows

    def add(self, doc, ids: np.ndarray, loss: int | None = None) -> list[tuple]:
        """Takes a document, of which the last `loss` tokens bear loss, and returns the rows of the sequences that it fills by itself."""
        of, start, rows = len(ids), 0, []
        free = 1 if loss is None else of - min(max(loss, 0), of)
        while start < of:
            n = self._most(start, free, self.limits[0], self.limits[2])
            if n > of - start or n == of - start < self.limits[0]:
                self.waiting.append((doc, start, ids[start:], of, free))
                break
            held, self.open = self.open, [(doc, start, ids[start : start + n], of, free)]
            left = self.left
            rows += self._close(n == self.limits[0])
            self.open, self.left = held, left
            start += n
        return rows

    def pack(self, leave: int) -> list[tuple]:
        """Packs until at most `leave` pieces wait."""
        rows, waiting = [], self.waiting
        sizes = np.array([self._size(p) for p in waiting], np.float64).reshape(-1, 3) / self.limits
        live = np.ones(len(waiting), bool)
        n = len(waiting)
        while n > leave:
            room = self.left / self.limits
            fits = live & (sizes <= room + 1e-12).all(axis=1)
            score = sizes @ room
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1)))
                self._place(waiting[i])
                live[i], n = False, n - 1
            else:
                i = int(np.argmax(np.where(live, score, -1)))
                doc, start, ids, of, free = waiting[i]
                cut = self._most(start, free, self.left[0], self.left[2])
                self._place((doc, start, ids[:cut], of, free))
                waiting[i] = (doc, start + cut, ids[cut:], of, free)
                sizes[i] = np.array(self._size(waiting[i])) / self.limits
            if self.left.min() < 1:
                rows += self._close(self.left[0] == 0)
        self.waiting = [p for p, there in zip(waiting, live, strict=True) if there]
        return rows

    def _place(self, piece: tuple) -> None:
        self.open.append(piece)
        self.left -= np.array(self._size(piece), np.float64)

    def finish(self) -> list[tuple]:
        rows = self.pack(0)
        return rows + self._close(False) if self.open else rows


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    max_tokens: int = 4096, max_segments: int = 256, max_loss_tokens: int = 4096, loss_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset. Pieces of a sequence lie side by side from offset 0; a sequence has max_tokens ids or a power of two. `loss_col` names the
    column that tells how many of a document's last ids, with its end id, bear loss."""
    if min(max_tokens, max_segments, max_loss_tokens) < 1:
        raise ValueError("limits must be at least 1")
    kind, model = docs.schema[id_col].dataType.simpleString(), model_text(tokenizer)

    def packed(batches):
        encoder = kept_encoder(model)
        packer = Packer(max_tokens, max_segments, max_loss_tokens, TaskContext.get().partitionId() << 40)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            rows = []
            for doc, ids, loss in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows += packer.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4"), loss)
                if len(packer.waiting) >= 2 * WAITING:
                    rows += packer.pack(WAITING)
            yield from tables(rows, id_type)
        if id_type is not None:
            yield from tables(packer.finish(), id_type)

    def tables(rows, id_type):
        for at in range(0, len(rows), 512):
            doc, start, ids, of, seq, offset = zip(*rows[at : at + 512], strict=True)
            big = [pa.array(x, pa.int64()) for x in (start, of, seq, offset)]
            names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
            data = pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc, id_type), big[0], data, *big[1:]], names)

    loss = quoted(loss_col).cast("bigint") if loss_col else F.lit(None).cast("bigint")
    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("t"), loss.alias("loss"))
    schema = f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_batches(narrow, packed, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids: length and CRC-32 in their place."""
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
