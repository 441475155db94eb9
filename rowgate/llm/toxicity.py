"""Toxicity by class-conditional Kneser-Ney models over letters.

Two models, toxic and ordinary, are estimated from labelled texts: interpolated Kneser-Ney of order `order`, with counts of their own at
the orders above `shared` and pooled counts of both classes from there down, so that rare expressions are smoothed by
the same shared backoff. Texts are lower-cased letters; everything else is one blank.

A text's log-likelihood ratio is a sum over its n-grams: of an n-gram that was seen, what its order adds to the next lower one, and of a context,
the ratio of the two backoff weights. These weights are computed as tables, from all labelled texts that are not held out. A fifth of
those texts, by a hash of the text, is not counted but fits the logistic that turns length-normalised ratios into a score.

Defined results: null texts and texts without a letter are scored from their length 0; with no label of either class all scores are 0;
labels other than 0 and 1 and labels or documents without an id are not learned from; of several labels of one id the largest counts; texts are
taken whole; repeated rows get a row each; null ids are kept; an empty table gives no rows. Other columns are not looked at."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch, map_batches, quoted
from rowgate.llm.langid import Letters

ORDER, SHARED = 4, 2
#: Bits of a symbol. Code points from 1024 on share 256 symbols.
SYMBOL = 10
#: Labels up to this many rows are broadcast (12 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: n-gram weights sent to the tasks at a time (12 bytes each); more are used in several passes.
WEIGHTS_AT_ONCE = 6_000_000
_BLOCK = 1 << 20


class Grams:
    """Packed n-grams of texts."""

    def __init__(self, order: int) -> None:
        self.letters, self.order = Letters(), order

    def blocks(self, texts: list[str | None]):
        """(symbols with blanks around each text, number of the text of each symbol) for blocks of texts."""
        at = 0
        while at < len(texts):
            parts, size, end = [], 0, at
            while end < len(texts) and (end == at or size < _BLOCK):
                codes = self.letters.codes(texts[end] or "")
                codes = codes[int(len(codes) > 0 and codes[0] == 0) :]
                parts.append(np.concatenate((np.zeros(self.order - 1, np.uint32), codes, np.zeros(int(not len(codes) or codes[-1] != 0), np.uint32))))
                size += len(parts[-1])
                end += 1
            every = np.concatenate(parts).astype(np.int64)
            every = np.where(every < 1024, every, 768 + every % 256)
            yield every, np.repeat(np.arange(at, end), [len(p) for p in parts])
            at = end

    def windows(self, symbols: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of `size` that end at a symbol of a text (not at the blanks before it), and their texts."""
        out = np.zeros(max(0, len(symbols) - size + 1), np.int64)
        for k in range(size):
            out = (out << SYMBOL) | symbols[k : k + len(out)]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        lead = np.zeros(len(symbols), bool)
        for k in range(self.order - 1):
            lead[first + k] = True
        real = ~lead[size - 1 :]
        return out[real], owner[size - 1 :][real]


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(g, t, o): how often each n-gram of the highest order is in toxic and in ordinary texts. Input: t, toxic."""

    def counted(batches):
        grams = Grams(order)
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for symbols, owner in grams.blocks(batch.column(0).to_pylist()):
                keys, whose = grams.windows(symbols, owner, order)
                both, n = np.unique(keys * 2 + toxic[whose], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(both & 1), pa.array(n)], ["g", "toxic", "n"])

    rows = map_batches(texts.select("t", "toxic"), counted, "g bigint, toxic bigint, n bigint")
    return rows.groupBy("g").agg(F.expr("sum(if(toxic = 1, n, 0)) AS t"), F.expr("sum(if(toxic = 0, n, 0)) AS o"))


def _context(g: str = "g") -> Column:
    return F.shiftright(g, SYMBOL)


def _context_mark(size: int) -> int:
    """Marks the contexts of n-grams of a size."""
    return 7 << 60 | 1 << SYMBOL * (size - 1)


def _suffix(size: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << SYMBOL * (size - 1)) - 1))


def _discount(table: DataFrame, columns: list[str]) -> float:
    """n1 / (n1 + 2 n2) from the numbers of n-grams counted once and twice."""
    n1, n2 = (reduce(lambda a, b: a + b, [F.sum((F.col(c) == k).cast("bigint")) for c in columns]) for k in (1, 2))
    one, two = table.agg(n1.alias("a"), n2.alias("b")).first()
    return one / (one + 2 * two) if one and two else 0.5


def weights(top: DataFrame, order: int, shared: int, scratch: Scratch) -> DataFrame:
    """(context, key, weight) from the counts of the highest order. Keys of n-grams have their size above bit 60 and weigh what the order
    adds to the next lower one; keys of contexts have 7 there, and weigh what holds for an n-gram that was not seen."""
    tables = {order: top}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many n-grams of the next order it is the end
        longer = tables[k + 1].withColumn("g", _suffix(k + 1))
        tables[k] = scratch.table(longer.groupBy("g").agg(F.expr("sum(if(t > 0, 1, 0)) AS t"), F.expr("sum(if(o > 0, 1, 0)) AS o"), F.count("*").alias("c")))
    total = tables[1].agg(F.sum("c")).first()[0]
    lower = tables[1].select("g", (F.col("c") / total).alias("p"))
    for k in range(2, shared + 1):
        d = _discount(tables[k], ["c"])
        contexts = tables[k].groupBy(_context().alias("h")).agg(F.sum("c").alias("sum"), F.count("*").alias("types"))
        now = tables[k].withColumns({"h": _context(), "s": _suffix(k)}).join(contexts, "h").join(lower.withColumnRenamed("g", "s"), "s")
        lower = now.select("g", F.expr(f"(greatest(c - {d}, 0) + {d} * types * p) / sum AS p"))
    lower = scratch.table(lower.select("g", F.col("p").alias("pt"), F.col("p").alias("po")))
    out = []
    for k in range(shared + 1, order + 1):
        d = _discount(tables[k], ["t", "o"])
        sums = [F.expr(f"sum({c}) AS {c}_sum") for c in "to"] + [F.expr(f"sum(if({c} > 0, 1, 0)) AS {c}_types") for c in "to"]
        back = [F.expr(f"if({c}_sum > 0, {d} * {c}_types / {c}_sum, 1D) AS {c}_back") for c in "to"]
        contexts = scratch.table(tables[k].groupBy(_context().alias("h")).agg(*sums).select("h", "t_sum", "o_sum", *back))
        now = tables[k].withColumns({"h": _context(), "s": _suffix(k)}).join(contexts, "h").join(lower.select(F.col("g").alias("s"), "pt", "po"), "s")
        p = [F.expr(f"if({c}_sum > 0, greatest({c} - {d}, 0) / {c}_sum, 0D) + {c}_back * p{c} AS q{c}") for c in "to"]
        now = scratch.table(now.select("g", "pt", "po", *p))
        seen = F.expr("ln(qt / qo) - ln(pt / po)").cast("float").alias("weight")
        mark = F.lit(_context_mark(k))
        out.append(now.select(_context().bitwiseOR(mark).alias("context"), F.col("g").bitwiseOR(F.lit(k << 60)).alias("key"), seen))
        context = F.col("h").bitwiseOR(mark)
        out.append(contexts.select(context.alias("context"), context.alias("key"), F.expr("ln(t_back / o_back)").cast("float").alias("weight")))
        lower = now.select("g", F.col("qt").alias("pt"), F.col("qo").alias("po"))
    return reduce(DataFrame.unionAll, out)


class Lookup:
    """Weights of packed n-grams: a table of slots by a multiplicative hash, with the keys of a slot side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, len(keys).bit_length() + 2)
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.zeros((1 << self.bits) + 1, np.int32)
        self.start[1:] = np.cumsum(np.bincount(slots, minlength=1 << self.bits))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, 0 where there is none, and where there is one."""
        out, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        slots = self._slot(keys)
        at, end = self.start[slots], self.start[slots + 1]
        left = np.flatnonzero(at < end)
        at, end, keys = at[left], end[left], keys[left]
        while len(left):
            hit = self.keys[at] == keys
            out[left[hit]], known[left[hit]] = self.values[at[hit]], True
            on = ~hit & (at + 1 < end)
            left, at, end, keys = left[on], at[on] + 1, end[on], keys[on]
        return out, known


def ratios(docs: DataFrame, table: DataFrame, order: int, shared: int) -> DataFrame:
    """Every row of docs(doc_id, t, ...) with `ratio`, its log-likelihood ratio, and `n`, its predicted symbols, without t."""
    size = table.count()
    passes = -(-size // WEIGHTS_AT_ONCE) or 1
    if passes == 1:
        return _pass(docs, table, order, shared)
    # Several passes, each with a share of the contexts and their n-grams: the sums of equal rows are equal, so they are added by row content,
    # which the other columns and 128 bits of hash tell.
    marked = docs.withColumn("h_", F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(passes), *docs.columns)))
    parts = [_pass(marked, table.where(F.pmod(F.hash("context"), F.lit(passes)) == i), order, shared).withColumn("i_", F.lit(i)) for i in range(passes)]
    rest = [c for c in docs.columns if c != "t"]
    once = reduce(DataFrame.unionAll, parts).groupBy("h_", "i_").agg(*[F.first(c).alias(c) for c in rest], F.first("ratio").alias("ratio"), F.first("n").alias("n"), F.count("*").alias("copies"))
    full = once.groupBy("h_").agg(*[F.first(c).alias(c) for c in rest], F.sum("ratio").alias("ratio"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    return full.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(*rest, "ratio", "n")


def _pass(docs: DataFrame, table: DataFrame, order: int, shared: int) -> DataFrame:
    got = table.select("key", "weight").toArrow()
    keys, values = (got.column(i).to_numpy() for i in (0, 1))
    sent = docs.sparkSession.sparkContext.broadcast((keys.astype(np.int64), values.astype(np.float32)))
    at = docs.columns.index("t")

    def summed(batches):
        grams, lookup = Grams(order), Lookup(*sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for symbols, owner in grams.blocks(texts):
                for size in range(shared + 1, order + 1):
                    found, whose = grams.windows(symbols, owner, size)
                    if size == order:
                        n += np.bincount(whose, minlength=len(texts))
                    weight, known = lookup.get(found | (size << 60))
                    new = np.flatnonzero(~known)
                    weight[new] = lookup.get((found[new] >> SYMBOL) | _context_mark(size))[0]
                    total += np.bincount(whose, weight, minlength=len(texts))
            kept = [(c, f) for i, (c, f) in enumerate(zip(batch.columns, batch.schema, strict=True)) if i != at]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], pa.array(total), pa.array(n)], [*[f.name for _, f in kept], "ratio", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "t")
    return map_batches(docs, summed, f"{schema}, ratio double, n bigint")


def _normalised() -> list[Column]:
    """What the logistic sees: the ratio by length, by its spread, and the length."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    return [F.col("ratio") / n, F.col("ratio") / F.sqrt(n), F.log(n)]


@dataclass
class Model:
    """table: n-gram weights; coefficients: of the logistic, its constant last."""

    order: int
    shared: int
    table: DataFrame
    coefficients: list[float]


def learn(
    docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    order: int = ORDER, shared: int = SHARED,
) -> Model | None:
    """Model from the labelled documents whose id is in training; None if a class has none."""
    if not 1 <= shared < order <= 6:
        raise ValueError("orders must satisfy 1 <= shared < order <= 6")
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull() & training(quoted(id_col)))
    marks = scratch.table(marks.groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).cast("bigint").alias("toxic")))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    texts = docs.where(training(quoted(id_col))).select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    known = texts.join(marks, "id").select("t", "toxic")
    held = F.pmod(F.xxhash64("t"), F.lit(5)) == 0
    top = scratch.table(count_grams(known.where(~held), order))
    if not all(top.agg(F.coalesce(F.sum("t"), F.lit(0)) > 0, F.coalesce(F.sum("o"), F.lit(0)) > 0).first()):
        return None
    table = scratch.table(weights(top, order, shared, scratch))
    checked = scratch.table(ratios(known.where(held), table, order, shared))
    if checked.agg(F.countDistinct("toxic")).first()[0] < 2:
        return Model(order, shared, table, [0.0, 1.0, 0.0, 0.0])
    rows = checked.select(array_to_vector(F.array(*_normalised())).alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=50, regParam=1e-4).fit(rows)
    return Model(order, shared, table, [*map(float, fitted.coefficients), float(fitted.intercept)])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, ratio (toxic against ordinary log-likelihood), n (letters and blanks) and score (0 to 1)."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("t"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("ratio"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("score"))
    found = ratios(rows, model.table, model.order, model.shared)
    *slopes, constant = model.coefficients
    margin = reduce(lambda a, b: a + b, [F.lit(c) * x for c, x in zip(slopes, _normalised(), strict=True)], F.lit(constant))
    return found.select("doc_id", "ratio", "n", (1 / (1 + F.exp(-margin))).alias("score"))
