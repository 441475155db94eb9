"""Ranked lexical search for many queries at once, with common subexpressions evaluated once.

Queries are a stated set. They are held in blocks of bounded size and each block meets all documents. Within a block, sets of terms that
several queries share are mined: terms that stand in the same queries form one set, then neighbouring sets that occur together in
several queries are joined, round after round, until no pair is shared. The result is a graph in which every set and every query is the sum of
others. For a number of documents at a time the accumulators of the sets are filled from the term counts once, the larger sets and the
queries are added up from them along the graph.

The texts are read once for each block: a document becomes its length and the counts of the block's terms, as a table in the shared folder. Numbers over
the corpus and document frequencies are taken from all rows of it. Each task keeps the best k documents of every query, which a
window over (query, bucket) and one over the query bring together; no task and no driver holds more than that.

score = sum over the query's different terms of w * ((10^9 * tf) div (1000 * tf + 20 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))), m =
50 + (50 * n * N) div L; N documents with a term, L terms in all, n terms of the document. Integers throughout, but for the logarithm.

Defined results: null, empty and termless documents and queries match nothing, and such documents do not count in N; documents with score 0 are
not listed; equal scores go by ascending id, null ids last; repeated documents take a rank each; equal (item, text) rows of the
queries are one query, and texts that differ under one item id are ranked each on its own; empty tables give no rows; of a very long text
only its words are held. Other columns of both inputs are not looked at."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch, map_batches, quoted

#: Results of a query; bytes of query text in one block; bytes of accumulators held at a time in a task.
TOP, BLOCK_BYTES, ACCUMULATOR_BYTES = 50, 1 << 18, 16 << 20
#: Groups into which the candidates of one query are dealt before its last ranking, and candidates a task holds before it trims them.
BUCKETS, HELD = 64, 200_000
#: ASCII: digits and letters, lower-cased, make terms; all else is blank. Other bytes belong to code points above and stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Graph:
    """Sums that a block of queries shares. Nodes 0 to leaves - 1 are sets of terms, each later node is the sum of two earlier ones."""

    leaf_of: np.ndarray  # leaf of each term
    leaves: int
    sums: list[tuple[int, int]]
    queries: list[list[int]]  # the nodes that make up each query

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.sums)


def mine(queries: list[list[int]], n_terms: int) -> Graph:
    """The graph of queries given as different term numbers."""
    holders = [[] for _ in range(n_terms)]
    for q, terms in enumerate(queries):
        for t in terms:
            holders[t].append(q)
    # Frequent sets first and sets of like holders side by side, so that what queries share are neighbours.
    places = sorted({tuple(h) for h in holders}, key=lambda h: (-len(h), h))
    number = {h: i for i, h in enumerate(places)}
    leaf_of = np.array([number[tuple(h)] for h in holders], np.int64)
    lists, sums = [sorted({int(leaf_of[t]) for t in terms}) for terms in queries], []
    while True:
        shared = {p: None for p, n in Counter(p for x in lists for p in pairwise(x)).items() if n > 1}
        if not shared:
            return Graph(leaf_of, len(places), sums, lists)
        for q, nodes in enumerate(lists):
            out, at = [], 0
            while at < len(nodes):
                pair = tuple(nodes[at : at + 2])
                if pair not in shared:
                    out.append(nodes[at])
                    at += 1
                    continue
                if shared[pair] is None:
                    shared[pair] = len(places) + len(sums)
                    sums.append(pair)
                out.append(shared[pair])
                at += 2
            lists[q] = out


class Accumulators:
    """Scores of documents for all queries of a block."""

    def __init__(self, graph: Graph, weights: np.ndarray, n_docs: int, n_all: int) -> None:
        self.graph, self.weights, self.n_docs, self.n_all = graph, weights, n_docs, n_all
        self.at_once = max(1, ACCUMULATOR_BYTES // (8 * max(1, graph.nodes + len(graph.queries))))

    def scores(self, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Matrix of queries by documents; owner[i] is the document of the i-th (term, tf)."""
        m = np.array([50 + 50 * n * self.n_docs // self.n_all for n in lengths], np.int64)
        part = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
        held = np.zeros((self.graph.nodes, len(lengths)), np.int64)
        np.add.at(held.reshape(-1), self.graph.leaf_of[terms] * len(lengths) + owner, part)
        for k, (a, b) in enumerate(self.graph.sums, self.graph.leaves):
            np.add(held[a], held[b], out=held[k])
        return np.array([held[nodes].sum(axis=0) if len(nodes) > 1 else held[nodes[0]] for nodes in self.graph.queries])


class Best:
    """The k best documents of each query among those seen so far."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.parts, self.held, self.least = k, [], 0, np.ones(n_queries, np.int64)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        q, d = np.nonzero(scores >= self.least[:, None])
        if len(q):
            self.parts.append(pa.table({"q": q, "score": scores[q, d], "doc_id": ids.take(pa.array(d))}))
            self.held += len(q)
            if self.held > HELD:
                self.trim()

    def trim(self) -> pa.Table | None:
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        q = rows.column("q").to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.filter(pa.array(rank < self.k))
        full = rank == self.k - 1
        self.least[q[full]] = rows.column("score").to_numpy()[rank[rank < self.k] == self.k - 1]
        self.parts, self.held = [rows.combine_chunks()], len(rows)
        return self.parts[0]


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) for every document with a term."""
    kind, size = docs.schema[id_col].dataType.simpleString(), max(1, len(vocabulary))

    def counted(batches):
        for batch in batches:
            words = [terms_of(t) for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            known = np.concatenate([np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int64, len(w)) for w in words] or [np.zeros(0, np.int64)])
            owner = np.repeat(np.arange(len(words)), n)
            key, tf = np.unique((owner * size + known)[known >= 0], return_counts=True)
            borders = pa.array(np.searchsorted(key, np.arange(len(words) + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(borders, pa.array(x, kind)) for x, kind in ((key % size, pa.int32()), (tf, pa.int64()))]
            cols = [batch.column(0), pa.array(n), *lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("t"))
    return map_batches(narrow, counted, f"doc_id {kind}, n bigint, terms array<int>, tf array<bigint>")


def _candidates(vectors: DataFrame, scorer: Accumulators, k: int) -> DataFrame:
    """(q, score, doc_id): the k best documents of each query in each task."""
    kind, n_queries = vectors.schema["doc_id"].dataType.simpleString(), len(scorer.graph.queries)

    def ranked(batches):
        best = Best(n_queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, scorer.at_once):
                part = batch.slice(at, scorer.at_once)
                sizes = pc.list_value_length(part.column(2)).to_numpy()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                terms, tf = (part.column(c).flatten().to_numpy() for c in (2, 3))
                best.add(scorer.scores(owner, terms, tf, part.column(1).to_pylist()), part.column(0))
        rows = best.trim()
        if rows is not None:
            yield from rows.to_batches()

    return map_batches(vectors, ranked, f"q bigint, score bigint, doc_id {kind}")


def _block(docs: DataFrame, rows: list[tuple], item_type: str, id_col: str, text_col: str, k: int, scratch: Scratch) -> DataFrame | None:
    """Ranked documents of a block of queries, given as (item id, terms)."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
    if not vocabulary:
        return None
    vectors = scratch.table(_vectors(docs, id_col, text_col, vocabulary))
    n_docs, n_all = vectors.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    graph = mine([[vocabulary[t] for t in terms] for _, terms in rows], len(vocabulary))
    found = scratch.table(_candidates(vectors, Accumulators(graph, weights, n_docs, n_all), k))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    for groups in (["q", "bucket"], ["q"]):
        bucketed = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)
    items = docs.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], f"q bigint, item_id {item_type}")
    return bucketed.join(F.broadcast(items), "q").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = TOP, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    if k < 1 or block_bytes < 1:
        raise ValueError("k and block_bytes must be at least 1")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    asked = items.select(quoted(item_col).alias("i"), quoted(item_text).alias("t")).where("t IS NOT NULL").distinct()
    asked = scratch.table(asked)
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def one(block: int) -> DataFrame | None:
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        rows = [(r.i, sorted(set(terms_of(r.t.encode())))) for r in rows]
        return _block(docs, [r for r in rows if r[1]], kinds[1], id_col, text_col, k, scratch)

    done = [x for x in map(one, range(blocks)) if x is not None]
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
