"""Ranked lexical search of all documents for each item, by a dual tree.

Documents and items are sparse vectors over the items' terms: a document's coordinate is what one
unit of a term's weight is worth in it, an item's coordinate is the weight of a term it holds. Both
sides are put into trees by the term that nearly half of a node's rows hold, and every node keeps the
maximum of each coordinate. The product of two nodes' maxima bounds every score between their rows.
A pair of nodes whose bound lies below the weakest kth score of the node's items is left out with all
its rows; pairs of leaves that stay are scored as a product of small matrices. Nothing is estimated:
a pair is left out only if none of its scores can enter a result.

Documents are counted once, over their whole texts, into a table of the terms that items hold. Each
task builds trees over its batches. A first pass scores, for each leaf of items, only the most
promising leaf of every batch: its kth best scores bound the results from below before the second
pass walks the trees. Items come in blocks of bounded vocabulary, so any number of items is searched
with bounded memory on the driver and in the tasks.

Null texts and texts without a term are no documents: they count for nothing and are never returned.
Items without a term have no rows. Rows that repeat an item's id make one item with the terms of all.
Repeated document rows are documents of their own. A null document id sorts first. Empty tables give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import bounded_batches, chosen, folded_words, stored

#: Terms and items of one block. An item with more terms makes a block of its own.
BLOCK_TERMS = 20_000
BLOCK_ITEMS = 4_096
#: Rows of a leaf.
DOCUMENT_LEAF = 32
ITEM_LEAF = 16
#: Part results of one item are cut to the best k in so many groups before they meet.
SALTS = 64
#: Integers up to here are exact in doubles.
EXACT = 1 << 53

Batches = Iterator[pa.RecordBatch]


@dataclass
class Node:
    """Rows ``first`` to ``last`` of a tree's order, and the maximum of each of their coordinates."""

    first: int
    last: int
    children: list[Node] = field(default_factory=list)
    terms: np.ndarray | None = None
    top: np.ndarray | None = None


def grow(starts: np.ndarray, terms: np.ndarray, width: int, leaf: int) -> tuple[np.ndarray, Node]:
    """Order the rows of a sparse table and build the tree over that order.

    Row i holds ``terms[starts[i]:starts[i + 1]]``. A node is split by the term whose holders are
    nearest to half of its rows, or in the middle where no term tells its rows apart.
    """
    sizes = np.diff(starts)
    order: list[np.ndarray] = []

    def build(rows: np.ndarray, first: int) -> Node:
        node = Node(first, first + len(rows))
        if len(rows) <= leaf:
            order.append(rows)
            return node
        counts = sizes[rows]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - counts), counts)
        own = terms[places]
        held = np.bincount(own, minlength=width)
        term = int(np.argmin(np.abs(2 * held - len(rows))))
        has = np.zeros(len(rows), bool)
        if 0 < held[term] < len(rows):
            has[np.repeat(np.arange(len(rows)), counts)[own == term]] = True
        else:
            has[: len(rows) // 2] = True
        left, right = rows[has], rows[~has]
        node.children = [build(left, first), build(right, first + len(left))]
        return node

    root = build(np.arange(len(sizes)), 0)
    return np.concatenate(order) if order else np.empty(0, np.int64), root


@dataclass
class Items:
    """A block of items as a tree: ids in tree order, the weights of each leaf's items."""

    ids: list[int | None]
    root: Node
    leaves: dict[int, tuple[np.ndarray, np.ndarray]]
    width: int
    most: float


def item_tree(ids: list[int | None], held: list[np.ndarray], weights: np.ndarray) -> Items:
    """The tree over items that hold the given terms."""
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
    order, root = grow(starts, np.concatenate(held), len(weights), ITEM_LEAF)
    leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fill(node: Node) -> None:
        for child in node.children:
            fill(child)
        rows = order[node.first : node.last]
        node.terms = np.unique(np.concatenate([held[r] for r in rows]))
        node.top = weights[node.terms].astype(np.float64)
        if not node.children:
            table = np.zeros((len(rows), len(node.terms)))
            for i, r in enumerate(rows):
                at = np.searchsorted(node.terms, held[r])
                table[i, at] = weights[held[r]]
            leaves[node.first] = (node.terms, table)

    fill(root)
    most = max(float(weights[h].sum()) for h in held) * 1_000_000.0
    return Items([ids[r] for r in order], root, leaves, len(weights), most)


class Best:
    """The best k documents of each item so far; ``least`` is what a score must reach to count."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.kept: list[list[np.ndarray]] = [[] for _ in range(items)]
        self.held = np.zeros(items, np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        good = scores >= max(self.least[item], 1)
        if good.any():
            self.kept[item].append(np.stack([scores[good], ids[good], absent[good].astype(np.int64)]))
            self.held[item] += good.sum()
            if self.held[item] > 4 * self.k:
                self.cut(item)

    def cut(self, item: int) -> np.ndarray:
        """Keep the best k, ties by ascending id, a null id first."""
        rows = np.concatenate(self.kept[item], axis=1) if self.kept[item] else np.empty((3, 0), np.int64)
        rows = rows[:, np.lexsort((rows[1], -rows[2], -rows[0]))[: self.k]]
        self.kept[item], self.held[item] = [rows], rows.shape[1]
        if rows.shape[1] == self.k:
            self.least[item] = max(self.least[item], rows[0, -1])
        return rows


def measure(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one unit of weight is worth: (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L."""
    if 50 * documents * int(lengths.max(initial=0)) < 1 << 63:
        m = 50 + 50 * lengths * documents // total
    else:
        m = np.asarray([50 + 50 * int(n) * documents // total for n in lengths], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


class Documents:
    """The tree over one batch of documents, with the coordinates of each leaf as a dense table."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> None:
        order, self.root = grow(starts, terms, width, DOCUMENT_LEAF)
        sizes = np.diff(starts)[order]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[order] - (ends - sizes), sizes)
        self.order = order
        self._terms, self._values, self._starts = terms[places], values[places], np.concatenate([[0], ends])
        self._width = width
        self.tables: dict[int, np.ndarray] = {}
        self._fill(self.root)

    def _fill(self, node: Node) -> None:
        if node.children:
            for child in node.children:
                self._fill(child)
            node.top = reduce(np.maximum, (c.top for c in node.children))
            return
        a, b = self._starts[node.first], self._starts[node.last]
        # values stay below 2^20, so single precision holds them exactly
        table = np.zeros((self._width, node.last - node.first), np.float32)
        sizes = np.diff(self._starts[node.first : node.last + 1])
        table[self._terms[a:b], np.repeat(np.arange(node.last - node.first), sizes)] = self._values[a:b]
        self.tables[node.first] = table
        node.top = table.max(axis=1).astype(np.float64)


def bound(items: Node, docs: Node) -> float:
    """No score between the two nodes is larger."""
    return float(items.top @ docs.top[items.terms])


def score(items: Items, leaf: Node, docs: Documents, other: Node) -> np.ndarray:
    """Scores of a leaf of items and a leaf of documents, exactly."""
    terms, weights = items.leaves[leaf.first]
    values = docs.tables[other.first][terms]
    if items.most < EXACT:
        return (weights @ values.astype(np.float64)).astype(np.int64)
    return weights.astype(np.int64) @ values.astype(np.int64)


def walk(items: Items, docs: Documents, best: Best, ids: np.ndarray, absent: np.ndarray, first_only: bool) -> tuple[int, int]:
    """Score what the bounds do not exclude; returns (pairs of rows scored, pairs in all).

    ``first_only`` scores the most promising leaf of documents for each leaf of items and no other.
    """
    slack = 0.0 if items.most < EXACT else 1e-6
    scored = 0

    def leaves(node: Node) -> Iterator[Node]:
        if node.children:
            for child in node.children:
                yield from leaves(child)
        else:
            yield node

    def meet(leaf: Node, other: Node) -> int:
        scores = score(items, leaf, docs, other)
        rows = docs.order[other.first : other.last]
        for i in np.flatnonzero(scores.max(axis=1) >= np.maximum(best.least[leaf.first : leaf.last], 1)):
            best.add(leaf.first + int(i), scores[i], ids[rows], absent[rows])
        return scores.size

    if first_only:
        others = list(leaves(docs.root))
        tops = np.stack([o.top for o in others])
        for leaf in leaves(items.root):
            scored += meet(leaf, others[int(np.argmax(tops[:, leaf.terms] @ leaf.top))])
        return scored, len(items.ids) * len(ids)
    open_pairs = [(items.root, docs.root)]
    while open_pairs:
        mine, other = open_pairs.pop()
        top = bound(mine, other)
        weakest = best.least[mine.first : mine.last].min()
        if top <= 0 or top * (1 + slack) < weakest:
            continue
        if not mine.children and not other.children:
            scored += meet(mine, other)
        elif mine.children and (not other.children or mine.last - mine.first > other.last - other.first):
            open_pairs.extend((child, other) for child in mine.children)
        else:
            # the better half last, so that it is taken first and raises what the other must reach
            open_pairs.extend(sorted(((mine, child) for child in other.children), key=lambda p: bound(*p)))
    return scored, len(items.ids) * len(ids)


def count_terms(docs: DataFrame, vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n, terms, counts)`` of every row: all its terms counted, the known ones listed."""

    def run(batches: Batches) -> Batches:
        known = vocabulary.value
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                n, found = 0, {}
                for words in folded_words(data):
                    n += len(words)
                    for word, times in Counter(words).items():
                        term = known.get(word)
                        if term is not None:
                            found[term] = found.get(term, 0) + times
                lengths.append(n)
                terms.extend(found)
                counts.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
            ], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def holders(vectors: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term; at most ``width`` numbers reach the driver."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["term", "held"])

    out = np.zeros(width, np.int64)
    for row in vectors.select("terms").mapInArrow(run, "term int, held long").groupBy("term").agg(F.sum("held").alias("held")).collect():
        out[row.term] = row.held
    return out


def weights_of(held: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term."""
    return np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in held], np.int64)


def visit(block, k: int, least, documents: int, total: int, first_only: bool) -> Callable[[Batches], Batches]:
    """A task's best rows ``(item, doc_id, score)``; tree after tree, with the bounds of those before."""

    def run(batches: Batches) -> Batches:
        items = block.value
        start = np.ones(len(items.ids), np.int64) if least is None else least.value
        best = Best(len(items.ids), k, start)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists, lengths = batch.column(2), batch.column(1).to_numpy()
            starts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
            terms = lists.flatten().to_numpy().astype(np.int64)
            counts = batch.column(3).flatten().to_numpy().astype(np.int64)
            values = measure(counts, np.repeat(lengths, np.diff(starts)), documents, total)
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            walk(items, Documents(starts, terms, values, items.width), best, ids, absent, first_only)
        for item in range(len(items.ids)):
            rows = best.cut(item)
            if rows.shape[1]:
                ids = pa.array(rows[1], pa.int64(), mask=rows[2].astype(bool))
                numbers = pa.array(np.full(rows.shape[1], item, np.int32))
                yield pa.RecordBatch.from_arrays([numbers, ids, pa.array(rows[0], pa.int64())], ["item", "doc_id", "score"])

    return run


def best_rows(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank; first within salts, so that no group gathers whole."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_rank") <= k)
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("_salt", "_rank")


def item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list[int | None], list[list[str]]]]:
    """Items with their distinct terms, in blocks of bounded vocabulary, read from Spark bit by bit."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for item, data in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for words in folded_words(data):
                    found = list(set(words))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "term"]
                    )

    rows = items.select(F.col(f"`{id_column}`").cast("long").alias("item_id"), F.col(f"`{text_column}`").alias("text"))
    rows = rows.mapInArrow(run, "item_id long, term string").distinct()
    ids: list[int | None] = []
    held: list[list[str]] = []
    seen: set[str] = set()
    for row in rows.orderBy("item_id").toLocalIterator():
        if not ids or row.item_id != ids[-1]:
            if ids and (len(ids) >= BLOCK_ITEMS or len(seen) >= BLOCK_TERMS):
                yield ids, held
                ids, held, seen = [], [], set()
            ids.append(row.item_id)
            held.append([])
        held[-1].append(row.term)
        seen.add(row.term)
    if ids:
        yield ids, held


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """The k best documents of each item: ``(item_id, rank, doc_id, score)``."""
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = chosen(docs, id_column, text_column)
    found = []
    with bounded_batches(spark):
        for ids, texts in item_blocks(items, item_column, item_text_column):
            vocabulary: dict[bytes, int] = {}
            held = [np.asarray([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms], np.int64) for terms in texts]
            vectors = stored(count_terms(docs, context.broadcast(vocabulary), id_column, text_column))
            documents, total, tasks = vectors.select("n", F.spark_partition_id().alias("task")).agg(
                F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("task"), F.lit(0)) + 1
            ).first()
            if not documents:
                break
            vectors = vectors.where(F.size("terms") > 0)
            block = context.broadcast(item_tree(ids, held, weights_of(holders(vectors, len(vocabulary)), documents)))
            # every task gives so many scores that there are a few times k of them in all, and one at least
            each = min(k, -(-4 * k // tasks))
            first = vectors.mapInArrow(visit(block, each, None, documents, total, True), "item int, doc_id long, score long")
            least = np.ones(len(ids), np.int64)
            for row in best_rows(first, "item", k).where(F.col("rank") == k).select("item", "score").collect():
                least[row.item] = row.score
            rows = vectors.mapInArrow(visit(block, k, context.broadcast(least), documents, total, False), "item int, doc_id long, score long")
            names = spark.createDataFrame([(i, name) for i, name in enumerate(block.value.ids)], "item int, item_id long")
            found.append(stored(best_rows(rows, "item", k).join(F.broadcast(names), "item")))
    schema = "item_id long, rank int, doc_id long, score long"
    result = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item int, " + schema)
    return result.select("item_id", "rank", "doc_id", "score")
