"""Ranked lexical search of many queries at once: a dual-tree search over items and documents.

A document's score for an item is a product of two vectors over the items'
terms: what a term is worth to the item, and how full the document is of it. Items
and blocks of documents form hierarchies, similar vectors side by side, whose
nodes hold the largest value of every coordinate below them. The product of two
nodes' vectors bounds the score of every pair below them; where it stays under
the weakest kth score of the node's items, the whole batch of pairs goes at once,
and no pair that could be ranked is lost. Scores are exact integers.

Spark counts the statistics of all documents, deals their postings over the
tasks, and merges the tasks' best k per item. Items are taken in blocks of bounded
size, the only thing that is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LONG = 2_000_000
#: Bounds may be rounded by this much; exact scores never are.
_SLACK = 1 + 1e-9


def terms_of(text: str | None) -> Iterator[list[str]]:
    """The terms of a whole text in lists of bounded length; only A-Z are lower-cased."""
    if not text:
        return
    lowered = text.encode().lower().decode()
    if len(lowered) < _LONG:
        yield _TERM.findall(lowered)
        return
    found = (m.group() for m in _TERM.finditer(lowered))
    while piece := list(islice(found, 100_000)):
        yield piece


def postings(docs: DataFrame, vocabulary: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n, terms, counts``: all terms of a document, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                n, found = 0, Counter()
                for piece in terms_of(texts[i].as_py()):
                    n += len(piece)
                    found.update(map(number, piece))
                found.pop(None, None)
                sizes.append(n)
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc", "n", "terms", "counts"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("body"))
    return rows.mapInArrow(run, "doc bigint, n bigint, terms array<int>, counts array<bigint>")


# ---- hierarchies ---------------------------------------------------------


def similar_order(points: np.ndarray, levels: int) -> np.ndarray:
    """An order of the points in which halves, quarters and so on lie together: cuts along the widest direction."""
    order = np.arange(len(points))
    for level in range(levels):
        edges = node_edges(len(points), level)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low < 2:
                continue
            part = points[order[low:high]]
            part = part - part.mean(axis=0)
            direction = np.ones(part.shape[1])
            spread = part.T @ part
            for _ in range(6):
                direction = spread @ direction
                size = np.abs(direction).max()
                if size == 0:
                    break
                direction /= size
            order[low:high] = order[low:high][np.argsort(part @ direction, kind="stable")]
    return order


def node_edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: 2 ** level nodes of equal size, halves of those above."""
    return np.arange((1 << level) + 1) * n >> level


def maxima(matrix: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each level from the root the largest value of every column below each node; an empty node has zeros."""
    edges = node_edges(len(matrix), levels)
    lowest = np.zeros((1 << levels, matrix.shape[1]))
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        lowest[filled] = np.maximum.reduceat(matrix, edges[filled], axis=0)
    out = [lowest]
    for _ in range(levels):
        out.append(np.maximum(out[-1][::2], out[-1][1::2]))
    return out[::-1]


def sketch_weights(terms: np.ndarray, width: int = 16) -> np.ndarray:
    """Fixed pseudo-random signs per term, by which vectors over many terms become short points."""
    mixed = (terms[:, None].astype(np.uint64) * np.uint64(width) + np.arange(width, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return np.where((mixed >> np.uint64(61)) & np.uint64(1), 1.0, -1.0)


class Items:
    """A block of items: vectors over their terms, in an order of similarity, with the hierarchy of their maxima."""

    def __init__(self, numbers: list[int], vectors: list[dict[int, int]]):
        self.terms = np.array(sorted(set().union(*vectors)), dtype=np.int64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        dense = np.zeros((len(vectors), len(self.terms)))
        for row, vector in enumerate(vectors):
            for t, w in vector.items():
                dense[row, place[t]] = w
        self.levels = max(0, math.ceil(math.log2(len(vectors))))
        order = similar_order(dense @ sketch_weights(self.terms), self.levels)
        self.numbers = [numbers[k] for k in order]
        self.vectors = dense[order]
        # Products of doubles are exact below 2 ** 53; a full coordinate is worth at most a million.
        self.exact = self.vectors.sum(axis=1).max(initial=0) * 1e6 < 2**52

    def scores(self, documents: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        own = self.vectors[np.ix_(rows, columns)]
        if self.exact:
            return np.rint(documents @ own.T).astype(np.int64)
        return documents.astype(np.int64) @ own.astype(np.int64).T


def item_blocks(vectors: dict[int, dict[int, int]], cells: int = 4_000_000, most: int = 256) -> list[Items]:
    """Items in blocks whose matrix of items and terms stays within ``cells``; one item may exceed it."""
    blocks, numbers, terms = [], [], set()
    for number, vector in vectors.items():
        if not vector:
            continue
        wider = terms | vector.keys()
        if numbers and (len(numbers) == most or (len(numbers) + 1) * len(wider) > cells):
            blocks.append(Items(numbers, [vectors[k] for k in numbers]))
            numbers, wider = [], set(vector)
        numbers.append(number)
        terms = wider
    if numbers:
        blocks.append(Items(numbers, [vectors[k] for k in numbers]))
    return blocks


class Best:
    """The best k documents of each item so far: score, whether the id is null, id; the order of the ranking."""

    def __init__(self, k: int, floors: dict[int, int]):
        self.k, self.floors = k, floors
        self.rows: dict[int, list[tuple[int, bool, int]]] = {}

    def weakest(self, item: int) -> int:
        """The least score that could still be ranked."""
        rows = self.rows.get(item, ())
        own = -rows[-1][0] if len(rows) == self.k else 1
        return max(own, self.floors.get(item, 1))

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        rows = self.rows.setdefault(item, [])
        rows += zip((-scores).tolist(), null.tolist(), ids.tolist(), strict=True)
        rows.sort()
        del rows[self.k :]


def search_block(items: Items, best: Best, flat: tuple, ids: np.ndarray, null: np.ndarray, leaf: int = 16) -> int:
    """Rank a block of documents for a block of items; ``flat``: row, term and value of each posting. Pairs scored."""
    rows, terms, values = flat
    place = np.searchsorted(items.terms, terms)
    place[place == len(items.terms)] = 0
    mine = items.terms[place] == terms
    rows, place, values = rows[mine], place[mine], values[mine]
    if not len(rows):
        return 0
    columns, place = np.unique(place, return_inverse=True)
    own_rows, rows = np.unique(rows, return_inverse=True)
    ids, null = ids[own_rows], null[own_rows]
    matrix = np.zeros((len(own_rows), len(columns)))
    matrix[rows, place] = values
    levels = max(0, math.ceil(math.log2(len(ids) / leaf)))
    worth = items.vectors[:, columns].max(axis=0)
    order = similar_order((matrix * worth) @ sketch_weights(items.terms[columns]), levels)
    matrix, ids, null = matrix[order], ids[order], null[order]
    above, below = maxima(matrix, levels), maxima(items.vectors[:, columns], items.levels)
    weakest = np.array([best.weakest(k) for k in items.numbers], dtype=np.float64)
    least = np.full(1 << items.levels, np.inf)
    filled = np.diff(node_edges(len(items.numbers), items.levels)) > 0
    least[filled] = weakest
    per_level = [least]
    for _ in range(items.levels):
        per_level.append(np.minimum(per_level[-1][::2], per_level[-1][1::2]))
    per_level.reverse()
    alive, i, j = np.ones((1, 1), dtype=bool), 0, 0
    while True:
        bound = np.zeros(alive.shape)
        some, others = alive.any(axis=1), alive.any(axis=0)
        bound[np.ix_(some, others)] = above[i][some] @ below[j][others].T
        alive &= bound * _SLACK >= per_level[j]
        if i == levels and j == items.levels or not alive.any():
            break
        if i < levels:
            alive, i = np.repeat(alive, 2, axis=0), i + 1
        if j < items.levels:
            alive, j = np.repeat(alive, 2, axis=1), j + 1
    if not alive.any():
        return 0
    # Now a row is a leaf of documents and a column one item. Promising leaves come first, as they raise the weakest scores.
    nodes = np.flatnonzero(filled)
    edges = node_edges(len(ids), levels)
    alive, bound = alive[:, nodes], bound[:, nodes]
    scored = 0
    for node in np.argsort(-np.where(alive, bound / weakest, 0).max(axis=1), kind="stable"):
        low, high = edges[node], edges[node + 1]
        chosen = np.flatnonzero(alive[node] & (bound[node] * _SLACK >= weakest))
        if not len(chosen) or low == high:
            continue
        scores = items.scores(matrix[low:high], chosen, columns)
        scored += scores.size
        good = scores >= weakest[chosen]
        for c in np.flatnonzero(good.any(axis=0)):
            hits = np.flatnonzero(good[:, c])
            item = items.numbers[chosen[c]]
            best.offer(item, scores[hits, c], ids[low + hits], null[low + hits])
            weakest[chosen[c]] = best.weakest(item)
    return scored


# ---- in Spark ------------------------------------------------------------


def best_of_tasks(
    held: DataFrame, blocks: list[Items], documents: int, all_terms: int, k: int, floors: dict[int, int], cells: int = 8_000_000
) -> DataFrame:
    """``item, doc, score``: for each item number the best ``k`` documents of every task."""
    shared = held.sparkSession.sparkContext.broadcast((blocks, floors))
    widest = max((len(b.terms) for b in blocks), default=1)
    rows_at_once = max(1, min(2048, cells // max(widest, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, floors = shared.value
        best = Best(k, floors)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids = part.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                lists = part.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(n)), sizes)
                longer = 25 + 75 * n * documents // all_terms
                values = 1_000_000_000 * tf // (1000 * tf + 8 * longer[rows])
                for items in blocks:
                    search_block(items, best, (rows, terms, values), ids, null)
        out = [(item, None if none else doc, -score) for item, rows in best.rows.items() for score, none, doc in rows]
        columns = zip(*out, strict=True) if out else [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "doc", "score"]
        )

    return held.where(F.size("terms") > 0).mapInArrow(run, "item int, doc bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block_bytes: int = 16_000_000, seed_documents: int = 20_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, of all documents.

    Only scores above 0 count; of equal scores the smaller id comes first, a
    null id last. Rows of ``items`` that agree in id and text count once; every
    row of ``docs`` is a document of its own, repeated ones too. Null and empty
    texts have no terms: such an item has no rows, such a document is never
    ranked and does not count. Keys of documents are whole numbers.

    Items are handled in blocks of about ``block_bytes`` of text. The best scores
    among about ``seed_documents`` documents are lower bounds with which all tasks
    start; they speed the search up and decide nothing.
    """
    spark = docs.sparkSession
    distinct = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("body")).where(F.length("body") > 0).distinct()
    total = distinct.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    kind = items.schema[item_key].dataType.simpleString()
    schema = f"{item_key} {kind}, rank int, {key} bigint, score bigint"
    results = []
    for part in range(parts):
        chosen = distinct.where(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part)
        names, bags = [], []
        for row in chosen.toLocalIterator():
            names.append(row["id"])
            bags.append(Counter(t for piece in terms_of(row["body"]) for t in piece))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
        if not vocabulary:
            continue
        held = materialise(postings(docs, vocabulary, key, text), "postings")
        documents, all_terms = held.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        # At most one number per term of the block's items.
        found_in = dict(tuple(r) for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        worth = {
            t: math.floor(1000 * math.log((2 * documents + 2) / (2 * found_in[i] + 1))) for t, i in vocabulary.items() if i in found_in
        }
        vectors = {
            number: {vocabulary[t]: c * worth[t] for t, c in bag.items() if worth.get(t, 0) > 0} for number, bag in enumerate(bags)
        }
        blocks = item_blocks(vectors)
        if not blocks:
            continue
        floors: dict[int, int] = {}
        if documents > 4 * seed_documents:
            draw = F.pmod(F.xxhash64("doc", "n", F.lit(11)), F.lit(1_000_000))
            seeds = held.where(draw < int(1_000_000 * seed_documents / documents))
            weakest = _ranked(best_of_tasks(seeds, blocks, documents, all_terms, k, {}), k).where(F.col("rank") == k)
            floors = {r["item"]: r["score"] for r in weakest.select("item", "score").collect()}
        found = _ranked(best_of_tasks(held, blocks, documents, all_terms, k, floors), k)
        named = spark.createDataFrame(list(enumerate(names)), f"item int, id {kind}")
        results.append(
            found.join(named, "item").select(F.col("id").alias(item_key), "rank", F.col("doc").alias(key), "score")
        )
    if not results:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, results)
