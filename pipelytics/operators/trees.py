"""Forests without a depth limit and boosted trees, grown level by level from histograms.

Features are cut into bins. A level of a tree needs one thing of the data: for each
open node, feature and bin the number of rows and the sums of what the tree
explains. Tasks count these for their rows, Spark adds them up, and the best cut of
a node is chosen from its totals alone. All sums are whole numbers, so the order
of the rows does not matter.

Several models (``fits``: folds and the final one) are grown in the same passes.
Where the binned training rows are proven to fit into ``local_bytes``, they are broadcast
and each task grows whole trees with the same functions, to the same trees.

A forest grows with the rows, so it stays a table: the rows are sent to its trees,
and neither the driver nor a task holds more than a tree of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise

BINS = 256
#: Nodes of a tree in a row of the forest's table, and bytes of bins in a block of rows sent to the trees.
PIECE, BLOCK = 4096, 16384
#: Gradients are held as whole numbers of this size.
UNIT = 2**30
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Chance that a row is drawn at most 0, 1, 2 ... times, as in sampling many rows with replacement.
_POISSON = np.exp(-1.0) * np.cumsum(1 / np.cumprod([1.0, *range(1, 12)]))


def mixed(x: np.ndarray | int, *more: np.ndarray | int) -> np.ndarray:
    """A hash of whole numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        out = np.asarray(x).astype(np.uint64)
        for y in (0, *more):
            out = (out ^ (out >> np.uint64(31)) ^ np.asarray(y).astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
        return out * _MIX


def bootstrap(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, told from a hash of the row."""
    chance = (mixed(rows.view(np.uint64), tree, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_POISSON, chance, side="right")


def histogram(nodes: np.ndarray, bins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """``node, feature, bin, sums`` for the cells that have rows, in that order; ``sums`` has a column per sum."""
    held, dense = np.unique(nodes, return_inverse=True)
    width = bins.shape[1]
    keys = ((dense[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    cells = len(held) * width * BINS
    if cells <= 4 * len(keys) + 100_000:
        used = np.flatnonzero(np.bincount(keys, minlength=cells))
        place = np.zeros(cells, dtype=np.int64)
        place[used] = np.arange(len(used))
        place = place[keys]
    else:
        used, place = np.unique(keys, return_inverse=True)
    total = np.zeros((len(used), sums.shape[1]), dtype=np.int64)
    place = place.reshape(-1, width)
    for feature in range(width):
        np.add.at(total, place[:, feature], sums)
    return held[used // (width * BINS)], used // BINS % width, used % BINS, total


def best_cuts(
    nodes: np.ndarray, features: np.ndarray, bins: np.ndarray, sums: np.ndarray, tried: int, seeds: np.ndarray | int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``node, feature, bin``: rows up to the bin go left. From cells sorted by node, feature and bin.

    The first sum counts rows; a cut is as good as the squares of the other sums
    over the rows, added up for both sides: for class counts that is Gini's measure,
    for gradients the loss in variance. Only ``tried`` features of a node are looked
    at, drawn by a hash among those that can be cut. Nodes that cannot be cut are left out.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(nodes):
        return none, none, none
    fresh = np.concatenate(([True], (np.diff(nodes) != 0) | (np.diff(features) != 0)))
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    sizes = np.diff(np.append(first, len(nodes)))
    upto = np.cumsum(sums, axis=0)
    left = upto - (upto[first] - sums[first])[group]
    total = np.add.reduceat(sums, first, axis=0)[group]
    right = total - left
    usable = sizes > 1
    owner = nodes[first]
    draw = mixed(owner, features[first], np.broadcast_to(seeds, nodes.shape)[first])
    order = np.lexsort((draw, ~usable, owner))
    start = np.searchsorted(owner[order], owner[order])
    chosen = np.zeros(len(first), dtype=bool)
    chosen[order] = (np.arange(len(first)) - start < tried) & usable[order]
    inner = np.flatnonzero(chosen[group] & (right[:, 0] > 0))
    worth = lambda s: (s[:, 1:].astype(np.float64) ** 2).sum(axis=1) / s[:, 0]
    gain = worth(left[inner]) + worth(right[inner])
    best = inner[np.lexsort((bins[inner], features[inner], -gain, nodes[inner]))]
    best = best[np.concatenate(([True], np.diff(nodes[best]) != 0))] if len(best) else best
    return nodes[best], features[best], bins[best]


class Tree:
    """A tree as columns: feature (-1 for leaves), bin, left and right child, and the sums of the node's rows."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.bin = np.array([-1]), np.array([0])
        self.left, self.right = np.array([-1]), np.array([-1])
        self.sums = np.asarray(sums, dtype=np.int64).reshape(1, -1)

    def split(self, nodes: np.ndarray, features: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Cut nodes, which get two children each, numbered in the order of the nodes. The children."""
        low = len(self.feature)
        children = low + np.arange(2 * len(nodes))
        self.feature[nodes], self.bin[nodes] = features, bins
        self.left[nodes], self.right[nodes] = children[::2], children[1::2]
        more = np.full(len(children), -1)
        self.feature, self.bin = np.append(self.feature, more), np.append(self.bin, more)
        self.left, self.right = np.append(self.left, more), np.append(self.right, more)
        self.sums = np.concatenate([self.sums, np.zeros((len(children), self.sums.shape[1]), dtype=np.int64)])
        return children

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """One level further down for rows that stand at inner nodes."""
        right = bins[np.arange(len(at)), self.feature[at]] > self.bin[at]
        return np.where(right, self.right[at], self.left[at])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            at[inner] = self.step(at[inner], bins[inner])
            inner = inner[self.feature[at[inner]] >= 0]
        return at

    def open(self, nodes: np.ndarray) -> np.ndarray:
        """Those of the nodes that a cut could improve: two rows, and for class counts two classes."""
        sums = self.sums[nodes]
        mixed_classes = (sums[:, 1:] > 0).sum(axis=1) > 1 if sums.shape[1] > 2 else True
        return nodes[(sums[:, 0] > 1) & mixed_classes]


def grow(bins: np.ndarray, sums: np.ndarray, tried: int, seed: int, depth: int | None = None) -> tuple[Tree, np.ndarray]:
    """A tree from rows that are all at hand, and the leaf of each row."""
    tree = Tree(sums.sum(axis=0))
    at = np.zeros(len(bins), dtype=np.int64)
    waiting = tree.open(np.array([0]))
    level = 0
    while len(waiting) and (depth is None or level < depth):
        rows = np.flatnonzero(np.isin(at, waiting))
        nodes, features, cuts = best_cuts(*histogram(at[rows], bins[rows], sums[rows]), tried, seed)
        if not len(nodes):
            break
        children = tree.split(nodes, features, cuts)
        rows = rows[np.isin(at[rows], nodes)]
        at[rows] = tree.step(at[rows], bins[rows])
        np.add.at(tree.sums, at[rows], sums[rows])
        waiting = tree.open(children)
        level += 1
    return tree, at


# ---- rows ----------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Cut points of each feature, at most ``BINS - 1``: its distinct quantiles. The largest value is none."""
    probs = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, probs, 20_000).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] if found[c] is not None else [], dtype=np.float64)) for c in features]


def binned(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """``id, label, fold, bins``: features as bytes, one per feature; values up to a cut point lie left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [
                np.searchsorted(e, batch.column(3 + k).to_numpy(zero_copy_only=False), side="left") for k, e in enumerate(edges)
            ]
            packed = np.stack(columns, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["id", "label", "fold", "bins"],
            )

    columns = [F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)]
    picked = rows.select("id", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), *columns)
    return materialise(picked.mapInArrow(run, "id bigint, label int, fold int, bins binary"), "binned")


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    ids, labels, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, width)
    return ids.astype(np.int64), labels.astype(np.int32), folds.astype(np.int32), bins


def _learns(folds: np.ndarray, fit: int) -> np.ndarray:
    """Fit f learns from all training rows outside fold f; test rows have fold -1, and the last fit leaves out no fold."""
    return (folds >= 0) & (folds != fit)


def _at_hand(rows: DataFrame, width: int, local_bytes: int):
    """The training rows in order of their ids, broadcast, if they are proven to take at most ``local_bytes``."""
    train = rows.where("fold >= 0")
    if train.count() * (width + 16) > local_bytes:
        return None
    table = train.select("id", "label", "fold", "bins").toArrow().combine_chunks()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    return rows.sparkSession.sparkContext.broadcast(_arrays(table.take(pa.array(order)).to_batches()[0], width) if len(order) else None)


def _packed(tree: Tree, part: slice = slice(None)) -> dict:
    return {k: getattr(tree, k)[part].astype("<i8").tobytes() for k in ("feature", "bin", "left", "right", "sums")}


def _unpacked(pieces: Sequence, sums: int) -> Tree:
    tree = Tree(np.zeros(sums))
    for k in ("feature", "bin", "left", "right", "sums") if pieces else ():
        whole = np.frombuffer(b"".join(bytes(piece[k]) for piece in pieces), dtype="<i8")
        setattr(tree, k, whole.reshape((-1, sums) if k == "sums" else -1))
    return tree


_TREE = "fit int, tree int, feature binary, bin binary, left binary, right binary, sums binary"
_PIECE = f"piece int, {_TREE}"


class Forest(Mapping):
    """``(fit, tree)``: tree, held as a table of pieces of trees. Only a tree that is asked for comes to the driver."""

    def __init__(self, pieces: DataFrame, trees: int):
        self.pieces, self.trees = pieces, trees

    def __getitem__(self, key: tuple[int, int]) -> Tree:
        fit, tree = key
        found = self.pieces.where((F.col("fit") == fit) & (F.col("tree") == tree)).orderBy("piece").collect()
        if not found:
            raise KeyError(key)
        return _unpacked(found, 3)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(sorted((r[0], r[1]) for r in self.pieces.where("piece = 0").select("fit", "tree").collect()))

    def __len__(self) -> int:
        return self.pieces.where("piece = 0").count()


def forest(rows: DataFrame, width: int, fits: int, trees: int, seed: int, local_bytes: int = 64_000_000) -> Forest:
    """``(fit, tree)``: tree, each grown until its leaves are pure or cannot be cut.

    A node tries as many features as the root of their number. Each tree draws rows
    with replacement, by a hash of the row.
    """
    tried = max(1, int(np.sqrt(width)))
    shared = _at_hand(rows, width, local_bytes)
    if shared is None:
        return Forest(_forest_by_levels(rows, width, fits, trees, seed, tried), trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"].tolist():
                fit, tree = divmod(number, trees)
                if shared.value is None:
                    continue
                ids, labels, folds, bins = shared.value
                times = bootstrap(ids, tree, seed) * _learns(folds, fit)
                held = times > 0
                sums = np.stack([times, times * (labels == 0), times * (labels == 1)], axis=1)[held]
                grown, _ = grow(bins[held], sums, tried, _seed(fit, tree, trees, seed))
                for piece, start in enumerate(range(0, len(grown.feature), PIECE)):
                    packed = _packed(grown, slice(start, start + PIECE))
                    yield pd.DataFrame([{"piece": piece, "fit": fit, "tree": tree} | packed])

    spark = rows.sparkSession
    numbers = spark.range(0, fits * trees, 1, min(fits * trees, 4 * spark.sparkContext.defaultParallelism))
    return Forest(materialise(numbers.mapInPandas(run, _PIECE), "forest"), trees)


def _seed(fit: int, tree: int, trees: int, seed: int) -> int:
    return seed * 1_000_003 + fit * trees + tree


def _forest_by_levels(rows: DataFrame, width: int, fits: int, trees: int, seed: int, tried: int) -> DataFrame:
    """Every level of all trees in a few passes over the rows that the trees have drawn and that stand at open nodes.

    The cuts of a level are a table that is joined with the rows. What comes to the
    driver is the number of nodes of each tree.
    """
    total = fits * trees
    spark = rows.sparkSession

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, folds, _ = _arrays(batch, width)
            for k in range(total):
                fit, tree = divmod(k, trees)
                times = bootstrap(ids, tree, seed) * _learns(folds, fit)
                here = np.flatnonzero(times > 0)
                if len(here):
                    columns = [np.full(len(here), k), np.zeros(len(here)), labels[here], times[here]]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, kinds)], batch.column(3).take(pa.array(here))],
                        names=["k", "node", "label", "times", "bins"],
                    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, node, label, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, width)
            sums = np.stack([times, times * (label == 0), times * (label == 1)], axis=1)
            both, feature, cell, found = histogram(k << 40 | node, bins, sums)
            columns = [both >> 40, both & (2**40 - 1), feature, cell, *found.T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node", "feature", "bin"])
        k = int(frame["k"].iloc[0])
        fit, tree = divmod(k, trees)
        sums = frame[["s0", "s1", "s2"]].to_numpy()
        node, feature, cell = (frame[c].to_numpy() for c in ("node", "feature", "bin"))
        nodes, features, cuts = best_cuts(node, feature, cell, sums, tried, _seed(fit, tree, trees, seed))
        held, dense = np.unique(node, return_inverse=True)
        place = (dense * width + feature) * BINS + cell
        own = (np.searchsorted(held, nodes) * width + features) * BINS
        upto = np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(sums, axis=0)])
        low, mid, high = (upto[np.searchsorted(place, own + b, side="left")] for b in (0, cuts + 1, BINS))
        out = np.column_stack([np.full(len(nodes), k), nodes, features, cuts, mid - low, high - mid])
        return pd.DataFrame(out, columns=["k", "node", "feature", "bin", "l0", "l1", "l2", "r0", "r1", "r2"])

    names = ["k", "node", "feature", "bin", "s0", "s1", "s2"]
    schema = ", ".join(f"{c} bigint" for c in ("k", "node", "feature", "bin", "l0", "l1", "l2", "r0", "r1", "r2"))
    train = rows.where("fold >= 0").select("id", "label", "fold", "bins")
    state = materialise(train.mapInArrow(drawn, "k int, node bigint, label int, times int, bins binary"), "drawn")
    per_class = [F.sum(F.when(F.col("label") == y, F.col("times")).otherwise(0)) for y in (0, 1)]
    per_root = state.groupBy("k").agg(F.sum("times").alias("s0"), per_class[0].alias("s1"), per_class[1].alias("s2"))
    numbers = spark.range(total).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("node"))
    roots = materialise(numbers.join(per_root, "k", "left").na.fill(0, ["s0", "s1", "s2"]), "roots")
    opened = roots.where("s1 > 0 and s2 > 0").select("k", "node")
    state = _advanced(state, state.join(F.broadcast(opened), ["k", "node"], "left_semi"))
    sizes, levels = dict.fromkeys(range(total), 1), []
    while True:
        cells = state.mapInArrow(counted, ", ".join(f"{c} bigint" for c in names))
        cells = cells.groupBy("k", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names[4:]])
        found = cells.groupBy("k", F.pmod("node", F.lit(64)).alias("part")).applyInPandas(cut, schema)
        first = spark.createDataFrame(list(sizes.items()), "k bigint, size bigint")
        left = F.col("size") + 2 * (F.row_number().over(Window.partitionBy("k").orderBy("node")) - 1)
        placed = found.join(F.broadcast(first), "k").withColumn("left", left).withColumn("right", F.col("left") + 1)
        cuts = materialise(placed.drop("size"), "cuts")
        made = cuts.groupBy("k").count().collect()
        if not made:
            break
        levels.append(cuts)
        for r in made:
            sizes[r["k"]] += 2 * r["count"]
        value = F.expr("cast(conv(hex(substring(bins, cast(feature + 1 as int), 1)), 16, 10) as int)")
        goes, still = value > F.col("bin"), lambda s: (F.col(f"{s}1") > 0) & (F.col(f"{s}2") > 0)
        moved = state.join(cuts, ["k", "node"]).where(F.when(goes, still("r")).otherwise(still("l")))
        moved = moved.select("k", F.when(goes, F.col("right")).otherwise(F.col("left")).alias("node"), "label", "times", "bins")
        state = _advanced(state, moved)
    discard(state)
    return materialise(_pieces(roots, levels, trees), "forest")


def _advanced(state: DataFrame, moved: DataFrame) -> DataFrame:
    """The rows of the next level, written in place of those of the last one."""
    out = materialise(moved, "drawn")
    discard(state)
    return out


def _pieces(roots: DataFrame, levels: list[DataFrame], trees: int) -> DataFrame:
    """Pieces of trees, as a ``Tree`` has them, from the roots' sums and the cuts of all levels."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        fit, tree = divmod(int(frame["k"].iloc[0]), trees)
        packed = {c: frame[c].to_numpy().astype("<i8").tobytes() for c in ("feature", "bin", "left", "right")}
        sums = np.ascontiguousarray(frame[["s0", "s1", "s2"]].to_numpy().astype("<i8")).tobytes()
        return pd.DataFrame([{"piece": int(frame["piece"].iloc[0]), "fit": fit, "tree": tree} | packed | {"sums": sums}])

    columns = "k bigint, node bigint, feature bigint, bin bigint, left bigint, right bigint"
    inner = [c.select("k", "node", "feature", "bin", "left", "right") for c in levels]
    cuts = reduce(DataFrame.unionByName, inner, roots.sparkSession.createDataFrame([], columns))
    children = [
        c.select("k", F.col(side).alias("node"), *[F.col(f"{side[0]}{i}").alias(f"s{i}") for i in range(3)])
        for c in levels for side in ("left", "right")
    ]
    nodes = reduce(DataFrame.unionByName, children, roots).join(cuts, ["k", "node"], "left").na.fill(-1, ["feature", "left", "right"])
    nodes = nodes.withColumn("bin", F.coalesce("bin", F.when(F.col("node") > 0, -1).otherwise(0)))
    nodes = nodes.withColumn("piece", F.floor(F.col("node") / PIECE))
    return nodes.groupBy("k", "piece").applyInPandas(pack, _PIECE)


def forest_votes(rows: DataFrame, model: Forest, width: int, fits: int) -> DataFrame:
    """``fit, label, prediction`` for the rows that a fit has not learnt from: its fold, or the test rows for the last.

    The mean of the trees' class shares decides; a tie goes to class 0. Blocks of rows
    are sent to every tree of their fit, behind the pieces of the tree, and the shares of
    a block are added up in the order of the trees.
    """
    trees, size = model.trees, max(1, BLOCK // width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            _, labels, folds, bins = _arrays(batch, width)
            for fit in range(fits):
                mine = np.flatnonzero(folds == (fit if fit < fits - 1 else -1))
                for start in range(0, len(mine), size):
                    some = mine[start : start + size]
                    columns = [[fit], [number], [labels[some].astype("<i4").tobytes()], [bins[some].tobytes()]]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["fit", "place", "labels", "bins"])
                    number += 1

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, tree, ones = None, [], None, None
        for batch in (some.slice(start, 64) for some in batches for start in range(0, some.num_rows, 64)):
            out: list[tuple] = []
            for r in batch.to_pylist():
                if held != (r["fit"], r["tree"]):
                    held, pieces, tree = (r["fit"], r["tree"]), [], None
                if r["place"] < 0:
                    pieces.append(r)
                    continue
                if tree is None:
                    tree, pieces = _unpacked(pieces, 3), []
                    n, _, ones = tree.sums.T
                    ones = np.where(n > 0, ones / np.maximum(n, 1), 0.0)
                bins = np.frombuffer(r["bins"], dtype=np.uint8).reshape(-1, width)
                out.append((r["fit"], r["place"], r["tree"], r["labels"], ones[tree.leaves(bins)].astype("<f8").tobytes()))
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["fit", "place", "tree", "labels", "shares"]
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tree")
        labels = np.frombuffer(frame["labels"].iloc[0], dtype="<i4")
        total = np.zeros(len(labels))
        for shares in frame["shares"]:
            total += np.frombuffer(shares, dtype="<f8")
        return pd.DataFrame({"fit": frame["fit"].iloc[0], "label": labels, "prediction": (total > 0.5 * trees).astype(np.int64)})

    picked = rows.select("id", "label", "fold", "bins")
    blocks = picked.mapInArrow(cut, "fit int, place bigint, labels binary, bins binary")
    # The labels travel with the first tree only; pieces have places below all blocks.
    sent = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    sent = sent.withColumn("labels", F.when(F.col("tree") == 0, F.col("labels")))
    grown = model.pieces.withColumn("place", F.col("piece").cast("bigint") - F.lit(2**40)).drop("piece")
    both = grown.unionByName(sent, allowMissingColumns=True).repartition("fit", "tree")
    shares = both.sortWithinPartitions("fit", "tree", "place").mapInArrow(share, "fit int, place bigint, tree int, labels binary, shares binary")
    voted = shares.groupBy("fit", "place").applyInPandas(add, "fit int, label int, prediction int")
    return materialise(voted, "votes")


def _predicted(rows: DataFrame, width: int, fits: int, guess) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, labels, folds, bins = _arrays(batch, width)
            for fit in range(fits):
                mine = np.flatnonzero(folds == (fit if fit < fits - 1 else -1))
                if len(mine):
                    columns = [np.full(len(mine), fit), labels[mine], guess(fit, bins[mine])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["fit", "label", "prediction"])

    picked = rows.select("id", "label", "fold", "bins")
    return materialise(picked.mapInArrow(run, "fit int, label int, prediction int"), "votes")


# ---- boosting ------------------------------------------------------------


def _gradient(labels: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left to explain, and its curvature, as whole numbers."""
    p = 1 / (1 + np.exp(-score))
    return np.rint((labels - p) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def _start(ones: int, n: int) -> float:
    share = min(max(ones / max(n, 1), 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _steps(tree: Tree, curvature: np.ndarray, rate: float) -> np.ndarray:
    """The value of each node: the sum of the gradients over that of the curvatures, times the rate."""
    return rate * np.where(curvature > 0, tree.sums[:, 1] / np.maximum(curvature, 1), 0.0)


def boosted(
    rows: DataFrame, width: int, fits: int, rounds: int, depth: int = 3, rate: float = 0.1, seed: int = 0,
    local_bytes: int = 64_000_000,
) -> dict:
    """Per fit its starting score and a list of trees with the values of their nodes, under the logistic loss.

    Rounds follow each other. Rows at hand are boosted by one task per fit; else a
    level of a round is a pass over the rows for all fits, and the scores of the rows are
    written once a round.
    """
    shared = _at_hand(rows, width, local_bytes)
    if shared is None:
        return _boosted_by_levels(rows, width, fits, rounds, depth, rate, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fit in frame["id"].tolist():
                if shared.value is None:
                    continue
                _, labels, folds, bins = shared.value
                held = _learns(folds, fit)
                labels, bins = labels[held], bins[held]
                start = _start(int(labels.sum()), len(labels))
                score = np.full(len(labels), start)
                for number in range(rounds):
                    left, curve = _gradient(labels, score)
                    sums = np.stack([np.ones_like(left), left], axis=1)
                    tree, at = grow(bins, sums, width, seed, depth)
                    per_node = np.zeros(len(tree.feature), dtype=np.int64)
                    np.add.at(per_node, at, curve)
                    values = _steps(tree, per_node, rate)
                    score = score + values[at]
                    yield pd.DataFrame(
                        [{"fit": fit, "tree": number} | _packed(tree) | {"start": start, "value": values.astype("<f8").tobytes()}]
                    )

    made = materialise(
        rows.sparkSession.range(0, fits, 1, fits).mapInPandas(run, f"{_TREE}, start double, value binary"), "boosted"
    )
    model: dict = {fit: (0.0, []) for fit in range(fits)}
    for r in made.orderBy("fit", "tree").toLocalIterator():
        model[r["fit"]] = (r["start"], [*model[r["fit"]][1], (_unpacked([r], 2), np.frombuffer(bytes(r["value"]), dtype="<f8"))])
    return model


def _boosted_by_levels(rows: DataFrame, width: int, fits: int, rounds: int, depth: int, rate: float, seed: int) -> dict:
    spark = rows.sparkSession
    train = rows.where("fold >= 0").select("id", "label", "fold", "bins")
    counts = train.groupBy("fold").agg(F.count(F.lit(1)), F.sum("label")).collect()
    model: dict = {}
    for fit in range(fits):
        mine = [(n, ones) for fold, n, ones in counts if fold != fit]
        model[fit] = (_start(sum(o for _, o in mine), sum(n for n, _ in mine)) if mine else 0.0, [])
    starts = np.array([model[fit][0] for fit in range(fits)])

    def passed(state: DataFrame, trees: dict[int, Tree], waiting: dict[int, np.ndarray] | None) -> DataFrame:
        """Cells of the waiting nodes; without any, the sums of gradients and curvatures of every leaf."""
        shared = spark.sparkContext.broadcast((trees, waiting))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, waiting = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, labels, folds, bins = _arrays(batch, width)
                scores = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<f8").reshape(-1, fits)
                for fit, tree in trees.items():
                    here = np.flatnonzero(_learns(folds, fit))
                    at = tree.leaves(bins[here])
                    if waiting is not None:
                        held = np.isin(at, waiting.get(fit, []))
                        here, at = here[held], at[held]
                    if not len(here):
                        continue
                    left, curve = _gradient(labels[here], scores[here, fit])
                    sums = np.stack([np.ones_like(left), left, curve], axis=1)
                    if waiting is None:
                        found = np.zeros((len(tree.feature), 3), dtype=np.int64)
                        np.add.at(found, at, sums)
                        node = np.arange(len(found))
                        feature = cell = np.zeros(len(found), dtype=np.int64)
                    else:
                        node, feature, cell, found = histogram(at, bins[here], sums)
                    columns = [np.full(len(node), fit), node, feature, cell, *found.T]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

        names = ["fit", "node", "feature", "bin", "s0", "s1", "s2"]
        cells = state.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
        # At most fits * 2 ** depth * features * bins rows, whatever the data.
        return cells.groupBy("fit", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names[4:]])

    def advanced(state: DataFrame, last: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(last)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _arrays(batch, width)[3]
                scores = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<f8").reshape(-1, fits).copy()
                for fit, (tree, values) in shared.value.items():
                    scores[:, fit] += values[tree.leaves(bins)]
                packed = pa.array([r.tobytes() for r in scores], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], packed], names=[*batch.schema.names])

        return materialise(state.mapInArrow(run, state.schema), "scores")

    first = bytearray(starts.astype("<f8").tobytes())
    state = train.withColumn("at", F.lit(first))
    for _ in range(rounds):
        trees = {fit: Tree(np.zeros(2)) for fit in range(fits)}
        roots = passed(state, trees, None).collect()
        for r in roots:
            trees[r["fit"]].sums[0] = (r["s0"], r["s1"])
        waiting = {fit: tree.open(np.array([0])) for fit, tree in trees.items()}
        for _ in range(depth):
            waiting = {fit: nodes for fit, nodes in waiting.items() if len(nodes)}
            if not waiting:
                break
            table = passed(state, trees, waiting).toPandas()
            waiting = {}
            for fit, part in table.groupby("fit"):
                part = part.sort_values(["node", "feature", "bin"])
                node, feature, cell = (part[c].to_numpy() for c in ("node", "feature", "bin"))
                sums = part[["s0", "s1"]].to_numpy()
                nodes, features, cuts = best_cuts(node, feature, cell, sums, width, seed)
                tree = trees[fit]
                children = tree.split(nodes, features, cuts)
                for k, (n, f, c) in enumerate(zip(nodes, features, cuts)):
                    own = (node == n) & (feature == f)
                    tree.sums[children[2 * k]] = sums[own & (cell <= c)].sum(axis=0)
                    tree.sums[children[2 * k + 1]] = sums[own & (cell > c)].sum(axis=0)
                waiting[fit] = tree.open(children)
        curves = {fit: np.zeros(len(tree.feature), dtype=np.int64) for fit, tree in trees.items()}
        for r in passed(state, trees, None).collect():
            curves[r["fit"]][r["node"]] = r["s2"]
        last = {fit: (tree, _steps(tree, curves[fit], rate)) for fit, tree in trees.items()}
        for fit, grown in last.items():
            model[fit][1].append(grown)
        state = advanced(state, last)
    return model


def boosted_votes(rows: DataFrame, model: dict, width: int, fits: int) -> DataFrame:
    """Like ``forest_votes``, by the sign of the boosted score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(fit: int, bins: np.ndarray) -> np.ndarray:
        start, trees = shared.value[fit]
        score = np.full(len(bins), start)
        for tree, values in trees:
            score += values[tree.leaves(bins)]
        return (score > 0).astype(np.int64)

    return _predicted(rows, width, fits, run)
