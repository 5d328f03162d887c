"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, each with an embedding; a window of
words is the average of its words, and a linear softmax tells toxic windows
from clean ones. Embeddings and softmax are trained jointly. A misspelt or
inflected word that training never saw shares most of its n-grams with one that
it did see. A document is as toxic as its most toxic window, so that a few
words are not lost in a long text; in training a toxic document therefore
answers for its most toxic window only, once a first pass has found it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import add_columns

_WORD = re.compile(r"[^\W_]+")
_ORDERS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def ngram_buckets(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of ``<word>`` and of the word itself, word after word, and each word's count."""
    joined = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    room = ends[owner] - np.arange(len(codes))  # letters from here to the word's end
    owners, hashes = [], []
    rolling = codes.copy()
    for n in range(2, max(_ORDERS) + 1):
        rolling = rolling[:-1] * _MIX if len(rolling) else rolling
        rolling = (rolling ^ (rolling >> np.uint64(29))) + codes[n - 1 :]
        if n in _ORDERS:
            fits = np.flatnonzero(room[: len(rolling)] >= n)
            owners.append(owner[fits])
            hashes.append(rolling[fits] * np.uint64(2 * n + 1))
    whole = np.add.reduceat(codes * (_MIX ** (room.astype(np.uint64) & np.uint64(63))), ends - lengths)
    owners.append(np.arange(len(words)))
    hashes.append(whole)
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    buckets = ((hashes[order] * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    return buckets, np.bincount(owners, minlength=len(words))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


class Model:
    """``weights``: per n-gram bucket, embedding times the difference of the two softmax rows; ``bias`` likewise.

    A linear softmax of averages needs no more than this one number per bucket
    once it is trained.
    """

    def __init__(self, weights: np.ndarray, bias: float, bits: int, window: int, least: int):
        self.weights, self.bias, self.bits, self.window, self.least = weights, bias, bits, window, least

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        buckets, counts = ngram_buckets(words, self.bits)
        return np.add.reduceat(self.weights[buckets], _starts(counts)) / counts

    def scorer(self, remember: int = 300_000):
        """A function from texts to probabilities; words met before are looked up, at most ``remember`` of them."""
        known: dict[str, float] = {}

        def score(texts: list[str | None]) -> list[float]:
            bags = [words_of(t) for t in texts]
            fresh = set().union(*bags).difference(known)
            if len(known) + len(fresh) > remember:
                known.clear()
                fresh = set().union(*bags)
            fresh = list(fresh)
            known.update(zip(fresh, self.word_scores(fresh).tolist(), strict=True))
            counts = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
            flat = np.fromiter((known[w] for bag in bags for w in bag), dtype=np.float64, count=int(counts.sum()))
            windows, owner = window_starts(counts, self.window)
            logit = np.full(len(texts), self.bias)
            if len(flat):
                sizes = np.diff(np.append(windows, len(flat)))
                each = np.add.reduceat(flat, windows) / np.maximum(sizes, self.least) + self.bias
                filled = np.flatnonzero(counts)
                logit[filled] = np.maximum.reduceat(each, np.searchsorted(owner, filled))
            return (1 / (1 + np.exp(-np.clip(logit, -500, 500)))).tolist()

        return score


def window_starts(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin in the concatenated words of texts, and which text each belongs to."""
    per = -(-counts // window)
    owner = np.repeat(np.arange(len(counts)), per)
    within = np.arange(len(owner)) - np.repeat(_starts(per), per)
    return _starts(counts)[owner] + within * window, owner


def _fit(
    texts: list[str | None],
    labels: list[int],
    bits: int = 17,
    dims: int = 8,
    window: int = 4,
    least: int = 4,
    epochs: int = 120,
    warm: int = 20,
    rate: float = 30.0,
    least_documents: int = 5,
    seed: int = 1,
) -> Model:
    """Fit embeddings and softmax together by gradient steps over all windows; a fixed seed makes reruns agree."""
    bags = [words_of(t) for t in texts]
    counts = np.array([len(b) for b in bags], dtype=np.int64)
    y = np.array(labels, dtype=np.int64)
    y, bags, counts = y[counts > 0], [b for b in bags if b], counts[counts > 0]
    if not len(y) or not y.any() or y.all():
        # Without both labels there is nothing to tell apart: the share of label 1 is all that is known.
        share = float(np.mean(labels)) if len(labels) else 0.0
        return Model(np.zeros(1 << bits), float(np.log((share + 1e-6) / (1 - share + 1e-6))), bits, window, least)
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    tokens = np.fromiter((vocabulary[w] for b in bags for w in b), dtype=np.int32, count=int(counts.sum()))
    del bags
    listed = list(vocabulary)
    parts = [ngram_buckets(listed[k : k + 50_000], bits) for k in range(0, len(listed), 50_000)]
    buckets = np.concatenate([b.astype(np.int32) for b, _ in parts])
    per_word = np.concatenate([n for _, n in parts])
    del parts, listed
    word_at = _starts(per_word)
    # An n-gram of few documents can only be learnt by heart: it keeps weight zero.
    document_of = np.repeat(np.arange(len(y), dtype=np.int64), counts)
    seen = np.unique(document_of * len(vocabulary) + tokens) % len(vocabulary)
    in_documents = np.bincount(seen, minlength=len(vocabulary))
    support = np.bincount(buckets, weights=np.repeat(in_documents, per_word), minlength=1 << bits)
    known = support >= least_documents
    del document_of, seen
    word_of = np.repeat(np.arange(len(vocabulary), dtype=np.int32), per_word)
    windows, owner = window_starts(counts, window)
    sizes = np.diff(np.append(windows, len(tokens)))
    window_of = np.repeat(np.arange(len(windows), dtype=np.int32), sizes)
    divide = np.maximum(sizes, least)
    first = np.searchsorted(owner, np.arange(len(y)))
    positive = y[owner] == 1

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (1 << bits, dims)) * known[:, None]
    soft = rng.normal(0, 1, dims)  # difference of the two rows of the softmax
    soft /= np.linalg.norm(soft)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    speed_table, speed_soft, speed_bias = np.zeros_like(table), np.zeros_like(soft), 0.0
    for epoch in range(epochs):
        by_word = np.add.reduceat((table @ soft)[buckets], word_at) / per_word
        logit = np.add.reduceat(by_word[tokens], windows) / divide + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        weight = np.ones(len(windows))
        if epoch >= warm:
            top = logit >= np.maximum.reduceat(logit, first)[owner]
            weight = np.where(top, 1.0, np.where(positive, 0.0, 0.02))
        # The labels' shares in the sample do not matter: at first both weigh the same, then clean text twice as much.
        weight[positive] *= weight[~positive].sum() / weight[positive].sum() * (1 if epoch < warm else 0.5)
        error = (p - positive) * weight / weight.sum()
        on_word = np.bincount(tokens, weights=(error / divide)[window_of], minlength=len(vocabulary))
        on_bucket = np.bincount(buckets, weights=(on_word / per_word)[word_of], minlength=1 << bits) * known
        grad_soft = on_bucket @ table
        # One step size for all n-grams: those that many toxic documents share move most.
        peak = np.abs(on_bucket).max() + 1e-300
        pace = rate * (1 - 0.9 * epoch / epochs)
        speed_table = 0.8 * speed_table - pace * (on_bucket / peak)[:, None] * soft
        speed_soft = 0.8 * speed_soft - 0.01 * grad_soft / (np.abs(grad_soft).max() + 1e-300)
        speed_bias = 0.8 * speed_bias - 0.3 * error.sum()
        table, soft, bias = table + speed_table, soft + speed_soft, bias + speed_bias
    return Model(table @ soft, bias, bits, window, least)


def train(
    texts: list[str | None],
    labels: list[int],
    attempts: tuple[tuple[float, int], ...] = ((30.0, 20), (8.0, 10), (15.0, 30)),
    enough: float = 0.97,
    **options,
) -> Model:
    """The best of a few fits, by balanced accuracy on the sample.

    Which window answers for a toxic document is settled early in a fit, and now
    and then wrongly. ``attempts`` are pairs of step size and length of the first
    pass; the first that reaches ``enough`` is taken.
    """
    y = np.array(labels, dtype=np.int64)
    best, most = None, -1.0
    for rate, warm in attempts:
        model = _fit(texts, labels, **({"rate": rate, "warm": warm} | options))
        if not len(y) or not y.any() or y.all():
            return model
        score = model.scorer()
        hit = np.array([p >= 0.5 for k in range(0, len(texts), 500) for p in score(texts[k : k + 500])])
        right = (hit[y == 1].mean() + 1 - hit[y == 0].mean()) / 2
        if right > most:
            best, most = model, right
        if most >= enough:
            break
    return best


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "toxic",
    text: str = "text",
    rows_per_label: tuple[int, int] = (4000, 2000),
    most_chars: int = 200_000,
    most_bytes: int = 100_000_000,
) -> DataFrame:
    """``_k, _t, _y``: a bounded sample of texts and labels, about ``rows_per_label`` rows of label 0 and of label 1.

    The sample is drawn by a hash of the key, so reruns agree. Only its keys,
    whose number is bounded, are sent to the documents; a key with several texts
    gives one of them. Texts of more than ``most_chars`` characters are not learnt from,
    nor what goes beyond ``most_bytes`` of text in all.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("_y") == 0, rows_per_label[0] / max(1, counts.get(0, 0))).otherwise(
        rows_per_label[1] / max(1, counts.get(1, 0))
    )
    chosen = known.where(draw < share)
    rows = (
        docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
        .where(F.length("_t") <= most_chars)
        .join(F.broadcast(chosen), "_k")
        .groupBy("_k", "_y")
        .agg(F.min(F.struct(F.xxhash64("_t").alias("hash"), F.col("_t").alias("body"))).alias("_one"))
        .select("_k", "_y", F.col("_one.body").alias("_t"))
    )
    sample = materialise(rows, "training-sample")
    # The sample is a few thousand rows, whatever the table, so one task may add up its sizes.
    upto = F.sum(F.octet_length("_t")).over(Window.orderBy(F.xxhash64("_k", F.lit(5)), "_k"))
    return sample.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).drop("_upto")


def train_in_task(sample: DataFrame, **options) -> Model:
    """``train`` on the rows of ``training_rows`` in one Spark task; the driver receives the model only."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"_k": [], "_t": [], "_y": []}), *parts]).sort_values(["_k", "_t"], ignore_index=True)
        if len(rows):
            model = train(rows["_t"].tolist(), rows["_y"].astype(int).tolist(), **options)
            numbers = {c: [getattr(model, c)] for c in ("bias", "bits", "window", "least")}
            yield pd.DataFrame({"weights": [model.weights.astype("<f8").tobytes()], **numbers})

    schema = "weights binary, bias double, bits int, window int, least int"
    made = sample.select("_k", "_t", "_y").repartition(1).mapInPandas(fit, schema).collect()
    if not made:
        return train([], [], **options)
    return Model(np.frombuffer(bytes(made[0]["weights"]), dtype="<f8"), *made[0][1:])


def score(
    docs: DataFrame, model: Model, text: str = "text", out: str = "score", predicted: str = "predicted", cut: float = 0.5
) -> DataFrame:
    """Add the probability that a whole text is toxic, and 1 or 0 for whether it reaches ``cut``.

    Null and empty texts, and texts without a letter or digit, get what the
    model says of a window without words. Columns of ``docs`` with the added
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket, whatever the data

    def build():
        scorer = shared.value.scorer()

        def run(texts):
            scores = scorer(texts)
            return scores, [int(s >= cut) for s in scores]

        return run

    return add_columns(docs, [text], [(out, "double"), (predicted, "int")], build)
