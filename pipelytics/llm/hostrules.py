"""Quality rules judged by host.

Each document is measured and held against a few rules. The rates at which a
host's documents fail are shrunk towards all hosts' by a beta prior that is
fitted to the hosts, so that a host with a handful of documents is not judged
by them alone. The host's verdict then goes back to its documents: a rejected
host loses them all, a watched one those that fail a rule themselves, and a
trusted one only those that fail the base rules. A host is rejected or trusted
only where its posterior says so with near certainty; all others are watched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import add_columns

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first one included. Exact, no hashes."""
    n = len(words)
    if n <= width:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == n:
        return 0
    # Number the windows of 2, 4 and then 5 words: equal windows get equal numbers, all below n.
    codes, span = ids, 1
    while span < width:
        step = min(span, width - span)
        right = codes if step == span else ids
        pairs = codes[: n - span - step + 1] * n + right[span : span + n - span - step + 1]
        codes = np.unique(pairs, return_inverse=True)[1]
        span += step
    twice = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[twice] += 1
    edge[twice + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of a whole text; all 0 for a null or empty one."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANK)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of whole texts as bigints; columns of the same names are replaced."""

    def build():
        return lambda texts: list(zip(*map(measure, texts), strict=True)) if texts else [[] for _ in MEASURES]

    return add_columns(docs, [text], [(m, "bigint") for m in MEASURES], build)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def soft_failed() -> Column:
    """Many symbols (over one in ten words), or over three in ten lines that repeat an earlier one."""
    return (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


#: Standard deviations of a one-sided certainty of 95 %.
CERTAIN = 1.6448536269514722
#: Prior strength, in documents, beyond which hosts are taken to be alike.
ALIKE = 1e6


def host_rates(measured: DataFrame, host: str, reject: float = 0.5, spread: float = 1.0) -> DataFrame:
    """One row per host: documents, failures, the failure rate shrunk by a fitted beta prior, and ``host_verdict``.

    The prior is fitted by moments of the beta-binomial, weighted by rows: what
    hosts' rates vary beyond the sampling noise that their numbers of documents
    explain. Hosts that vary no more than that give a prior so strong that it
    decides alone, and are all watched. With the posterior taken as normal, a
    host is ``rejected`` if its rate exceeds, with 95 % certainty, both
    ``reject`` and the prior's mean by ``spread`` of its standard deviations
    (one, since very bad hosts widen the prior that they are held against);
    ``trusted`` if it lies, with the same certainty, below the prior's mean;
    ``watched`` otherwise. An empty table gives no hosts.
    """
    failed = (base_failed() | soft_failed()).cast("int")
    per = measured.groupBy(host).agg(F.count(F.lit(1)).alias("host_rows"), F.sum(failed).alias("host_failures"))
    rows, failures = F.col("host_rows").cast("double"), F.col("host_failures").cast("double")
    sums = per.agg(
        F.count(F.lit(1)).cast("double").alias("hosts"), F.sum("host_rows").cast("double").alias("rows"),
        F.sum("host_failures").cast("double").alias("failures"), F.sum(failures * failures / rows).alias("squares"),
        F.sum(rows * rows).alias("square_rows"),
    )
    mean = F.col("failures") / F.col("rows")
    noise = mean * (1 - mean)
    beyond = F.col("squares") - F.col("rows") * mean * mean - noise * (F.col("hosts") - 1)
    room = noise * (F.col("rows") - F.col("square_rows") / F.col("rows") - F.col("hosts") + 1)
    weight = F.when((noise <= 0) | (room <= 0) | (beyond * ALIKE <= room), F.lit(ALIKE)).otherwise(
        F.greatest(room / beyond - 1, F.lit(1.0))
    )
    prior = sums.select(F.struct(mean.alias("mean"), weight.alias("weight"))).scalar()
    m, k = F.col("_prior.mean"), F.col("_prior.weight")
    shrunk, total = F.col("_shrunk"), rows + k
    deviation = F.sqrt(shrunk * (1 - shrunk) / (total + 1))
    bar = F.greatest(F.lit(reject), m + spread * F.sqrt(m * (1 - m) / (k + 1)))
    verdict = (
        F.when(shrunk - CERTAIN * deviation > bar, "rejected")
        .when(shrunk + CERTAIN * deviation < m, "trusted")
        .otherwise("watched")
    )
    posterior = per.withColumn("_prior", prior).withColumn("_shrunk", (failures + m * k) / total)
    return posterior.select(
        host, "host_rows", "host_failures", F.round(shrunk, 6).alias("host_rate"), verdict.alias("host_verdict")
    )


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    reject: float = 0.5,
    spread: float = 1.0,
) -> DataFrame:
    """One row per document: key, host, measures, ``base_failed``, ``host_rate``, ``host_verdict`` and ``kept``.

    Kept is a document that passes the base rules, whose host is not rejected,
    and which passes the soft rules too unless its host is trusted (see
    ``host_rates``). Null hosts count as one host. Repeated rows count each.
    """
    columns = docs.select(F.col(key).alias("_key"), F.col(host).alias("_on"), F.col(text).alias("_text"))
    measured = materialise(measures(columns, "_text").drop("_text"), "measures")
    # One row per host, with its size known from the files: Spark broadcasts it only if it is small.
    hosts = materialise(host_rates(measured, "_on", reject, spread).withColumnRenamed("_on", "_host"), "hosts")
    state = F.col("host_verdict")
    verdict = ~base_failed() & (state != "rejected") & (~soft_failed() | (state == "trusted"))
    return measured.join(hosts, F.col("_on").eqNullSafe(F.col("_host"))).select(
        F.col("_key").alias(key), F.col("_on").alias(host), *MEASURES, base_failed().alias("base_failed"), "host_rate",
        "host_verdict", verdict.alias("kept"),
    )
