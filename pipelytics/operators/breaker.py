"""Circuit breakers over ordered calls, folded chunk by chunk.

What a run of calls does to a breaker depends on the calls before it only
through the state in which the breaker arrives. Each chunk of a task's calls is
therefore summarised on its own as a map from arriving to leaving states, by
many tasks at once. One light pass per task then puts the maps together, a
lookup per chunk and not a step per call, and with its arriving state known
each chunk tells its changes, again on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: A breaker's state: open or not, straight failures while closed, time of opening in microseconds.
STATES = "task string, is_open boolean, straight int, since bigint"
CHANGES = "task string, us bigint, state string"
_CHUNKS = (
    "task string, part int, seq bigint, us array<bigint>, ok array<boolean>, until array<bigint>, to_open array<boolean>, "
    "to_straight array<int>, to_since array<bigint>, from_open array<boolean>, from_straight array<int>, from_since array<bigint>"
)
_ENTRIES = "task string, part int, seq bigint, is_open boolean, straight int, since bigint, n_open boolean, n_straight int, n_since bigint"
State = tuple[bool, int, int]


class Chunk:
    """Ordered calls of one task, as jumps between the calls at which a breaker can change."""

    def __init__(self, us, ok, failures: int, cooldown: int):
        self.us, self.ok = np.asarray(us, dtype=np.int64), np.asarray(ok, dtype=bool)
        self.failures, self.cooldown = failures, cooldown
        self.size = n = len(self.us)
        at = np.arange(n)
        #: Straight failures that end at each call, counted from the chunk's start.
        self.run = at - np.maximum.accumulate(np.where(self.ok, at, -1))
        self.full = np.flatnonzero(self.run >= failures)
        # A call on which an open breaker is tried: if it fails the breaker opens there, else it opens at the
        # first call that completes enough failures after it, if any.
        opening = np.where(self.ok, self._opening(at + 1), at)
        self.opening = opening
        self.trial = self._trial(opening)

    def _opening(self, start):
        """The call that opens a breaker which is closed, without failures, before call ``start``; ``size`` if none does."""
        found = np.searchsorted(self.full, np.asarray(start) + self.failures - 1)
        return np.append(self.full, self.size)[found]

    def _trial(self, opening):
        """The first call on which a breaker that opened at a call is tried; ``size`` if none is."""
        opening = np.asarray(opening)
        since = np.append(self.us, 0)[opening]
        found = np.maximum(np.searchsorted(self.us, since + self.cooldown), opening + 1)
        return np.where(opening == self.size, self.size, found)

    def _leaving(self, trial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaving states by the last call on which the breaker is tried."""
        opening = self.opening[trial]
        is_open = opening < self.size
        straight = np.where(is_open, 0, np.minimum(self.run[-1], self.size - 1 - trial))
        return is_open, straight, np.where(is_open, self.us[np.minimum(opening, self.size - 1)], 0)

    def _first(self, state: State) -> tuple[int, int]:
        """The call that opens the breaker and the one on which it is next tried, from an arriving state; ``size`` if none."""
        is_open, straight, since = state
        if is_open:
            return self.size, int(np.searchsorted(self.us, since + self.cooldown))
        lead = int(np.argmax(self.ok)) if self.ok.any() else self.size
        opening = self.failures - straight - 1 if straight + lead >= self.failures else int(self._opening(0))
        return opening, int(self._trial(opening))

    def summary(self) -> dict:
        """Leaving states: for breakers that arrive open by the time their cool-down ends, for closed ones by their failures."""
        last, step = np.arange(self.size), np.append(self.trial, self.size)
        while True:  # follow the jumps to the last trial, twice as far each time
            further = step[last]
            if (further == self.size).all():
                break
            last = np.where(further == self.size, last, further)
            step = np.append(np.where(step[step[:-1]] == self.size, step[:-1], step[step[:-1]]), self.size)
        exits = self._leaving(last)
        ends = np.ones(self.size, dtype=bool)
        ends[:-1] = np.any([e[1:] != e[:-1] for e in exits], axis=0)
        lead = int(np.argmax(self.ok)) if self.ok.any() else self.size
        closed = []
        for straight in range(self.failures):
            opening, trial = self._first((False, straight, 0))
            if opening == self.size:
                closed.append((False, int(self.run[-1]) + (straight if lead == self.size else 0), 0))
            elif trial == self.size:
                closed.append((True, 0, int(self.us[opening])))
            else:
                closed.append(tuple(e[trial].item() for e in exits))
        names = ("to_open", "to_straight", "to_since")
        found = {"until": self.us[ends]} | {n: e[ends] for n, e in zip(names, exits, strict=True)}
        return found | dict(zip(("from_open", "from_straight", "from_since"), map(list, zip(*closed, strict=True)), strict=True))

    def changes(self, state: State) -> list[tuple[int, str]]:
        """The changes of a breaker that arrives in a state; as many steps as there are changes."""
        out = []
        opening, trial = self._first(state)
        if opening < self.size:
            out.append((int(self.us[opening]), "open"))
        while trial < self.size:
            out.append((int(self.us[trial]), "half_open"))
            out.append((int(self.us[trial]), "closed" if self.ok[trial] else "open"))
            if self.ok[trial] and self.opening[trial] < self.size:
                out.append((int(self.us[self.opening[trial]]), "open"))
            trial = int(self.trial[trial])
        return out


def leave(row, state: State, cooldown: int) -> State:
    """The state in which a breaker leaves a summarised chunk."""
    is_open, straight, since = state
    if not is_open:
        return bool(row.from_open[straight]), int(row.from_straight[straight]), int(row.from_since[straight])
    k = int(np.searchsorted(row.until, since + cooldown))
    return state if k == len(row.until) else (bool(row.to_open[k]), int(row.to_straight[k]), int(row.to_since[k]))


def fold_calls(
    calls: DataFrame, states: DataFrame | None, failures: int, cooldown: int, chunk: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """Changes of the breakers on ``calls`` (task, us, attempt_id, ok), and the states in which their tasks leave.

    ``states`` holds arriving states by task; a task without one is closed. A
    task is cut into chunks of at most ``chunk`` calls, so one that holds most
    calls is sorted, summarised and read by many tasks.
    """
    if failures < 1:
        raise ValueError("failures must be at least 1")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for batch in batches:
            task = batch["task"]
            starts = np.flatnonzero((task != task.shift()) & ~(task.isna() & task.shift().isna()) | (np.arange(len(batch)) == 0))
            rows = []
            for begin, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                for low in range(begin, end, chunk):
                    piece = batch.iloc[low : min(low + chunk, end)]
                    made = Chunk(piece["us"], piece["ok"], failures, cooldown)
                    first = {"task": piece["task"].iloc[0], "part": piece["part"].iloc[0], "seq": seq}
                    rows.append(first | {"us": made.us, "ok": made.ok} | made.summary())
                    seq += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), (False, 0, 0)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.task != held:
                    held, state = row.task, (bool(row.is_open), int(row.straight), int(row.since))
                after = leave(row, state, cooldown)
                rows.append((row.task, row.part, row.seq, *state, *after))
                state = after
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRIES.split(", ")])

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = Chunk(r.us, r.ok, failures, cooldown).changes((bool(r.is_open), int(r.straight), int(r.since)))
                rows += [(r.task, us, to) for us, to in found]
            yield pd.DataFrame(rows, columns=["task", "us", "state"])

    order = ["task", "us", "attempt_id", "ok"]
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = calls.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Written once: all later steps see the same chunks even if a task is run again.
    chunks = materialise(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(cut, _CHUNKS), "chunks")

    maps = chunks.drop("us", "ok")
    arriving = (F.lit(False), F.lit(0), F.lit(0).cast("bigint"))
    if states is not None:
        stored = states.withColumnRenamed("task", "_task")
        maps = maps.join(stored, F.col("task").eqNullSafe(F.col("_task")), "left").drop("_task")
        arriving = tuple(F.coalesce(F.col(c), d) for c, d in zip(("is_open", "straight", "since"), arriving, strict=True))
    maps = maps.withColumns(dict(zip(("is_open", "straight", "since"), arriving, strict=True)))
    in_order = maps.repartition(n, "task").sortWithinPartitions("task", "part", "seq")
    entries = materialise(in_order.mapInPandas(fold, _ENTRIES), "entries")

    placed = entries.select("part", "seq", "is_open", "straight", "since")
    changes = chunks.select("task", "part", "seq", "us", "ok").join(placed, ["part", "seq"])
    changes = changes.select("task", "us", "ok", "is_open", "straight", "since").mapInPandas(tell, CHANGES)
    last = F.max_by(F.struct("n_open", "n_straight", "n_since"), F.struct("part", "seq"))
    leaving = entries.groupBy("task").agg(last.alias("_last")).select(
        "task", F.col("_last.n_open").alias("is_open"), F.col("_last.n_straight").alias("straight"), F.col("_last.n_since").alias("since")
    )
    return changes, leaving
