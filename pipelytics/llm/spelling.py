"""Spelling variants by search schemes on a bidirectional FM-index over the delimited vocabulary.

Two words are near if one inserted, deleted or replaced code point tells them
apart. One error leaves one half of a word as it is, so two searches find all of
a word's near words: match its second half exactly from the end delimiter and
extend to the left across the first half, or match its first half exactly from
the front delimiter and extend to the right across the second, with one error
in the part extended across. Both walk intervals of suffix ranks. The index has
a direction for each search (``FMIndex`` over the words, and over the reversed
words); a search never turns round, so each direction is cut into shards on its
own, by the very half that its search matches exactly: a shard holds the words
that share some halves and the queries that ask for them, and is searched in one
group. A half that too many words share is dealt into cells of an index block
and a query block, so no group grows with the data.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Runs of letters, once A-Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")


def counted_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", period: int = 199, least_length: int = 6,
    least_count: int = 5, remember: int = 300_000,
) -> DataFrame:
    """``word, n``: the letter runs of all whole texts with their counts, of those long and frequent enough.

    Only A-Z are lower-cased. A run whose CRC-32 of ``<key>:<run>`` is divisible
    by ``period`` loses one code point, the one at CRC-32 modulo length. A null
    text has no words, a null key counts as empty. Tasks add up to ``remember``
    words before they pass them on, so a frequent word is one row per task and flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}

        def packed() -> pa.RecordBatch:
            words, counts = pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())
            totals.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                whole = texts[i].as_py()
                if not whole:
                    continue
                start = zlib.crc32(f"{keys[i].as_py() or ''}:".encode())
                runs = _RUN.findall(whole.encode().lower().decode())  # bytes.lower() changes A-Z only
                counts: dict[str, int] = {}
                for word in runs:
                    counts[word] = counts.get(word, 0) + 1
                for word, n in counts.items():
                    if len(word) < least_length:
                        continue
                    code = zlib.crc32(word.encode(), start)
                    if code % period == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    totals[word] = totals.get(word, 0) + n
                if len(totals) > remember:
                    yield packed()
        if totals:
            yield packed()

    partial = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the index -----------------------------------------------------------


class FMIndex:
    """Suffix ranks of delimited words, sorted and distinct, searched from the end of a word to its front.

    Every word ends in a delimiter of its own, delimiters sort first and in the
    order of the words. Ranks of a letter are counted by 64-bit blocks, with a running
    count before each block.
    """

    def __init__(self, words: list[str]):
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        self.letters, text = np.unique(points, return_inverse=True)  # code 0 is the delimiter
        self.size, self.words = len(text), len(words)
        order = self._suffixes(text.astype(np.int64))
        before = text[order - 1]  # the text is a circle: a delimiter stands before the first word, too
        # A last row stands for every letter that no word has: its intervals are empty.
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.letters))))).astype(np.int64)
        blocks = self.size // 64 + 1
        self.bits = np.zeros((len(self.letters) + 1, blocks), dtype=np.uint64)
        for c in range(len(self.letters)):
            packed = np.packbits(before == c, bitorder="little")
            room = np.zeros(blocks * 8, dtype=np.uint8)
            room[: len(packed)] = packed
            self.bits[c] = room.view("<u8")
        self.upto = np.zeros(self.bits.shape, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.bits[:, :-1]), axis=1, out=self.upto[:, 1:])

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes, by prefix doubling."""
        ends = text == 0
        rank = text + self.words
        rank[ends] = np.arange(self.words)
        step = 1
        while True:
            behind = np.zeros_like(rank)
            behind[:-step] = rank[step:] + 1
            both = rank * (self.size + self.words + len(self.letters) + 2) + behind
            order = np.argsort(both, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
            rank = np.empty_like(rank)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == self.size - 1 or step >= self.size:
                return order

    def codes(self, words: list[str], width: int) -> np.ndarray:
        """Letters of words from the last to the first, as a matrix padded with 0."""
        flat = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), dtype="<u4")
        place = np.searchsorted(self.letters, flat)
        known = self.letters[np.minimum(place, len(self.letters) - 1)] == flat
        return np.where(known, place, len(self.letters)).reshape(len(words), width)

    def occurrences(self, letter: np.ndarray, upto: np.ndarray) -> np.ndarray:
        block, rest = upto >> 6, (upto & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.upto[letter, block] + np.bitwise_count(self.bits[letter, block] & mask)

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a letter more in front."""
        return self.first[letter] + self.occurrences(letter, low), self.first[letter] + self.occurrences(letter, high)

    def near(
        self, words: list[str], exact: np.ndarray, own: np.ndarray, cells: int = 500_000
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(query, word)``: words one error away from a query, the error outside its last ``exact`` letters.

        ``own``: 1 for queries that the index holds as words, else 0.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        by_length = np.argsort(lengths, kind="stable")
        found = []
        at = 0
        while at < len(words):
            most = at + 1
            while most < len(words) and (most + 1 - at) * lengths[by_length[most]] <= cells and most - at < 8192:
                most += 1
            chosen = by_length[at:most]
            queries, hits = self._scheme([words[k] for k in chosen], lengths[chosen], exact[chosen], own[chosen])
            found.append((chosen[queries], hits))
            at = most
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])

    def _scheme(
        self, words: list[str], lengths: np.ndarray, exact: np.ndarray, own: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """One search for a batch of queries, letter by letter.

        ``live`` are intervals without an error, one per query; ``one`` are those
        with an error, as rows of query, low and high, equal ones merged, so that
        runs of one letter do not multiply them. An interval that holds the
        query's own word only can lead to no other.
        """
        coded = self.codes(words, int(lengths.max()) + 1)
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.words, dtype=np.int64)
        live = np.arange(len(words))
        one = np.zeros((3, 0), dtype=np.int64)
        results = []
        others = np.arange(1, len(self.letters))
        for t in range(int(lengths.max()) + 1):
            live = live[(lengths[live] >= t) & (high[live] - low[live] > own[live])]
            if not len(live) and not one.shape[1]:
                break
            erring = live[exact[live] <= t]
            later = np.zeros((3, 0), dtype=np.int64)
            if len(erring):
                # An extra letter in the other word, or another letter in the place of the query's.
                q, letter = np.repeat(erring, len(others)), np.tile(others, len(erring))
                begin, end = self.extend(letter, low[q], high[q])
                some = begin < end
                q, letter, begin, end = q[some], letter[some], begin[some], end[some]
                one = np.concatenate([one, np.stack([q, begin, end])], axis=1)
                going = lengths[q] > t
                q, letter, begin, end = q[going], letter[going], begin[going], end[going]
                differs = coded[q, t] != letter
                skipped = erring[lengths[erring] > t]  # the other word lacks the query's letter
                later = np.concatenate(
                    [np.stack([q, begin, end])[:, differs], np.stack([skipped, low[skipped], high[skipped]])], axis=1
                )
            if one.shape[1]:
                one = np.unique(one, axis=1)
                over = lengths[one[0]] == t
                results.append(self._finished(one[:, over]))
                one = one[:, ~over]
                begin, end = self.extend(coded[one[0], t], one[1], one[2])
                some = begin < end
                one = np.stack([one[0], begin, end])[:, some]
            one = np.concatenate([one, later], axis=1)
            live = live[lengths[live] > t]
            low[live], high[live] = self.extend(coded[live, t], low[live], high[live])
        if not results:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = np.unique(np.concatenate(results, axis=1), axis=1)
        return pairs[0], pairs[1]

    def _finished(self, states: np.ndarray) -> np.ndarray:
        """Pairs of query and word of the states before which a word begins: its rank among such is its place."""
        zero = np.zeros(states.shape[1], dtype=np.int64)
        begin, end = self.occurrences(zero, states[1]), self.occurrences(zero, states[2])
        whole = begin < end
        # Words are distinct and states hold all of a word's letters, so at most one word begins here. The first
        # row of the delimiter's block belongs to the last word's end, and the text's circle keeps the order.
        return np.stack([states[0][whole], begin[whole]])


def near_in_shard(words: list[str], queries: list[str], counts: dict[str, int], second: bool) -> list[tuple]:
    """``(query, n, near words, count of the largest, that word)`` per query; ties go to the least word.

    ``second``: the second halves match exactly, else the first ones. A pair that
    both searches find, as a letter between the halves can be put into either,
    counts for the search with the first halves.
    """
    facing = (lambda w: w) if second else (lambda w: w[::-1])
    held = sorted(facing(w) for w in words)
    index = FMIndex(held)
    halves = np.array([len(w) - len(w) // 2 if second else len(w) // 2 for w in queries], dtype=np.int64)
    known = set(words)
    own = np.array([w in known for w in queries], dtype=np.int64)
    found, hits = index.near([facing(w) for w in queries], halves, own)
    number = [0] * len(queries)
    best: list[tuple[int, str] | None] = [None] * len(queries)
    for q, w in zip(found.tolist(), hits.tolist(), strict=True):
        query, near = queries[q], facing(held[w])
        if second and near.startswith(query[: len(query) // 2]):
            continue
        number[q] += 1
        place = (-counts[near], near)
        if best[q] is None or place < best[q]:
            best[q] = place
    return [
        (w, counts[w], k, -b[0] if b else None, b[1] if b else None)
        for w, k, b in zip(queries, number, best, strict=True)
    ]


# ---- shards --------------------------------------------------------------


def _keys(word: Column) -> Column:
    """The halves under which a word is found: ``second`` or first, the half, and whether the word asks for it, too.

    A query of length l asks for its half; a near word has between l - 1 and
    l + 1 letters, so a word is held under the halves that such queries have.
    """
    length = F.char_length(word)
    rows = []
    for second in (False, True):
        half = lambda n: (n - F.floor(n / 2) if second else F.floor(n / 2)).cast("int")  # noqa: B023, E731
        cut = lambda n: F.right(word, n) if second else F.left(word, n)  # noqa: B023, E731
        own = half(length)
        for change in (-1, 0, 1):
            size = half(length + change)
            row = F.struct(F.lit(second).alias("second"), cut(size).alias("half"), F.lit(change == 0).alias("asks"))
            rows.append(row if change == 0 else F.when(size != own, row))
    return F.array_compact(F.array(*rows))


def near_words(vocabulary: DataFrame, shard_words: int = 40_000) -> DataFrame:
    """``word, n, n_near, near_n, near`` per word: how many near words, and the one with the largest ``n``.

    ``vocabulary`` has distinct words and their ``n``, and is read several times.
    Shards hold about ``shard_words`` words; of a half that more words share, every
    block of words meets every block of queries.
    """
    keyed = vocabulary.select("word", "n", F.inline(_keys(F.col("word"))))
    total = vocabulary.count()
    hot = materialise(
        keyed.groupBy("second", "half")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > shard_words)
        .withColumn("parts", F.ceil(F.col("held") / shard_words).cast("int"))
        .drop("held"),
        "hot-halves",
    )
    shards = max(1, -(-4 * total // shard_words))
    no_key, zero = F.lit(None).cast("string").alias("hot"), F.lit(0)
    if hot.isEmpty():
        usual, dealt = keyed, None
    else:
        usual = keyed.join(hot, ["second", "half"], "left_anti")
        crowded = keyed.join(hot, ["second", "half"]).withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        cell = lambda block, asking, asks: F.struct(
            block.alias("block"), asking.alias("asking"), F.lit(not asks).alias("held"), F.lit(asks).alias("asks")
        )
        cells = F.concat(
            F.transform(every, lambda k: cell(F.col("own"), k, False)),
            F.when(F.col("asks"), F.transform(every, lambda k: cell(k, F.col("own"), True))).otherwise(F.array()),
        )
        dealt = crowded.select(
            "word", "n", "second", zero.alias("shard"), F.col("half").alias("hot"), F.inline(cells)
        )
    spread = usual.select(
        "word", "n", "second", F.pmod(F.xxhash64("half"), F.lit(shards)).cast("int").alias("shard"), no_key,
        zero.alias("block"), zero.alias("asking"), F.lit(True).alias("held"), "asks",
    )
    rows = spread if dealt is None else spread.unionByName(dealt)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(group["word"], group["n"].tolist(), strict=True))
        words = group.loc[group["held"], "word"].unique().tolist()
        queries = group.loc[group["asks"], "word"].unique().tolist()
        if words and queries:
            made = near_in_shard(words, queries, counts, bool(group["second"].iloc[0]))
        else:
            made = [(w, counts[w], 0, None, None) for w in queries]
        out = pd.DataFrame(made, columns=["word", "n", "n_near", "near_n", "near"])
        return out.astype({"n": "int64", "n_near": "int64", "near_n": "Int64"})

    found = rows.groupBy("second", "shard", "hot", "block", "asking").applyInPandas(
        search, "word string, n bigint, n_near bigint, near_n bigint, near string"
    )
    place = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), "near"))
    best = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(place).alias("best"))
    return best.select("word", "n", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` without cycles: the last form on the way, found in doubling steps."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        ahead = state.join(on, F.col("root") == F.col("_at"), "left")
        state = materialise(
            ahead.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots"
        )
        moved = not state.where("_moved").isEmpty()
        state = state.drop("_moved")
        if not moved:
            return state


def variants(vocabulary: DataFrame, ratio: int = 5, shard_words: int = 40_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``vocabulary`` (``word, n``).

    A word's form is its near word of largest ``n`` (ties: the least by code
    points) if that ``n`` is at least ``ratio`` times the word's; the root is
    the end of the chain of forms. Words that repeat in ``vocabulary`` must have been
    added up; an empty one gives an empty table.
    """
    near = near_words(vocabulary, shard_words)
    formed = materialise(
        near.withColumn("form", F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near"))).withColumn(
            "form_n", F.when(F.col("form").isNotNull(), F.col("near_n"))
        ),
        "forms",
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
