"""Byte-level BPE encoding and decoding on padded numpy matrices.

The distinct pieces of a batch are sorted into matrices by length. In each
round every row of a matrix merges its leftmost pair of least rank; rows
without a mergeable pair leave the matrix, and the merged column is squeezed
out, so that the matrix shrinks as it is worked on.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import add_columns

#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from pairs of ids to the id they merge into."""

    def __init__(self, pairs: dict[tuple[int, int], int], base: int):
        self.base = np.uint64(base)
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.empty = np.uint64(2**64 - 1)
        self.keys = np.full(1 << bits, self.empty, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        keys = np.array([a * base + b for a, b in pairs], dtype=np.uint64)
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == self.empty]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> self.shift

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where the pair does not merge."""
        keys = a.astype(np.uint64).ravel() * self.base + b.astype(np.uint64).ravel()
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(NONE))
        open_ = np.flatnonzero((there != keys) & (there != self.empty))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != self.empty)]
        return out.reshape(a.shape)


class Codec:
    """The vocabulary of a rank file, with the tables that encoding and decoding need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.pattern = pattern
        self.whole = {token: np.uint32(i).tobytes() for token, i in ranks.items()}
        self.pad = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = PairTable(pairs, self.pad + 1)
        self.starts = np.zeros(self.pad, dtype=np.int64)
        self.lengths = np.full(self.pad, -1, dtype=np.int64)
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        at = 0
        for token, i in ordered:
            self.starts[i], self.lengths[i] = at, len(token)
            at += len(token)
        self.bytes = np.frombuffer(b"".join(t for t, _ in ordered), dtype=np.uint8)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        """From a file of lines ``base64(token) rank``; only the driver reads it."""
        with open(path, "rb") as lines:
            split = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(t): int(i) for t, i in split}, pattern)

    def merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge each row of a matrix padded with ``pad`` on the right; (rows, their final ids) in parts."""
        rows = np.arange(len(ids))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        done = []
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                done.append((rows[~live], ids[~live]))
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = best
            stays = np.ones(ids.shape, dtype=bool)
            stays[each, at + 1] = False
            ids = ids[stays].reshape(len(rows), width - 1)
            stays = np.ones(ranks.shape, dtype=bool)
            stays[each, at] = False
            ranks = ranks[stays].reshape(len(rows), width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.pairs.find(ids[right, at[right]], ids[right, at[right] + 1])
            # Pads sit on the right: drop the columns that only hold pads.
            used = width - 1
            while used > 1 and (ids[:, used - 1] == self.pad).all():
                used -= 1
            if used < width - 1:
                ids, ranks = ids[:, :used].copy(), ranks[:, : used - 1].copy()
        if len(rows):
            done.append((rows, ids))
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece, with a heap instead of a matrix row.

        A row of n bytes needs n rounds over n columns, which a piece of a
        million letters could not afford. Linked neighbours and a heap of
        (rank, place) find the leftmost least pair in logarithmic time.
        """
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        cells = np.array(ids)
        first = self.pairs.find(cells[:-1], cells[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            if pair not in known:
                known[pair] = int(self.pairs.find(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] != NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes], widest: int = 256) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        low = 0
        for width in [2 << k for k in range((widest - 1).bit_length())]:
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, 2_000_000 // width)
            for start in range(0, len(mine), step):
                rows = mine[start : start + step]
                flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), dtype=np.uint8)]
                ids = np.full((len(rows), width), self.pad, dtype=np.int32)
                ids[np.arange(width) < lengths[rows][:, None]] = flat
                for part, final in self.merge_rows(ids):
                    kept = final != self.pad
                    packed = final[kept].astype("<u4").tobytes()
                    ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                    begin = 0
                    for row, end in zip(rows[part].tolist(), ends, strict=True):
                        out[row] = packed[begin:end]
                        begin = end
        for i in np.flatnonzero(lengths > low).tolist():
            out[i] = self.merge_long(pieces[i]).astype("<u4").tobytes()
        return out

    def encoder(self, remember: int = 300_000):
        """A function from texts to their packed ids. Pieces met before are looked up, at most ``remember`` of them."""
        split = regex.compile(self.pattern).findall
        known: dict[str, bytes] = {}

        def encode(texts: list[str | None]) -> list[bytes]:
            split_texts = [split(t) if t else [] for t in texts]
            fresh = set().union(*split_texts).difference(known)
            if len(known) + len(fresh) > remember:
                known.clear()
                fresh = set().union(*split_texts)
            known.update((p, self.whole.get(p.encode())) for p in fresh)
            slow = [p for p in fresh if known[p] is None]
            known.update(zip(slow, self.encode_pieces([p.encode() for p in slow]), strict=True))
            return [b"".join(map(known.__getitem__, pieces)) for pieces in split_texts]

        return encode

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """The bytes that packed ids stand for; an id outside the vocabulary is an error."""
        out = []
        for ids in packed:
            ids = np.frombuffer(ids or b"", dtype="<u4").astype(np.int64)
            if len(ids) and (ids.max() >= self.pad or (self.lengths[ids] < 0).any()):
                raise ValueError("an id is not in the vocabulary")
            lengths = self.lengths[ids]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ids) else 0
            out.append(self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes())
        return out


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    """The codec, broadcast: its size is that of the vocabulary, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast(Codec.load(ranks_path, pattern))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Add the token ids of whole texts as packed little-endian unsigned 32-bit numbers, and ``n_tokens``.

    Null and empty texts have no tokens. Texts and pieces of any length are
    encoded whole. A column of ``docs`` named like an added one is replaced.
    """
    codec = _shared(docs, ranks_path, pattern)

    def build():
        encoder = codec.value.encoder()

        def run(texts):
            packed = encoder(texts)
            return packed, [len(p) // 4 for p in packed]

        return run

    return add_columns(docs, [text], [(ids, "binary"), ("n_tokens", "bigint")], build)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the packed ids stand for; null ids give no bytes."""
    codec = _shared(docs, ranks_path, pattern)
    return add_columns(docs, [ids], [(decoded, "binary")], lambda: lambda packed: [codec.value.decode(packed)])


def encode_decode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """``encode`` and then ``decode`` in one pass over the rows, as a check of the round trip."""
    codec = _shared(docs, ranks_path, pattern)

    def build():
        encoder = codec.value.encoder()

        def run(texts):
            packed = encoder(texts)
            return packed, [len(p) // 4 for p in packed], codec.value.decode(packed)

        return run

    return add_columns(docs, [text], [(ids, "binary"), ("n_tokens", "bigint"), (decoded, "binary")], build)
