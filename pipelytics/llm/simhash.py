"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 3 bits apart meet in a point that is at most 1 bit
from one and 2 bits from the other. Every fingerprint therefore emits itself
and its 64 neighbours. Points 2 bits away are needed only for pairs 3 apart,
which differ in parity, so only fingerprints of odd parity emit them; and as
two of any three bits lie in the same half of the word, only pairs of bits
within a half. That is 1,057 points for an odd and 65 for an even fingerprint,
and no two fingerprints within the radius miss each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import materialise
from .common import add_columns

_BITS, _HALF, _RADIUS = 64, 32, 3


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


NEAR = [0] + [_signed(1 << i) for i in range(_BITS)]
FAR = [
    _signed(1 << i | 1 << j)
    for base in range(0, _BITS, _HALF)
    for i in range(base, base + _HALF)
    for j in range(base, i)
]


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text as a signed number; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    if len(words) < width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        hashes = [
            xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, stops[width - 1 :], strict=False)
        ]
    counts = np.zeros(_BITS, dtype=np.int64)
    for start in range(0, len(hashes), 100_000):
        part = np.array(hashes[start : start + 100_000], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", width: int = 3) -> DataFrame:
    """Add the SimHash of whole texts as a bigint.

    Words are runs without ASCII white space, A-Z in lower case. Null texts
    count as empty; texts without words have fingerprint 0.
    """
    return add_columns(docs, [text], [(out, "bigint")], lambda: lambda texts: [[simhash(t, width) for t in texts]])


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(fp, hub)`` of fingerprints within the radius, from distinct non-null fingerprints ``fp``.

    In each bucket every member is linked to one fingerprint that is at most 1
    bit from the bucket's point. A pair within the radius shares such a bucket,
    so the links connect the same groups as all pairs would, without emitting
    all pairs of a bucket.
    """
    def points(source: DataFrame, masks: list[int]) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
        return source.select("fp", mask.alias("mask")).select(
            F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp"
        )

    near = points(fps, NEAR)
    far = points(fps.where(F.bit_count("fp") % 2 == 1), FAR)
    # Points hardly repeat: shuffle them once instead of combining them beforehand.
    hubs = near.repartition("point").groupBy("point").agg(F.min("fp").alias("hub"))
    met = near.unionByName(far).join(hubs.hint("shuffle_hash"), "point").where("fp <> hub")
    verified = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= _RADIUS
    return met.select("fp", "hub").where(verified).distinct()


def _salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join with few rows per key on the right; a key with many rows on the left is spread over ``salts`` tasks."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``, the root being the smallest node that it reaches.

    Alternates the large-star and small-star steps, which turn each component
    into a star around its smallest node in a logarithmic number of rounds.
    Each round is written to the shared folder. Joins on a hub are salted.
    """
    down = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialise(edges.where("u <> v").select(*down).distinct(), "edges")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    state = now.agg(*print_of).first()
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _salted_join(both.where("v > u"), least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted_join(large, best, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        grown = small.unionByName(best.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(grown, "edges")
        before, state = state, now.agg(*print_of).first()
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``key``, ``simhash`` (bigint) and ``component_id``, the smallest key that it reaches.

    Repeated rows and equal keys each keep a row. Null keys never become a
    component's id unless a component has no other; it is then null.
    """
    tagged = materialise(
        fingerprints(docs.select(F.col(key), F.col(text).alias("_text")), "_text", width=width).select(key, "simhash"),
        "fingerprints",
    )
    fps = materialise(
        tagged.groupBy(F.col("simhash").alias("fp")).agg(F.min(key).alias("least")), "distinct-fingerprints"
    )
    found = components(links(fps.select("fp")).select(F.col("fp").alias("u"), F.col("hub").alias("v")))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialise(
        _salted_join(rooted.select("fp", "root"), named, "root").select(F.col("fp").alias("simhash"), "component_id"),
        "groups",
    )
    return tagged.join(groups, "simhash").select(key, "simhash", "component_id")


def hex_of(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
