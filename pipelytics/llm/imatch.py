"""I-Match fingerprints: hashes of a document's mid-frequency terms under several randomised lexicons.

Built-in functions only. A term is a run without ASCII white space. Terms whose
document frequency lies in a band are the lexicon; subset ``k`` of it holds the
terms that a hash with ``k`` draws with that subset's probability. Part ``k``
of a fingerprint is the hash of the document's distinct, sorted terms in the
subset. Sparse subsets tell long documents apart after an edit, dense ones
short documents; the likeness of two fingerprints is the share of equal parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import range_segments

#: Shares of the lexicon in the subsets, in 1/4096.
SUBSETS = tuple(share for share in (2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4) for _ in range(3))
#: Stands for a null key.
LEAST = -(1 << 63)
#: A part that holds no term: the first digits of the MD5 hash of nothing.
NOTHING = "d41d8cd9"


def terms(text: Column) -> Column:
    """The distinct terms of a text, and the empty term, which every text has."""
    return F.array_union(F.array(F.lit("")), F.split(text, r"[\x20\x09-\x0D]+"))


def lexicon(docs: DataFrame, low: float, high: float, subsets: Sequence[int] = SUBSETS, text: str = "text") -> DataFrame:
    """``(term, subsets)`` for the terms in at least ``low`` and at most ``high`` of all documents.

    ``subsets`` lists, as bits, the subsets that draw the term. A term in
    ``low`` of all documents or more is one of at most (terms per document /
    ``low``), however many documents there are: that bounds this table.
    """
    # The outer form spares a size check of the array, which would compute it twice; the same below.
    rows = docs.select(F.explode_outer(terms(F.col(text))).alias("term")).where("term <> ''")
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    total = docs.select(F.count(F.lit(1))).scalar()
    banded = counted.where((F.col("_df") >= F.ceil(total * low)) & (F.col("_df") <= F.floor(total * high)))
    limits = F.array(*[F.lit(f"{share:03x}") for share in subsets])

    def drawn(taken: Column, k: Column) -> Column:
        place = F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), F.col("term"))), 1, 3)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        return F.when(place < F.element_at(limits, k + 1), taken + bit).otherwise(taken)

    mask = F.aggregate(F.sequence(F.lit(0), F.lit(len(subsets) - 1)), F.lit(0).cast("bigint"), drawn)
    return banded.select("term", mask.alias("subsets"))


def likeness(a: Column, b: Column, n: int = len(SUBSETS)) -> Column:
    """Share of equal parts among those that hold a term in either; two without terms are alike."""
    places = F.sequence(F.lit(0), F.lit(n - 1))
    part = lambda f, k: F.substring(f, 8 * k + F.lit(1), F.lit(8))
    held = F.size(F.filter(places, lambda k: (part(a, k) != NOTHING) | (part(b, k) != NOTHING)))
    same = F.size(F.filter(places, lambda k: (part(a, k) != NOTHING) & (part(a, k) == part(b, k))))
    return F.when(held > 0, same / held).otherwise(F.lit(1.0))


def fingerprints(
    texts: DataFrame,
    lexicon_terms: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    out: str = "fingerprint",
    parts: int = len(SUBSETS),
) -> DataFrame:
    """``keys`` and the fingerprint of each text, in parts of 8 hex digits. Rows with equal keys must hold equal texts and become one.

    The lexicon is broadcast: its number of rows is bounded (see ``lexicon``).
    Terms outside it vanish before the terms of a text are gathered, which takes
    no shuffle if ``texts`` are partitioned by ``keys`` or some of them. A text
    with terms but none in the lexicon is fingerprinted by the text itself, a
    null text or one without terms by empty parts.
    """
    # The empty term of every text, put into the lexicon, keeps texts that have no other.
    known = lexicon_terms.unionByName(
        lexicon_terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("subsets"))
    )
    full = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    whole = F.when(full, F.substring(F.md5(F.col(text)), 1, 8)).otherwise(F.lit(NOTHING))
    # In a step of its own: next to explode it would be computed for every term.
    held = texts.select(*keys, F.col(text).alias("_text"), whole.alias("_whole"))
    rows = held.select(
        *keys, "_whole", F.explode_outer(F.coalesce(terms(F.col("_text")), F.array(F.lit("")))).alias("term")
    )
    met = rows.join(F.broadcast(known), "term")
    grouped = met.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.struct("term", "subsets"))).alias("_pairs"), F.max("_whole").alias("_whole")
    )

    def part(mask: Column) -> Column:
        mine = F.filter("_pairs", lambda p: p["subsets"].bitwiseAND(mask) != 0)
        return F.substring(F.md5(F.array_join(F.transform(mine, lambda p: p["term"]), " ")), 1, 8)

    own = F.array_join(F.transform(F.array(*[F.lit(1 << k).cast("bigint") for k in range(parts)]), part), "")
    none = F.repeat("_whole", F.lit(parts))
    return grouped.select(*keys, F.when(F.size("_pairs") <= 1, none).otherwise(own).alias(out))


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct (key, text), the next one by ascending key; after the last comes the first.

    Columns: ``id`` and ``hash`` stand for the row, ``next_id`` and
    ``next_hash`` for the next, ``copies`` is how often the row occurs and
    ``n_chars`` its code points. Null keys come first; rows with equal keys are
    ordered by the hash of their text. Ranges of ids are ordered apart, and only
    their first rows meet in one task.
    """
    keys = keyed(docs, key, text).groupBy("id", "hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).cast("bigint").alias("n_chars")
    )
    staged = range_segments(keys, [], ["id", "hash"])
    row = F.struct("id", "hash")
    firsts = staged.groupBy("_seg").agg(F.min(row).alias("_first"))
    by_segment = Window.orderBy("_seg")
    follow = firsts.select(
        F.col("_seg").alias("_s"),
        F.coalesce(F.lead("_first").over(by_segment), F.min("_first").over(Window.partitionBy(F.lit(0)))).alias("_then"),
    )
    ahead = F.lead(row).over(Window.partitionBy("_seg").orderBy("id", "hash"))
    linked = staged.withColumn("_next", ahead).join(F.broadcast(follow), F.col("_seg") == F.col("_s"))
    after = F.coalesce("_next", "_then")
    return linked.select(
        "id", "hash", "copies", "n_chars", after["id"].alias("next_id"), after["hash"].alias("next_hash")
    )


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``hash`` and ``text``; a null text is empty, a null key the least number."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST)).alias("id"),
        F.xxhash64(F.col(key).isNull(), whole).alias("hash"),
        whole.alias("text"),
    )


def edited(docs: DataFrame, links: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``hash``, ``text`` and ``edited``: the last quarter of a text replaced by the head of the next one.

    The quarter is rounded down to whole code points; a shorter next text is
    taken whole.
    """
    base = keyed(docs, key, text)
    wanted = links.select(
        F.col("next_id").alias("id"),
        F.col("next_hash").alias("hash"),
        F.col("id").alias("_id"),
        F.col("hash").alias("_hash"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("_n"),
    )
    heads = base.join(wanted, ["id", "hash"]).select("_id", "_hash", F.expr("substring(text, 1, _n)").alias("_head"))
    # Where the next row occurs several times, so does its head; one of them will do.
    heads = heads.repartition("_id", "_hash").groupBy("_id", "_hash").agg(F.first("_head").alias("_head"))
    joined = base.join(heads, (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash")))
    keep = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    return joined.select("id", "hash", "text", F.concat(keep, "_head").alias("edited"))
