"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pipelytics.llm import spelling
from pipelytics.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts, ratio=5):
    """Word: form, root, n, n_near, form_n."""
    links = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for size in (len(w) - 1, len(w), len(w) + 1):
            links[w] += [v for v in by_length.get(size, ()) if near(w, v)]
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None)
    return out


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def random_words(rng, letters, number, least=6, most=10):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(number)}
    for w in list(words)[: number // 2]:
        at = rng.randrange(len(w) + 1)
        words |= {w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]}
        if len(w) > least:
            words.add(w[: at - 1] + w[at:] if at else w[1:])
    return {w for w in words if len(w) >= least}


@pytest.mark.parametrize("letters, number", [("ab", 300), ("abcdefgh", 400), ("aàÿz", 300)])
def test_against_all_pairs(spark, letters, number):
    rng = random.Random(number)
    counts = {w: rng.choice([5, 6, 25, 30, 125, 700]) for w in random_words(rng, letters, number)}
    assert result(spelling.variants(frame(spark, counts))) == expected(counts)
    # Shards of a few words: nearly all halves are crowded, and are dealt into cells.
    assert result(spelling.variants(frame(spark, counts), shard_words=9)) == expected(counts)


def test_runs_of_one_letter(spark):
    counts = {"a" * n: 5 ** (n % 5) * 5 for n in range(6, 60)} | {"a" * 3000: 5, "a" * 3001: 25, "a" * 3000 + "b": 125}
    assert result(spelling.variants(frame(spark, counts))) == expected(counts)


def test_no_words(spark):
    assert spelling.variants(frame(spark, {"x": 1}).limit(0)).count() == 0
    assert result(spelling.variants(frame(spark, {"single": 7}))) == {"single": (None, "single", 7, 0, None)}


def test_long_chain_of_forms(spark):
    counts = {"abcdef" + "x" * k: 5 ** (k + 1) for k in range(12)}
    got = result(spelling.variants(frame(spark, counts)))
    assert got == expected(counts)
    assert got["abcdef"][1] == "abcdef" + "x" * 11


def test_suffix_ranks():
    words = sorted({"banana", "ananas", "nanas", "anna", "nab"})
    index = spelling.FMIndex(words)
    letter = {c: i for i, c in enumerate("\0abns")}
    low, high = np.array([0]), np.array([len(words)])
    for c in "sana"[0:4]:
        low, high = index.extend(np.array([letter[c]]), low, high)
    # ananas and nanas end in "anas".
    assert int((high - low)[0]) == 2


def words_of(rows, period=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % period == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_counted_words(spark):
    rows = [(i, f"Ñandúes ÑANDÚES straße {'letters ' * (i % 4)}x{i % 3}Words İstanbul") for i in range(400)]
    rows += [(None, "letters words"), (7, None), (8, ""), (9, "z" * 200_000 + " " + "word" * 50_000)] + [(9, "abcdefg" * 1000)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: r.n for r in spelling.counted_words(docs, period=19, remember=5).collect()}
    assert got == words_of(rows, 19)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = words_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(counts) > 100
    assert result(QUERIES["op13_spelling_variants"](spark, FOLDER)) == expected(counts)
