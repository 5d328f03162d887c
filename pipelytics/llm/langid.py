"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit,
linear in the frequencies of hashed letter n-grams, says how much a text looks
like the languages with +1 there. The language is the one whose codeword loses
least, each bit weighted by its logistic loss; a narrow lead over the second is
flagged.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (1, 2, 3)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the letter n-grams of each text, text after text, and their number per text.

    Letters are in lower case, everything else counts as one space between
    words. An n-gram may begin or end with that space but not cross it.
    """
    lowered = [" " + (t or "").lower() for t in texts]
    codes = np.frombuffer(("".join(lowered) + " ").encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts) + 1), [*map(len, lowered), 1])
    letter = _letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = kept[-1] = True
    # A space before the first word of each text, also where another text ends without letters.
    nexts = np.append(letter[1:], False)
    kept |= nexts & ~letter
    codes, owner, letter = codes[kept], owner[kept], letter[kept]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    double = np.zeros(len(codes), dtype=bool)
    double[1:] = ~letter[1:] & ~letter[:-1]
    codes, owner, letter = codes[~double], owner[~double], letter[~double]
    buckets, owners = [], []
    for n in _ORDERS:
        last = len(codes) - n + 1
        if last <= 0:
            continue
        value = np.zeros(last, dtype=np.uint64)
        for k in range(n):
            value = (value + codes[k : k + last]) * _MIX
            value ^= value >> np.uint64(31)
        if n == 1:
            good = letter[:last]
        elif n == 2:
            good = letter[:last] | letter[1:]
        else:
            good = letter[1 : last + 1] & (letter[:last] | letter[2 : last + 2])
        # A leading space may stem from the text before; the letter after it tells whose n-gram it is.
        mine = np.where(letter[:last], owner[:last], owner[min(1, n - 1) : last + min(1, n - 1)])
        buckets.append(((value[good] * np.uint64(2 * n + 1) * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(mine[good])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owners, minlength=len(texts))[: len(texts)]


def pieces(text: str, most: int) -> list[tuple[str, int]]:
    """Texts of at most ``most`` characters (8 or more) whose n-grams, added or taken away by sign, are those of a text in lower case.

    A text is cut before a character that is no letter, as no n-gram crosses
    one. In a very long word the cut falls between letters; the n-grams at the
    seam are made good by the two letters on either side.
    """
    out, low = [], 0
    while len(text) - low > most:
        cut = low + most
        k = next((k for k in range(cut, max(low, cut - 1000), -1) if not text[k].isalpha()), 0)
        if not k:
            k = cut - 1
            left, right = text[max(low, k - 2) : k], text[k : k + 2]
            out += [(left + right, 1), (left, -1), (right, -1)]
        out.append((text[low:k], 1))
        low = k
    return [*out, (text[low:], 1)]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to seven languages get the exhaustive code: every way to split them in
    two. More get the best of some random codes by least distance.
    """
    if n <= 7:
        columns = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns, dtype=float).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(12 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (length - code @ code.T) / 2 + np.eye(n) * length
        if apart.min() > most:
            best, most = code, apart.min()
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, bits: int):
        self.languages, self.code, self.weights, self.bias, self.bits = languages, code, weights, bias, bits

    def margins(self, texts: list[str | None], most: int = 200_000) -> np.ndarray:
        """One margin per text and bit. Texts are read ``most`` characters at a time, five such pieces at once."""
        sums, total = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, str, int]] = []
        size = 0

        def add() -> None:
            buckets, counts = features([piece for _, piece, _ in held], self.bits)
            owner, sign = np.array([i for i, _, _ in held]), np.array([s for _, _, s in held])
            some = np.flatnonzero(counts)
            if len(some):
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[some]
                found = np.add.reduceat(self.weights[buckets], starts, axis=0)
                np.add.at(sums, owner[some], found * sign[some, None])
                np.add.at(total, owner, counts * sign)
            held.clear()

        for i, text in enumerate(texts):
            for piece, sign in pieces(text.lower(), most) if text else []:
                held.append((i, piece, sign))
                size += len(piece)
                if size >= 5 * most:
                    add()
                    size = 0
        if held:
            add()
        return sums / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None], near: float = 0.7) -> tuple[list, list, list]:
        """Language, score and whether the runner-up is near, per text; ``und`` without a letter."""
        none = [t is None or not any(c.isalpha() for c in t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        loss = 4 * np.logaddexp(0, -self.margins(texts)[:, None, :] * self.code[None]).mean(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(texts)), best]
        return (
            ["und" if n else self.languages[b] for n, b in zip(none, best.tolist(), strict=True)],
            [0.0 if n else float(s) for n, s in zip(none, top.tolist(), strict=True)],
            [bool(n or s < near) for n, s in zip(none, top.tolist(), strict=True)],
        )


def train(texts: list[str | None], languages: list[str], bits: int = 13, epochs: int = 80, decay: float = 1e-3) -> Model:
    """Fit the classifiers of all bits together by accelerated gradient steps on the logistic loss."""
    names = sorted(set(languages))
    code = codewords(len(names)) if names else np.zeros((0, 0))
    empty = np.zeros((1 << bits, code.shape[1]), dtype=np.float32)
    if not code.size:
        return Model(names, code, empty, np.zeros(code.shape[1]), bits)
    place = {n: i for i, n in enumerate(names)}
    goal = code[[place[x] for x in languages]].astype(np.float32)
    x = np.zeros((len(texts), 1 << bits), dtype=np.float32)
    for low in range(0, len(texts), 200):
        buckets, counts = features(texts[low : low + 200], bits)
        owner = np.repeat(np.arange(len(counts)), counts)
        block = np.bincount(owner * (1 << bits) + buckets, minlength=len(counts) << bits).reshape(len(counts), -1)
        x[low : low + len(counts)] = block / np.maximum(counts, 1)[:, None]
    # Rare n-grams vary less; on a common scale each may matter as much as it tells apart.
    scale = 1 / (x.std(axis=0) + 1e-4)
    scale /= np.sqrt(np.square(x * scale).sum(axis=1).mean() + 1e-9)
    x *= scale
    step = 4.0
    balance = np.zeros(len(texts), dtype=np.float32)
    for i in range(len(names)):
        mine = goal @ code[i].astype(np.float32) == code.shape[1]
        balance[mine] = 1 / max(1, mine.sum())
    balance /= balance.sum()
    weights, bias = empty.copy(), np.zeros(code.shape[1], dtype=np.float32)
    ahead_w, ahead_b = weights.copy(), bias.copy()
    for epoch in range(epochs):
        z = (x @ ahead_w + ahead_b) * goal
        slope = -goal * balance[:, None] / (1 + np.exp(np.clip(z, -30, 30)))
        next_w = ahead_w - step * (x.T @ slope + decay * ahead_w)
        next_b = ahead_b - 0.5 * step * slope.sum(axis=0)
        pull = epoch / (epoch + 3)
        ahead_w, ahead_b = next_w + pull * (next_w - weights), next_b + pull * (next_b - bias)
        weights, bias = next_w, next_b
    return Model(names, code, (weights * scale[:, None]).astype(np.float32), bias, bits)


def training_rows(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = 4000,
    rows_per_language: int = 1000,
    most_chars: int = 200_000,
) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, about as many of each language, drawn by a hash of key and text length.

    ``docs`` are the rows that may be learnt from. Rows without language or
    text, and texts beyond ``most_chars``, are left out of the sample.
    """
    able = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_l")).where(
        F.col("_l").isNotNull() & F.col("_t").isNotNull() & (F.length("_t") <= most_chars)
    )
    counts = {r["_l"]: r["n"] for r in able.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    each = min(rows_per_language, max(1, rows // len(counts)))
    shares = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, each / n)])
    draw = F.pmod(F.xxhash64("_k", F.length("_t"), F.lit(9)), F.lit(1_000_000)) / 1e6
    drawn = able.where(draw < shares[F.col("_l")]).toPandas().sort_values(["_l", "_k", "_t"], ignore_index=True)
    return drawn["_t"].tolist(), drawn["_l"].tolist()


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for whole texts.

    Null texts and texts without a letter are ``und`` with score 0. Columns of
    ``docs`` with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times bits, whatever the data
    added = [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")]
    return add_columns(docs, [text], added, lambda: lambda texts: shared.value.predict(texts))
