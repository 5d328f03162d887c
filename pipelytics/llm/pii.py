"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the spans that are certain. The field labels every token that
could be personal data: numbers, and words that hold an ``@``, a digit, or
another token's e-mail name. Neighbouring tokens are linked in a chain; skip
links join a token to the next one in the document that repeats it or resembles
it (same letters and digits once punctuation is dropped, or the same last
digits of a number), so that an entity found once is found again where its
context or form says less. Each repeat is also joined to the first certain token
of its kin, however far away that is.
Marginals come from loopy message passing over each document, until its messages
settle. Node weights are learnt from the patterns' own labels, with the
forms that define the patterns partly hidden, so that context counts too.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.@_-]*|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*|[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern finds, looked for around each ``@`` so that long runs without one cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        tail = _EMAIL_TAIL.match(text, at + 1)
        if tail:
            begin = at
            while begin > free and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            if begin < at:
                found.append((begin, tail.end()))
                free = tail.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The spans that the patterns find, by kind and then start; ends are exclusive, in code points."""
    if not text:
        return []
    spans = []
    if "@" in text:
        spans += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    """Spans as text, by kind as listed and then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


class Graph:
    """The candidate tokens of some documents, their features and their links."""

    def __init__(self, texts: list[str | None], bits: int):
        self.bits = bits
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.label: list[int] = []
        self.full: list[list[int]] = []
        self.blind: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.star: list[tuple[int, int]] = []
        self.base: list[list[tuple[str, int, int]]] = []
        for i, text in enumerate(texts):
            self.base.append(base_spans(text))
            if text and ("@" in text or _DIGIT.search(text)):
                self._add(i, text, self.base[-1])

    def _slot(self, *what) -> int:
        return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=4).digest(), "little") >> (32 - self.bits)

    def _add(self, i: int, text: str, base: list[tuple[str, int, int]]) -> None:
        names = {text[a:b].split("@")[0].lower() for k, a, b in base if k == "email"}
        names = {n for n in names if len(n) >= 6 and any(not c.isalpha() for c in n)}
        starts = {a: k for k, a, b in base}
        # A base span may take in several tokens, or part of one: it stands in their place.
        taken = sorted((a, b, k) for k, a, b in base)
        pieces: list[tuple[int, int, int]] = []
        end = 0
        for a, b, k in taken:
            if a < end:
                continue
            pieces += self._loose(text, end, a, names)
            pieces.append((a, b, 1 + KINDS.index(k)))
            end = b
        pieces += self._loose(text, end, len(text), names)
        del starts
        last, previous = {}, None
        kin: dict[tuple[str, str], list[int]] = {}
        near: set[tuple[int, int]] = set()
        for a, b, label in pieces:
            node = len(self.span)
            token = text[a:b]
            before = text[max(0, a - 40) : a].split()
            after = text[b : b + 40].split()
            digits = re.sub(r"[^0-9]", "", token)
            shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", token))[:24]
            context = [
                self._slot("before", before[-1].lower().strip(":;,.") if before else ""),
                self._slot("after", after[0].lower().strip(":;,.") if after else ""),
                self._slot("bias"),
            ]
            form = [
                self._slot("shape", shape),
                self._slot("digits", min(len(digits), 20)),
                self._slot("luhn", 16 <= len(digits) <= 19 and luhn(digits)),
                self._slot("at", "@" in token),
                self._slot("plus", token.startswith("+"), len(digits) >= 8),
                self._slot("dots", token.count("."), "@" in token),
                self._slot("letters", any(c.isalpha() for c in token)),
            ]
            self.doc.append(i)
            self.span.append((a, b))
            self.label.append(label)
            self.full.append(context + form)
            self.blind.append(context)
            if previous is not None and a - previous[1] <= 3:
                self.chain.append((previous[0], node))
            previous = node, b
            keys = {("same", re.sub(r"[^0-9a-z]", "", token.lower()))}
            if len(digits) >= 9 and not any(c.isalpha() for c in token):
                keys.add(("end", digits[-9:]))
            if "@" in token:
                keys.add(("same", re.sub(r"[^0-9a-z]", "", token.lower().split("@")[0])))
            linked = set()
            for key in keys:
                if len(key[1]) >= 6:
                    if key in last and last[key] not in linked:
                        self.skip.append((last[key], node))
                        linked.add(last[key])
                        near.add((last[key], node))
                    last[key] = node
                    kin.setdefault(key, []).append(node)
        # At most one link per repeat, key and kind: linear in the tokens. Certain tokens need none. Kin without a
        # certain token get no head: beside their path it would only close loops, which count the same evidence anew.
        for nodes in kin.values():
            heads: dict[int, int] = {}
            for node in nodes:
                if self.label[node]:
                    heads.setdefault(self.label[node], node)
            for head in heads.values():
                for node in nodes:
                    pair = min(head, node), max(head, node)
                    if node != head and not self.label[node] and pair not in near:
                        near.add(pair)
                        self.star.append(pair)

    def _loose(self, text: str, low: int, high: int, names: set[str]) -> list[tuple[int, int, int]]:
        """Candidates among the tokens between base spans."""
        out = []
        if high - low < 3:
            return out
        for m in _TOKEN.finditer(text, low, high):
            token = m.group().strip("\"'`.,;:!?<>()[]{}")
            if not token:
                continue
            if "@" in token or _DIGIT.search(token) or token.lower() in names:
                a = m.start() + m.group().index(token)
                out.append((a, a + len(token), 0))
        return out


class Field:
    """Weights of the field: a row of label scores per feature, and what a link adds when its labels agree."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray, bits: int):
        self.weights, self.chain, self.skip, self.bits = weights, chain, skip, bits

    def marginals(self, graph: Graph, rounds: int = 1000, clamp: bool = True, tolerance: float = 1e-3) -> np.ndarray:
        """Label probabilities per token after parallel loopy message passing.

        Tokens of base spans are certain, and tell their links so. A document is
        done once none of its messages is off by ``tolerance`` or more, whatever
        other documents are in the graph. Loopy messages need not settle: those
        that still change after ``rounds`` are taken as they are.
        """
        n, k = len(graph.span), len(LABELS)
        if not n:
            return np.zeros((0, k))
        counts = np.array([len(f) for f in graph.full])
        flat = np.fromiter((x for f in graph.full for x in f), dtype=np.int64, count=int(counts.sum()))
        node = np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(counts)[:-1])))
        label = np.array(graph.label)
        if clamp:
            sure = np.flatnonzero(label > 0)
            node[sure] = -np.inf  # no number of links outweighs certainty
            node[sure, label[sure]] = 0.0
        edges = np.array(graph.chain + graph.skip + graph.star, dtype=np.int64).reshape(-1, 2)
        if len(edges):
            kind = np.repeat([0, 1], [len(graph.chain), len(graph.skip) + len(graph.star)])
            tables = np.stack([self.chain, self.skip])[kind]
            source = np.concatenate([edges[:, 0], edges[:, 1]])
            goal = np.concatenate([edges[:, 1], edges[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            owner = np.array(graph.doc)[source]
            messages = np.zeros((len(source), k))
            live = np.arange(len(source))
            for _ in range(rounds):
                belief = node.copy()
                np.add.at(belief, goal[live], messages[live])
                out = belief[source[live]] - messages[back[live]]
                fresh = np.logaddexp.reduce(out[:, :, None] + tables[live], axis=1)
                fresh -= fresh.max(axis=1, keepdims=True)
                off = np.abs(fresh - messages[live]).max(axis=1) >= tolerance
                messages[live] = 0.5 * messages[live] + 0.5 * fresh
                moving = np.zeros(len(graph.base), dtype=bool)
                moving[owner[live[off]]] = True
                live = live[moving[owner[live]]]
                if not len(live):
                    break
            node = node.copy()
            np.add.at(node, goal, messages)
        node -= node.max(axis=1, keepdims=True)
        p = np.exp(node)
        return p / p.sum(axis=1, keepdims=True)

    def find(self, texts: list[str | None], cut: float) -> list[tuple[list, list]]:
        """Per text, the base spans and the spans that the field adds."""
        graph = Graph(texts, self.bits)
        p = self.marginals(graph)
        extra: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for node in np.flatnonzero((p[:, 1:].max(axis=1, initial=0) >= cut) & (np.array(graph.label) == 0)):
            extra[graph.doc[node]].append((LABELS[int(p[node].argmax())], *graph.span[node]))
        return list(zip(graph.base, extra, strict=True))


def train(
    texts: list[str | None], bits: int = 14, epochs: int = 150, rate: float = 1.0, decay: float = 2e-3, reach: float = 8.0, doubt: float = 0.1, agreement: float = 20.0
) -> Field:
    """Learn the field from texts by the labels of their base spans.

    Node weights: softmax regression, each token once with all features and once
    with its context only. A token outside the patterns' spans may still be
    personal data: it counts as other with probability ``1 - doubt``. Link weights: the log odds of two linked labels
    against chance, counted over chain links and skip links to the next token, and
    at most ``reach`` in size. Before any is seen, skip links count as ``agreement`` pairs of each
    label with itself; chain links start out indifferent.
    """
    k = len(LABELS)
    graph = Graph(texts, bits)
    weights = np.zeros((1 << bits, k))
    if not graph.span:
        return Field(weights, np.zeros((k, k)), np.zeros((k, k)), bits)
    rows = graph.full + graph.blind
    y = np.array(graph.label + graph.label)
    counts = np.array([len(f) for f in rows])
    flat = np.fromiter((x for f in rows for x in f), dtype=np.int64, count=int(counts.sum()))
    owner = np.repeat(np.arange(len(rows)), counts)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    speed = np.zeros_like(weights)
    hot = np.eye(k)[y]
    hot[y == 0] = [1 - doubt, *[doubt / (k - 1)] * (k - 1)]
    for _ in range(epochs):
        z = np.add.reduceat(weights[flat], starts)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - hot) / len(rows)
        grad = np.stack([np.bincount(flat, weights=error[owner, j], minlength=1 << bits) for j in range(k)], axis=1)
        speed = 0.9 * speed - rate * (grad + decay / len(rows) * weights)
        weights = weights + speed
    label = np.array(graph.label)
    tables = []
    for edges, agreeing in ((graph.chain, 1.0), (graph.skip, agreement)):
        met = np.where(np.eye(k, dtype=bool), agreeing, 0.01 if agreeing > 1 else 1.0)
        pairs = label[np.array(edges, dtype=np.int64).reshape(-1, 2)]
        np.add.at(met, (pairs[:, 0], pairs[:, 1]), 0.5)
        np.add.at(met, (pairs[:, 1], pairs[:, 0]), 0.5)
        share = met.sum(axis=1) / met.sum()
        tables.append(np.clip(np.log(met / met.sum()) - np.log(np.outer(share, share)), -reach, reach))
    return Field(weights, tables[0], tables[1], bits)


def training_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 3000, most_chars: int = 200_000) -> list[str]:
    """About ``rows`` texts that hold a digit or an ``@``, drawn by a hash of key and text; longer ones are left out."""
    able = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(
        F.col("_t").rlike("[0-9@]") & (F.length("_t") <= most_chars)
    )
    n = able.count()
    draw = F.pmod(F.xxhash64("_k", F.length("_t"), F.lit(5)), F.lit(1_000_000)) / 1e6
    drawn = able.where(draw < rows / max(1, n)).select("_t").toPandas()
    return sorted(drawn["_t"].tolist())


def detect(docs: DataFrame, field: Field, text: str = "text", cut: float = 0.9) -> DataFrame:
    """Add ``base`` and ``spans``, both as arrays of ``kind:start:end``, for whole texts.

    ``base`` holds the patterns' spans, ``spans`` these and the field's. Null
    and empty texts have none. Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def build():
        def run(texts):
            found = shared.value.find(texts, cut)
            sort = lambda spans: joined(spans).split(",") if spans else []
            return [sort(base) for base, _ in found], [sort(base + extra) for base, extra in found]

        return run

    return add_columns(docs, [text], [("base", "array<string>"), ("spans", "array<string>")], build)


def masked(text: str, spans: list[str]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    places = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans))
    for a, b, kind in places:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field, text: str = "text", cut: float = 0.9) -> DataFrame:
    """The same rows and columns, with personal data in the texts replaced by its kind. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def build():
        def run(texts):
            found = shared.value.find(texts, cut)
            return [
                [t if t is None else masked(t, joined(base + extra).split(",") if base or extra else [])
                 for t, (base, extra) in zip(texts, found, strict=True)]
            ]

        return run

    [name] = fresh(docs.columns, "masked")
    made = add_columns(docs, [text], [(name, "string")], build)
    return made.select(*[F.col(name).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
