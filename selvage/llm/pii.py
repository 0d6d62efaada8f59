"""Personal data by rules and a skip-chain conditional random field.

Base spans come from four fixed patterns.  A conditional random field then
labels the tokens that hold a digit, an at sign or a plus: neighbours on the
line share chain potentials, and distant tokens with the same characters, or
the same last digits, share skip potentials through a hub variable of their own,
so that a label reaches every other mention in two steps however long the text.
Loopy message passing carries it: an entity written once in full and again in
part gets one label across the document.  Tokens inside base spans are observed;
other tokens add a span where their belief is high enough.

Weights are trained here by pseudo-likelihood on a bounded sample of documents.
The rules decide full mentions, so these teach nothing about partial ones:
masked mentions, the last digits of a base span or other digits of that length,
are written behind each sampled text and labelled by where they come from.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four patterns, leftmost and non-overlapping per kind; matches that fail their test are dropped."""
    found: list[Span] = []
    if not _ANY.search(text):
        return found
    past = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            # the pattern's start: the run of local characters before the sign, after the last match
            start = m.start()
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                past = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# The field's variables: labels 0 (none) and 1 to 4 (KINDS).
LABELS = len(KINDS) + 1
N_FEATURES = 24
#: Last digits that tell two mentions of a number to be the same.
TAIL = 7


@dataclass
class Nodes:
    start: list[int]
    end: list[int]
    x: np.ndarray  # node by feature, 0 or 1
    observed: np.ndarray  # label of the base span, 0 if there is none
    chain: list[tuple[int, int]]
    hubs: list[list[int]]  # mentions that share a hub


def nodes_of(text: str, base: list[Span]) -> Nodes:
    """Variables and edges of a document; their number is linear in its tokens."""
    start, end, rows, place = [], [], [], []
    by_key: dict[str, list[int]] = {}
    tokens = 0
    at = 0
    observed = []
    run: list[int] = []  # nodes of digits alone, side by side
    run_digits = ""
    spans = [(kind, s, e, "".join(_DIGITS.findall(text[s:e]))) for kind, s, e in base]

    def close_run() -> None:
        if len(run) > 1 and TAIL <= len(run_digits) <= 19:
            for k in run:
                by_key.setdefault("d" + run_digits[-TAIL:], []).append(k)

    for m in _TOKEN.finditer(text):
        tokens += 1
        word = m.group()
        if not _ANY.search(word):
            continue
        core = word.strip(".,;:!?\"'()[]{}<>")
        if not core:
            continue
        s = m.start() + word.find(core)
        e = s + len(core)
        while at < len(spans) and spans[at][2] <= s:
            at += 1
        label, keys = 0, set()
        for kind, bs, be, digits in spans[at:at + 8]:
            if bs < e and be > s:
                label = KINDS.index(kind) + 1
                if kind in ("card", "phone"):
                    keys.add("d" + digits[-TAIL:])
                break
        digits = "".join(_DIGITS.findall(core))
        k = len(start)
        start.append(s)
        end.append(e)
        place.append(tokens)
        observed.append(label)
        sign = core.find("@")
        n, dots = len(digits), core.count(".")
        rows.append((
            True, sign >= 0, sign > 0 and "." in core[sign:], sign == 0, n == 0, 1 <= n <= 2, n == 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n > 19,
            n == len(core), dots == 1, dots == 2, dots == 3, dots > 3, core[0] == "+" or word[0] == "+", "-" in core, "(" in word or ")" in word,
            any(c.isalpha() for c in core), n == 4, 12 <= n <= 19 and luhn(digits), len(core) > 40))
        if len(core) >= 5:
            keys.add("t" + core.lower())
        if n >= TAIL:
            keys.add("d" + digits[-TAIL:])
        if sign >= 3:
            keys.add("t" + core[:sign].lower())
        for key in keys:
            by_key.setdefault(key, []).append(k)
        plain = n > 0 and all(c.isdigit() or c in "+-()." for c in core) and not label
        if run and (not plain or place[run[-1]] != tokens - 1):
            close_run()
            run, run_digits = [], ""
        if plain:
            run.append(k)
            run_digits += digits
    close_run()
    chain = [(k, k + 1) for k in range(len(start) - 1) if place[k + 1] - place[k] <= 2]
    hubs = sorted({tuple(own) for own in by_key.values() if len(own) > 1})
    return Nodes(start, end, np.array(rows, float).reshape(-1, N_FEATURES), np.array(observed, int), chain, [list(h) for h in hubs])


@dataclass
class Model:
    unary: np.ndarray  # feature by label
    chain: np.ndarray  # left label by right label
    skip: np.ndarray  # hub label by mention label
    threshold: float = 0.5


def beliefs(nodes: Nodes, model: Model, settled: float = 1e-4, most: int = 1000) -> np.ndarray:
    """Marginals by loopy sum-product message passing; observed nodes are clamped.

    Messages are damped and pass until none changes by more than ``settled``.
    Loops can keep them swinging; after ``most`` rounds the last ones count.
    """
    n = len(nodes.x)
    unary = np.zeros((n + len(nodes.hubs), LABELS))
    unary[:n] = nodes.x @ model.unary
    seen = np.flatnonzero(nodes.observed > 0)
    unary[seen] = -60.0
    unary[seen, nodes.observed[seen]] = 0.0
    skips = [(n + h, k) for h, own in enumerate(nodes.hubs) for k in own]
    edges = nodes.chain + skips
    if not edges:
        return _softmax(unary[:n])
    e = np.array(edges)
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    pair = np.concatenate([np.repeat(model.chain[None], len(nodes.chain), 0), np.repeat(model.skip[None], len(skips), 0)])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])  # from source label to target label
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    message = np.zeros((len(src), LABELS))
    total = unary.copy()
    for _ in range(most):
        given = total[src] - message[back]
        new = np.logaddexp.reduce(given[:, :, None] + pair, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        change = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        total = unary.copy()
        np.add.at(total, dst, message)
        if change < settled:
            break
    return _softmax(total[:n])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def all_spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's additions."""
    text = text or ""
    base = base_spans(text)
    if not _ANY.search(text):
        return base, base
    nodes = nodes_of(text, base)
    if not len(nodes.x):
        return base, base
    belief = beliefs(nodes, model)
    best = belief.argmax(1)
    more = [(KINDS[best[k] - 1], nodes.start[k], nodes.end[k]) for k in range(len(best))
            if best[k] and not nodes.observed[k] and belief[k, best[k]] >= model.threshold]
    return base, ordered(base + more)


@dataclass
class Example:
    """Variables of a training text with their labels and those around them: counts by label of left and right neighbours and of hubs."""

    x: np.ndarray
    label: np.ndarray
    left: np.ndarray
    right: np.ndarray
    hubs: np.ndarray

    def taken(self, rows: np.ndarray) -> Example:
        return Example(*(v[rows] for v in (self.x, self.label, self.left, self.right, self.hubs)))


def example(text: str | None, seed: int) -> Example:
    """A text with masked mentions behind it: of a third of its numbers' base spans the last digits, and as many other digits."""
    draw = random.Random(seed)
    text = text or ""
    parts: list[tuple[int, int, int]] = []
    for kind, s, e in base_spans(text):
        digits = "".join(_DIGITS.findall(text[s:e]))
        if kind in ("card", "phone") and draw.random() < 1 / 3:
            n = draw.choice((TAIL, TAIL, TAIL + 1))
            for label, part in ((KINDS.index(kind) + 1, digits[-n:]), (0, "".join(draw.choice("0123456789") for _ in range(n)))):
                text += "\n" + draw.choice(("see", "again", "ref", "number", "it was"))
                parts.append((len(text) + 1, len(text) + 1 + n, label))
                text += f" {part} ok"
    nodes = nodes_of(text, base_spans(text))
    label = nodes.observed.copy()
    own = {s: y for s, _, y in parts}
    for k, s in enumerate(nodes.start):
        if s in own and not label[k]:
            label[k] = own[s]
    n = len(label)
    left, right, hubs = (np.zeros((n, LABELS)) for _ in range(3))
    for a, b in nodes.chain:
        left[b, label[a]] += 1
        right[a, label[b]] += 1
    for members in nodes.hubs:
        y = label[members]
        for k in members:
            rest = y[np.array(members) != k]
            named = rest[rest > 0]  # a hub is what any of the others is known to be
            hubs[k, np.bincount(named).argmax() if len(named) else 0] += 1
    return Example(nodes.x, label, left, right, hubs)


def fit(examples: list[Example], steps: int = 400) -> Model:
    """Pseudo-likelihood by full-batch Adam.  Without variables, potentials only say "none"."""
    unary = np.zeros((N_FEATURES, LABELS))
    if not sum(len(d.label) for d in examples):
        unary[0, 0] = 5.0
        return Model(unary, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    x, y, l, r, s = (np.concatenate([getattr(d, c) for d in examples]) for c in ("x", "label", "left", "right", "hubs"))
    target = np.eye(LABELS)[y]
    theta = np.zeros((N_FEATURES + 2 * LABELS) * LABELS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    cut = N_FEATURES * LABELS, (N_FEATURES + LABELS) * LABELS
    for t in range(1, steps + 1):
        u, c, k = theta[:cut[0]].reshape(-1, LABELS), theta[cut[0]:cut[1]].reshape(LABELS, LABELS), theta[cut[1]:].reshape(LABELS, LABELS)
        err = (_softmax(x @ u + l @ c + r @ c.T + s @ k) - target) / len(y)
        grad = np.concatenate([(x.T @ err).ravel(), (l.T @ err + (r.T @ err).T).ravel(), (s.T @ err).ravel()]) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:cut[0]].reshape(-1, LABELS), theta[cut[0]:cut[1]].reshape(LABELS, LABELS), theta[cut[1]:].reshape(LABELS, LABELS))


def train(docs: DataFrame, max_documents: int = 1500, max_nodes: int = 200) -> Model:
    """Fit on at most ``max_documents`` documents that hold a digit, an at sign or a plus, those with the smallest hash of ``doc_id``.

    Of each, ``max_nodes`` variables at most are used, drawn at random from all of it.
    """
    bounded_batches(docs.sparkSession)
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@+]")).select("doc_id").orderBy(
        F.xxhash64(F.lit("pii"), "doc_id"), "doc_id").limit(max_documents).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = example(text, doc)
                rows = sorted(random.Random(doc).sample(range(len(own.label)), min(max_nodes, len(own.label))))
                own = own.taken(np.array(rows, int))
                out.append((doc, *(v.astype(np.uint8).tobytes() for v in (own.x, own.label, own.left, own.right, own.hubs))))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "x", "y", "l", "r", "h"])

    # one text for each id, however often it is repeated
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(run, "doc_id long, x binary, y binary, l binary, r binary, h binary").collect()

    def back(data: bytes, width: int) -> np.ndarray:
        return np.frombuffer(data, np.uint8).reshape(-1, width).astype(float)

    return fit([Example(back(d["x"], N_FEATURES), np.frombuffer(d["y"], np.uint8).astype(int), *(back(d[c], LABELS) for c in "lrh")) for d in sorted(rows, key=lambda d: d["doc_id"])])


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, base, spans`` (arrays of kind, start, end) of every whole text, in code points, ends exclusive.

    A null text is empty and has no spans.  Rows are independent: repeated rows
    repeat results, other columns are ignored, an empty table gives an empty
    result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(t, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in one[k]] for one in both], _SPANS) for k in (0, 1))], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by its kind in angle brackets; null texts stay null."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, past = [], 0
        for kind, start, end in all_spans(text, model)[1]:
            if start >= past:
                out += [text[past:start], f"<{kind.upper()}>"]
            past = max(past, end)
        return "".join(out) + text[past:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
