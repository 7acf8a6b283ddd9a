"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are a document's number groups, spelt-out addresses, and
other words that hold a digit or an at sign. Neighbouring nodes are linked,
whatever stands between, and so is each node to the last one before it, however
far, that repeats it or is like it (the same last digits, or the same address
however its signs are spelt). Each of the two ways has one potential; a pair linked both ways is one
edge with their sum. Labels are passed around by loopy message passing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
#: Hashed features of a node fall in so many rows.
FEATURES = 1 << 12
#: Rounds of message passing.
ROUNDS = 6
#: An added span needs this probability.
SURE = 0.9

#: The patterns that the task names.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match takes whole runs of digits, so none starts inside one
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = r"\x20?(?:@|[\[(<]@[\])>]|[\[(<]at[\])>]|\bat\b)\x20?"
_DOT = r"(?:\.|\x20?(?:[\[(<]\.[\])>]|[\[(<]dot[\])>]|\bdot\b)\x20?)"
#: A node: an address with its signs spelt in some way, a group of numbers, or a word with a digit or an at sign.
NODE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+"
    r"|(?<![^\x20\x09-\x0D([<\"'])[+(]{0,2}[0-9](?:[\x20().\[\]/-]{0,3}[0-9])++(?![^\x20\x09-\x0D.,;:!?)\]>\"'])"
    r"|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
)
_DIGITS = re.compile(r"[^0-9]")
_SPELT = re.compile(r"\x20?(?:[\[(<](?:at|dot|@|\.)[\])>]|\b(?:at|dot)\b)\x20?")
_SIGNS = re.compile(r"[^a-z0-9]+")
_RUNS = ((re.compile(r"[0-9]+"), lambda m: "9" * min(5, len(m[0]))), (re.compile(r"[^\W\d_]+"), lambda m: m[0] if m[0] in ("at", "dot") else "a"))


def likeness_key(word: str) -> str:
    """What nodes that are like each other share; empty where a node is too short to be known again."""
    digits = _DIGITS.sub("", word)
    if len(digits) >= 7 and not any(c.isalpha() for c in word):
        return digits[-7:]
    key = _SIGNS.sub("", _SPELT.sub("", word.lower()))
    return key if len(key) >= 5 else ""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, leftmost and without overlap within a kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


class Graph:
    """The nodes and links of one or more documents."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.both: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last, first = {}, len(self.spans)
        covered = sorted((s, e, k) for k, s, e in base)
        c = 0
        for m in NODE.finditer(text):
            start, end = m.span()
            i = len(self.spans)
            word = m[0]
            shape = word
            for pattern, put in _RUNS:
                shape = pattern.sub(put, shape)
            before = text[max(0, start - 24) : start].split()
            after = text[end : end + 24].split()
            while c < len(covered) and covered[c][1] <= start:
                c += 1
            kind = KINDS[covered[c][2]] if c < len(covered) and covered[c][0] < end else "none"
            bare = _DIGITS.sub("", word)
            valid = 16 <= len(bare) <= 19 and luhn(bare)
            named = ("1", f"s{shape}", f"k{kind}", f"p{before[-1].lower() if before else ''}", f"n{after[0].lower() if after else ''}", f"d{len(bare)}{valid}", f"@{'@' in word}{word.count('.')}")
            self.features.append([crc32(f.encode()) % FEATURES for f in named])
            self.spans.append((doc, start, end))
            like = likeness_key(word)
            earlier = None
            if like:
                earlier = last.get(like)
                last[like] = i
            if earlier is not None and earlier < i - 1:
                self.skip.append((earlier, i))
            if i > first:
                (self.chain if earlier != i - 1 else self.both).append((i - 1, i))


def beliefs(graph: Graph, p: dict, rounds: int = ROUNDS) -> tuple[np.ndarray, list]:
    """Node marginals [n, labels], and for each kind of link (chain, skip, both) its edges with their pair marginals."""
    unary = p["w"][np.array(graph.features)].sum(axis=1)
    kinds = [(np.array(e, np.int64).reshape(-1, 2), p[k]) for e, k in ((graph.chain, "chain"), (graph.skip, "skip"))]
    kinds.append((np.array(graph.both, np.int64).reshape(-1, 2), p["chain"] + p["skip"]))
    edges = np.concatenate([e for e, _ in kinds])
    pots = np.concatenate([np.broadcast_to(t, (len(e), LABELS, LABELS)) for e, t in kinds])
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    both = np.concatenate((pots, pots.transpose(0, 2, 1)))
    m = len(edges)
    messages = np.zeros((2 * m, LABELS))
    for _ in range(rounds if m else 0):
        total = unary.copy()
        np.add.at(total, dst, messages)
        back = np.concatenate((messages[m:], messages[:m]))
        new = _logsum((total[src] - back)[:, :, None] + both, 1)
        messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
    total = unary.copy()
    np.add.at(total, dst, messages)
    out, at = [], 0
    for e, t in kinds:
        one, two = slice(at, at + len(e)), slice(m + at, m + at + len(e))
        joint = (total[e[:, 0]] - messages[two])[:, :, None] + (total[e[:, 1]] - messages[one])[:, None, :] + t
        out.append((e, np.exp(joint - _logsum(joint.reshape(len(e), LABELS * LABELS), 1)[:, None, None])))
        at += len(e)
    return np.exp(total - _logsum(total, 1)[:, None]), out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _number(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _word(draw: random.Random) -> str:
    return "".join(draw.choice("aeinorst") for _ in range(draw.randint(2, 8)))


def entity(draw: random.Random, kind: int) -> tuple[str, list[str], list[str]]:
    """An invented piece of personal data: plainly written, spoilt in ways of its own, and in ways that other numbers are written too."""
    if kind == 0:
        user = f"{_word(draw)}{draw.choice(('.', '_', ''))}{_word(draw)}{draw.choice(('', _number(draw, 2)))}"
        host, end = _word(draw) + _word(draw), draw.choice(("example.com", "example.org", "example.net"))
        name, dom = end.split(".")
        spoilt = [f"{user}(@){host}.{end}", f"{user}[at]{host}.{end}", f"{user} at {host} dot {name} dot {dom}", f"{user}(at){host}(dot){name}(dot){dom}", f"{user} @ {host}.{end}", f"{user}[@]{host}[.]{name}[.]{dom}"]
        return f"{user}@{host}.{end}", spoilt, [f"{user}@{host}"]
    if kind == 1:
        parts = [str(draw.randint(0, 255)) for _ in range(4)]
        return ".".join(parts), ["[.]".join(parts), "(.)".join(parts)], [" . ".join(parts), "-".join(parts)]
    if kind == 2:
        digits = draw.choice("3456") + _number(draw, 14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        fours = [digits[i : i + 4] for i in range(0, 16, 4)]
        return draw.choice((digits, "-".join(fours), " ".join(fours))), [".".join(fours), "/".join(fours), " - ".join(fours)], []
    area, mid, end = _number(draw, 3), draw.choice(("555", _number(draw, 3))), _number(draw, 4)
    spoilt = [f"({area}) {mid}-{end}", f"({area}){mid}-{end}", f"{area}-{mid}-{end}", f"001-{area}-{mid}-{end}"]
    return f"+1-{area}-{mid}-{end}", spoilt, [f"{area} {mid} {end}", f"{area}.{mid}.{end}", f"{area}{mid}{end}"]


def other(draw: random.Random) -> str:
    """Invented numbers and words that are nobody's data; some are written as spoilt data is."""
    n = lambda k: _number(draw, k)
    return draw.choice((
        n(draw.randint(1, 6)), f"{_word(draw)}{n(2)}", f"{n(1)}.{n(2)}", n(16), f"{n(4)}-{n(2)}-{n(2)}", hashlib.md5(n(4).encode()).hexdigest(),
        f"{n(3)} {n(3)} {n(4)}", f"{n(3)}.{n(3)}.{n(4)}", n(10), f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}:{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(2)}",
        f"{n(2)}-{n(2)}-{n(1)}-{n(2)}", f"{n(2)} . {n(1)} . {n(2)} . {n(1)}", f"@{_word(draw)}{_word(draw)}", f"{_word(draw)}@{_word(draw)}", f"{n(4)}.{n(4)}", f"{n(3)},{n(3)}", f"{n(2)}%", f"${n(3)}.{n(2)}",
        f"{n(4)}.{n(4)}.{n(4)}", f"{n(4)} {n(4)}", f"{n(3)}-{n(4)}",
    ))


def examples(count: int = 500, seed: int = 5) -> tuple[Graph, np.ndarray]:
    """Invented documents with personal data, plain, spoilt and both, repeated at times, and other numbers, with prose between or none.

    Data written as other numbers are stands only where it is also written
    plainly, so it takes a link to tell the two apart.
    """
    draw = random.Random(seed)
    graph, labels = Graph(), []
    for doc in range(count):
        items: list[tuple[str, int]] = []
        for _ in range(draw.randint(1, 3)):
            kind = draw.randrange(4)
            plain, spoilt, shared = entity(draw, kind)
            if draw.random() < 0.5:
                items += [(plain, kind)] + [(value, kind) for value in draw.choices(spoilt + shared, k=draw.randint(0, 3))]
            else:
                items += [(draw.choice(spoilt), kind)] * draw.randint(1, 3)
        for _ in range(draw.randint(1, 5)):
            items += [(other(draw), OTHER)] * draw.choice((1, 1, 2, 3))
        draw.shuffle(items)
        text, marks = "", []
        for value, label in items:
            text += "".join(_word(draw) + " " for _ in range(draw.choice((draw.randint(1, 3), draw.randint(1, 8)))))
            marks.append((len(text), len(text) + len(value), label))
            text += value + draw.choice((" ", ", ", ". "))
        at = len(graph.spans)
        graph.add(doc, text, base_spans(text))
        for _, s, e in graph.spans[at:]:
            labels.append(next((label for a, b, label in marks if a < e and s < b), OTHER))
    return graph, np.array(labels)


def train(graph: Graph, labels: np.ndarray, *, steps: int = 120, rate: float = 0.4, decay: float = 1e-4) -> dict:
    """Weights by gradient ascent: observed less expected counts, the latter from message passing."""
    p = {"w": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    features = np.array(graph.features)
    seen = np.eye(LABELS)[labels]
    scale = {k: np.zeros_like(v) + 1e-6 for k, v in p.items()}
    for _ in range(steps):
        marginals, pairs = beliefs(graph, p, 3)
        g = {"w": np.zeros_like(p["w"])}
        np.add.at(g["w"], features.ravel(), np.repeat(seen - marginals, features.shape[1], axis=0))
        chain, skip, both = ((seen[e[:, 0]][:, :, None] * seen[e[:, 1]][:, None, :] - joint).sum(axis=0) for e, joint in pairs)
        g |= {"chain": chain + both, "skip": skip + both}
        for k, v in g.items():
            v = v / len(labels) - decay * p[k]
            scale[k] += v * v
            p[k] += rate * v / np.sqrt(scale[k])
    return p


def added(graph: Graph, marginals: np.ndarray, base: dict[int, list[tuple[int, int, int]]], texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """The spans that the field adds: sure nodes, without outer punctuation, that touch no fixed span."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    best = marginals.argmax(axis=1)
    for i in np.flatnonzero((best != OTHER) & (marginals.max(axis=1) >= SURE)).tolist():
        doc, start, end = graph.spans[i]
        word = texts[doc][start:end]
        start, end = start + len(word) - len(word.lstrip(".,;:!?[]<>\"'*|$%&#")), end - (len(word) - len(word.rstrip(".,;:!?[]<>\"'*|$%&#")))
        if start < end and not any(s < end and start < e for _, s, e in base.get(doc, ())):
            out.setdefault(doc, []).append((int(best[i]), start, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, weights: dict | None = None) -> DataFrame:
    """The columns ``keep`` (all) of each row with ``base`` and ``spans``: ``kind:start:end``, comma-joined.

    Places count code points, the end exclusive. ``base`` are the spans of the
    fixed patterns, ``spans`` those and the field's. Null and empty texts have
    none; whole texts are read, in time that grows with their length only;
    repeated rows are each searched; columns of the added names are replaced;
    an empty table gives an empty one. Links to the last like node make a
    document's graph linear in its length.
    """
    ship(docs.sparkSession)
    weights = weights or train(*examples())
    names = ["base", "spans"]
    kept = [c for c in (keep or docs.columns) if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("whole").to_pylist()]
                graph, base = Graph(), {}
                for i, value in enumerate(texts):
                    base[i] = base_spans(value)
                    graph.add(i, value, base[i])
                more = added(graph, beliefs(graph, weights)[0], base, texts) if graph.spans else {}
                fixed = [written(base[i]) for i in range(len(texts))]
                all_ = [written(base[i] + more[i]) if i in more else fixed[i] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fixed, pa.string()), pa.array(all_, pa.string())], [*batch.schema.names[:-1], *names])

    schema = StructType(source.schema.fields[:-1]).add("base", "string").add("spans", "string")
    return source.mapInArrow(run, schema).toDF(*kept, *names)


def digests(docs: DataFrame) -> DataFrame:
    """Per document how many fixed spans of each kind it has, their digest, and all spans; nulls, repeats and empty tables as in :func:`find`."""
    found = find(docs, keep=["doc_id"])
    n = [F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *n, F.sha2("base", 256).alias("base_sha256"), "spans")
