"""Token counts under a public piece model: byte-pair merging with no identifiers emitted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import TwoGenerations, release, ship
from .merging import RIGHT, merge, ranked

SPACE = "▁"
#: Longer words are counted without being remembered.
REMEMBERED = 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores; refuses models that normalise texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" aÀＡ  b ") != f"{SPACE}{SPACE}aÀＡ{SPACE}{SPACE}b{SPACE}":
        raise ValueError("the model normalises texts")
    ordinary = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]


class PieceCounter:
    """Counts pieces: initial symbols (code points) minus merges; a code point outside the model counts its bytes."""

    def __init__(self, pieces: list[tuple[str, float]], memo: int = 250_000):
        ids = {piece: i for i, (piece, _) in enumerate(pieces)}
        self.known = len(ids)
        for piece, _ in pieces:
            for c in piece:
                ids.setdefault(c, len(ids))
        self.ids = ids
        levels = {score: n for n, score in enumerate(sorted({score for _, score in pieces}, reverse=True))}
        rank = [levels[score] for _, score in pieces]
        self.pairs = {}
        for i, (piece, _) in enumerate(pieces):
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << RIGHT | right] = i
        self.order = ranked(self.pairs, rank)
        # Merges never cross a place whose two characters stand side by side in no piece, so a text may be cut there.
        beside = {(a, b) for piece, _ in pieces for a, b in zip(piece, piece[1:], strict=False)}
        self.apart = not any(a != SPACE and b == SPACE for a, b in beside)
        letter = regex.compile(r"\p{L}").match
        if any("\n" in both for both in beside) or any(letter(a) and not letter(b) for a, b in beside):
            self.split = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:  # cut around line ends, and after letters
            self.split = regex.compile(rf"\n|{SPACE}*[^{SPACE}\n\p{{L}}]*\p{{L}}+|{SPACE}*[^{SPACE}\n\p{{L}}]+|{SPACE}+").findall
        self.memo = TwoGenerations(self._count, memo)

    def _count(self, word: str) -> int:
        ids, outside = self.ids, len(self.ids)
        strange = 0
        symbols = []
        for c in word:
            i = ids.get(c, outside)
            if i >= self.known:
                strange += len(c.encode()) - 1
            symbols.append(i)
        if len(symbols) == 1:
            return 1 + strange
        return len(symbols) - merge(symbols, self.pairs, self.order) + strange

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self._count(marked)
        total, memo = 0, self.memo
        for word in self.split(marked):
            total += memo[word] if len(word) <= REMEMBERED else self._count(word)
        memo.trim()
        return total


_counters: dict[str, PieceCounter] = {}


def counter(key: str, pieces: list[tuple[str, float]]) -> PieceCounter:
    if key not in _counters:
        _counters[key] = PieceCounter(pieces)
    return _counters[key]


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of each row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Counts are those of the model's library without begin and end tokens. A
    null text counts as empty (no token); special strings inside a text are
    ordinary text; very long texts are counted whole; repeated rows are each
    counted; an empty table gives an empty one. A column of an added name is replaced. The model, a bounded
    file, is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = read_pieces(model)
    if sum(len(p) for p, _ in pieces) > 64 << 20:
        raise ValueError("a vocabulary over 64 MB is not broadcast")
    sent = spark.sparkContext.broadcast(pieces)
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (keep or docs.columns) if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = counter(key, sent.value)
        release(pieces_of.memo)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sizes, found = [], []
                for value in batch.column("whole"):
                    value = value.as_py() or ""
                    sizes.append(len(value.encode()))
                    found.append(pieces_of.count(value))
                added = [pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names[:-1], *names])

    schema = StructType(source.schema.fields[:-1]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return source.mapInArrow(run, schema).toDF(*kept, *names)
