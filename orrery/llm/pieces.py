"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece crosses a white-space marker, a marked text falls into chunks
that are segmented apart. The distinct chunks of all documents are counted by
Spark, each of the repeated ones is segmented once, by a heap over its linked
symbols, and the table is joined to the chunks of every text by position.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructType

from .common import Scratch, TwoGenerations, release, ship
from .merging import RIGHT, merge, ranked

SPACE = "▁"
#: Letters after which a text is cut, if the model has no piece that goes on with anything else.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Longer chunks are segmented where they stand and neither counted nor remembered.
REMEMBERED = 32
#: Distinct chunks that a counting task holds before it hands them on.
HELD = 400_000
#: What the table of chunks may take when it is broadcast.
TABLE_BYTES = 64 << 20
UNKNOWN = " ⁇ "


@dataclass
class PieceModel:
    """A byte-pair piece model: ordinary pieces with their scores, the ids of single bytes, all surfaces by id."""

    ordinary: list[tuple[int, str, float]]
    bytes: list[int]
    surfaces: list[bytes]
    marked: set[int]
    silent: set[int]
    unknown: int

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.ordinary, self.bytes, self.surfaces)).encode()).hexdigest()


def read_model(path: str) -> PieceModel:
    """The model of a file; refuses one that changes texts, has no byte pieces, or has unused ones, which need another merge."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" aÀＡ  b ") != f"{SPACE}{SPACE}aÀＡ{SPACE}{SPACE}b{SPACE}":
        raise ValueError("the model normalises texts")
    ids = range(model.vocab_size())
    if any(map(model.is_unused, ids)):
        raise ValueError("the model has unused pieces")
    by_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError("the model lacks a single byte")
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    surfaces = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
    for byte, i in by_byte.items():
        surfaces[i] = bytes([byte])
    silent = {i for i in ids if model.is_control(i)}
    for i in silent:
        surfaces[i] = b""
    surfaces[model.unk_id()] = UNKNOWN.encode()
    found = PieceModel(
        ordinary=[(i, model.id_to_piece(i), model.get_score(i)) for i in plain],
        bytes=[by_byte[b] for b in range(256)],
        surfaces=surfaces,
        marked={i for i in plain if model.id_to_piece(i).startswith(SPACE)},
        silent=silent,
        unknown=model.unk_id(),
    )
    if sum(map(len, surfaces)) > 64 << 20:
        raise ValueError("a vocabulary over 64 MB is not broadcast")
    return found


class Segmenter:
    """Cuts marked texts into chunks that no piece crosses, and segments a chunk by byte-pair merging."""

    def __init__(self, model: PieceModel):
        self.by_byte = model.bytes
        self.piece_ids = [i for i, _, _ in model.ordinary]
        pieces = [p for _, p, _ in model.ordinary]
        self.known = len(pieces)
        self.ids = ids = {p: n for n, p in enumerate(pieces)}
        for c in sorted({c for p in pieces for c in p}):
            ids.setdefault(c, len(ids))
        levels = {score: n for n, score in enumerate(sorted({s for _, _, s in model.ordinary}, reverse=True))}
        self.pairs = {}
        for n, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << RIGHT | right] = n
        self.order = ranked(self.pairs, [levels[s] for _, _, s in model.ordinary])
        self.pattern = self._pattern({(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)})
        self.chunks = re.compile(self.pattern, re.DOTALL).findall

    @staticmethod
    def _pattern(beside: set[tuple[str, str]]) -> str:
        """Chunks, by the characters that stand side by side in a piece: merges never cross a place whose two do so in none."""
        if any(a != SPACE and b == SPACE for a, b in beside):
            return ".+"  # pieces cross markers: a text is one chunk
        letter = re.compile(f"[{LETTERS}]").match
        if any("\n" in both or letter(both[0]) and not letter(both[1]) for both in beside):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        # Line ends stand alone, and a chunk ends after its letters.
        return f"{SPACE}*[^{SPACE}\n{LETTERS}]*[{LETTERS}]+|{SPACE}*[^{SPACE}\n{LETTERS}]+|{SPACE}+|\n"

    def segment(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk; a character that is in no piece is given by its bytes."""
        outside = len(self.ids)
        symbols = [self.ids.get(c, outside) for c in chunk]
        if len(symbols) > 1:
            merge(symbols, self.pairs, self.order)
        found: list[int] = []
        for place, symbol in enumerate(symbols):
            if 0 <= symbol < self.known:
                found.append(self.piece_ids[symbol])
            elif symbol >= 0:
                found.extend(self.by_byte[b] for b in chunk[place].encode())
        return tuple(found)


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Known(dict):
    """The table of distinct chunks; what it lacks is segmented once while it is remembered, apart from the table."""

    def __init__(self, table: dict[str, tuple[int, ...]], segment: Callable[[str], tuple[int, ...]], memo: int):
        super().__init__(table)
        self.rest = TwoGenerations(segment, memo, REMEMBERED)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        return self.rest[chunk]


class Encoder:
    """Cuts texts into chunks and puts in each one's place the ids that the table has for it."""

    def __init__(self, segmenter: Segmenter, table: dict[str, tuple[int, ...]], memo: int = 250_000):
        self.chunks, self.known = segmenter.chunks, Known(table, segmenter.segment, memo)

    def encode(self, text: str) -> list[int]:
        found = list(chain.from_iterable(map(self.known.__getitem__, self.chunks(marked(text)))))
        self.known.rest.trim()
        return found


class Decoder:
    """Joins the surfaces of ids as the library's decode(ids) does."""

    def __init__(self, model: PieceModel):
        self.surfaces, self.first, self.silent, self.unknown = model.surfaces, model.marked, model.silent, model.unknown
        self.of_byte = set(model.bytes)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; the first piece loses one marker, bytes that are no UTF-8 become the replacement sign each."""
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        for i in ids:
            if i not in self.silent:
                raw = raw[1:] if i in self.first else raw
                break
        try:
            raw.decode()
        except UnicodeDecodeError:
            return self._spoilt(ids)
        return raw

    def _spoilt(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()

        def end() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode())
                    except UnicodeDecodeError:
                        continue
                    at += width
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        begun = False
        for i in ids:
            if i in self.of_byte:
                run += self.surfaces[i]
            else:
                end()
                piece = self.surfaces[i].decode()
                out.append(piece[1:] if not begun and i in self.first else piece)
            begun = begun or i not in self.silent
        end()
        return "".join(out).encode()


_segmenters: dict[str, Segmenter] = {}
_encoders: dict[str, Encoder] = {}


def segmenter(key: str, model: PieceModel) -> Segmenter:
    """One per process and model."""
    if key not in _segmenters:
        _segmenters[key] = Segmenter(model)
    return _segmenters[key]


def _encoder(key: str, model_key: str, model: PieceModel, table: pa.Table) -> Encoder:
    """One per process and table; the last one only, since tables of other documents are of no more use."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(segmenter(model_key, model), looked_up(table, len(model.surfaces)))
        gc.freeze()  # the table stays as long as the worker; collections pass it over
    return _encoders[key]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def distinct_chunks(docs: DataFrame, model: PieceModel, *, text: str = "text") -> DataFrame:
    """The distinct chunks of all texts with the number of their places: chunk, n. Chunks of over 32 characters are left out.

    Tasks hand on what they counted before it outgrows them, so a chunk of very
    many places comes as one row a task.
    """
    ship(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, found = segmenter(key, sent.value).chunks, Counter()
        release()

        def rows() -> Iterator[pa.RecordBatch]:
            kept = {c: n for c, n in found.items() if len(c) <= REMEMBERED}
            names, counts = pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())
            for at in range(0, len(kept), 10_000):
                yield pa.RecordBatch.from_arrays([names[at : at + 10_000], counts[at : at + 10_000]], ["chunk", "n"])
            found.clear()

        for batch in batches:
            for value in _texts(batch.column("whole")):
                found.update(chunks(marked(value)))
                if len(found) > HELD:
                    yield from rows()
        yield from rows()

    counted = docs.select(F.col(f"`{text}`").alias("whole")).mapInArrow(count, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: PieceModel, *, text: str = "text", most: int = TABLE_BYTES, scratch: Scratch | None = None) -> pa.Table:
    """Distinct chunks that occur more than once with their ids (chunk, ids), each segmented once, as many as fit in ``most`` bytes.

    The more frequent ones come first, by powers of two of their counts, so
    what is left out is rare. An id stands for a byte at least, so the bound
    follows from the chunks' lengths, which Spark adds up before anything is
    fetched. An empty table of documents gives an empty one.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pieces")
    repeated = scratch.table(distinct_chunks(docs, model, text=text).where(F.col("n") > 1), "chunks")
    size = F.octet_length("chunk") * 5 + 64
    levels = repeated.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect()  # at most 64 rows
    room, least = most, None
    for row in levels:
        room -= row.bytes
        if room < 0:
            break
        least = row.level
    if least is None:
        return pa.table({"chunk": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    sent, key = spark.sparkContext.broadcast(model), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(key, sent.value).segment
        for batch in batches:
            found = [segment(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["chunk", "ids"])

    frequent = repeated.where(F.floor(F.log2("n")) >= least).select("chunk")
    return frequent.mapInArrow(run, "chunk string, ids array<int>").toArrow()


def looked_up(table: pa.Table, ids: int) -> dict[str, tuple[int, ...]]:
    """A table of chunks as a task looks them up; equal ids, of which there are ``ids``, share one object."""
    own, found = list(range(ids)), {}
    for batch in table.to_batches(max_chunksize=20_000):
        lists = ([own[i] for i in one] for one in batch.column(1).to_pylist())
        found.update(zip(batch.column(0).to_pylist(), map(tuple, lists), strict=True))
    return found


def encode(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    with_ids: bool = True,
    digests: bool = False,
    most: int = TABLE_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add to each row of ``docs`` its piece ids, by the model file at ``path``, without begin and end ids.

    Adds ``n_tokens`` (long); ``ids`` (array of int) with ``with_ids``; with
    ``digests`` ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8). A column of the same
    name is replaced. A null text counts as empty (no ids), special strings
    inside a text are ordinary text, very long texts are encoded whole,
    repeated rows are each encoded, an empty table gives an empty one.

    The table of distinct chunks is made first, in a pass of its own; chunks
    beyond its bound, or of over 32 characters, are segmented by the task that
    meets them, with the same ids. No text is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    model = read_model(path)
    table = chunk_table(docs, model, text=text, most=most, scratch=scratch)
    sent, model_key = spark.sparkContext.broadcast((model, table)), model.key
    key = uuid.uuid4().hex
    fields: list[tuple[str, pa.DataType, DataType]] = [("n_tokens", pa.int64(), LongType())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32()), ArrayType(IntegerType())))
    if digests:
        fields += [("ids_sha256", pa.string(), StringType()), ("decoded_sha256", pa.string(), StringType())]

    def start() -> Callable[[str], tuple]:
        model, table = sent.value
        encoder = _encoder(key, model_key, model, table)
        release(encoder.known.rest)
        decoder, decimal = Decoder(model), [str(i) for i in range(len(model.surfaces))]

        def row(value: str) -> tuple:
            ids = encoder.encode(value)
            found: list = [len(ids)]
            if with_ids:
                found.append(ids)
            if digests:
                found += [hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()]
            return tuple(found)

        return row

    return _added(docs, text, fields, start)


def _added(docs: DataFrame, text: str, fields: list[tuple[str, pa.DataType, DataType]], start: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``docs`` with the fields that the function which ``start`` makes in a task gives for each text; a column of their names is replaced."""
    names = [name for name, _, _ in fields]
    kept = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns = zip(*map(row, _texts(batch.column("whole"))), strict=True)
                out = [pa.array(column, kind) for column, (_, kind, _) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], *names])

    schema = StructType(source.schema.fields[:-1])
    for name, _, kind in fields:
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema).toDF(*kept, *names)


def decode(rows: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string) to each row: the text that its array of ids stands for, as the library's decode(ids) gives it.

    Null ids give null, none give the empty text; a null among the ids, or an id that the model lacks,
    is an error. Repeated rows are each decoded, very long arrays whole; an
    empty table gives an empty one; a column named ``decoded`` is replaced.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(read_model(path))
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    source = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            out = [None if v is None else decoder.decode(v).decode() for v in batch.column("whole").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return source.mapInArrow(run, StructType(source.schema.fields[:-1]).add("decoded", "string")).toDF(*kept, "decoded")
