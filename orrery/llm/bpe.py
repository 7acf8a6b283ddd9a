"""Byte-level BPE encoding and decoding by a public rank file.

A pre-token is looked up whole in a minimal perfect hash over the vocabulary
(one probe, one comparison); only a miss is merged, by a heap over its linked
bytes. Both results are kept in a bounded memo, since words repeat.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructType

from .common import TwoGenerations, pieces_of, release, ship
from .merging import RIGHT, merge, ranked

#: Where a text may be cut if a pre-token never holds white space after something else.
CUT = regex.compile(r"(?<=\S)(?=\s)")
#: Texts by which a pattern is tried for that.
TRIALS = ("a b", "a  b", "a\nb", "1\t2", "!\n\n!", "a!\r\n b", "it's\n x", "a \n b", "é\u2003b", "漢\u3000字", "/\n", "a/\r\n\r\nb", "'\n'")
#: Longer pre-tokens are not remembered.
REMEMBERED = 64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id; ids run from 0 without a gap."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks have gaps")
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """A minimal perfect hash by displacement: n keys in exactly n slots, one probe a lookup.

    Buckets are placed in descending size; a bucket of one key is sent straight
    to a free slot, written as the complement of the slot's number.
    """

    #: Displacements tried at once.
    BLOCK = 256

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        m = self.m = max(1, n // per_bucket)
        self.displacement = [0] * m
        self.slots: list[int] = [-1] * n
        self.keys = keys
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            low, high = self._halves(key)
            buckets[low % m].append((high, low >> 32 | 1, i))
        free = np.ones(n, bool)
        order = sorted(range(m), key=lambda b: -len(buckets[b]))
        for b in order:
            members = buckets[b]
            if len(members) < 2:
                break
            high = np.array([[h] for h, _, _ in members], np.uint64)
            step = np.array([[s] for _, s, _ in members], np.uint64)
            start = 0
            while True:
                tried = np.arange(start, start + self.BLOCK, dtype=np.uint64)
                places = (high + tried * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                places = (places * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                good = free[places].all(axis=0)
                ranked = np.sort(places, axis=0)
                good &= (ranked[1:] != ranked[:-1]).all(axis=0)
                if good.any():
                    break
                start += self.BLOCK
            at = int(good.argmax())
            self.displacement[b] = start + at
            for p, (_, _, i) in zip(places[:, at].tolist(), members, strict=True):
                self.slots[p] = i
                free[p] = False
        left = iter(np.flatnonzero(free).tolist())
        for b in order:
            if len(buckets[b]) == 1:
                p = next(left)
                self.displacement[b] = ~p
                self.slots[p] = buckets[b][0][2]

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFFFFFFFFFF, h >> 64

    def _slot(self, high: int, step: int, d: int) -> int:
        """A place that depends on ``d`` as if at random, so every bucket finds free ones whatever divides n."""
        if d < 0:
            return ~d
        return (((high + d * step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) * self.n >> 32

    def get(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        low, high = self._halves(key)
        i = self.slots[self._slot(high, low >> 32 | 1, self.displacement[low % self.m])]
        return i if self.keys[i] == key else -1


class Vocabulary:
    """What all encoders of one vocabulary share; built once by the driver and broadcast."""

    def __init__(self, tokens: list[bytes]):
        self.key = hashlib.sha256(b"\n".join(tokens)).hexdigest()
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        self.pairs: dict[int, int] = {}
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left = self.whole.get(token[:cut])
                if left >= 0 and (right := self.whole.get(token[cut:])) >= 0:
                    self.pairs[left << RIGHT | right] = i
        self.order = ranked(self.pairs, list(range(len(tokens))))


class ByteBpe:
    """Encode and decode by one vocabulary. ``pattern`` splits a text into pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = 250_000):
        self.tokens = tokens = vocabulary.tokens
        self.whole = vocabulary.whole
        self.pairs, self.order = vocabulary.pairs, vocabulary.order
        self.byte_ids = [self.whole.get(bytes([b])) for b in range(256)]
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary lacks a single byte")
        self.decimal = [str(i) for i in range(len(tokens))]
        found = regex.compile(pattern)
        self.split = found.findall
        # Cut long texts only if this pattern splits the trials alike whole and cut; else they are split in one piece.
        alike = all([m[0] for m in found.finditer(t)] == [m[0] for piece in CUT.split(t) for m in found.finditer(piece)] for t in TRIALS)
        self.cut = CUT if alike else regex.compile(r"(?!)")
        self.memo = TwoGenerations(self._pre_token, memo, REMEMBERED)

    def _pre_token(self, pre_token: str) -> tuple[int, ...]:
        raw = pre_token.encode()
        whole = self.whole.get(raw)
        if whole >= 0:
            return (whole,)
        by_byte = self.byte_ids
        symbols = [by_byte[b] for b in raw]
        merge(symbols, self.pairs, self.order)
        return tuple([s for s in symbols if s >= 0])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in pieces_of(text, self.cut):
            ids.extend(chain.from_iterable(map(self.memo.__getitem__, self.split(piece))))
            self.memo.trim()
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def id_digest(self, ids: list[int]) -> str:
        """SHA-256 over the decimal ids joined by one space."""
        return hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[tuple[str, str], ByteBpe] = {}


def vocabulary(ranks: str) -> Vocabulary:
    """The vocabulary of a rank file, built once per process."""
    if ranks not in _vocabularies:
        tokens = read_ranks(ranks)
        if sum(map(len, tokens)) > 64 << 20:
            raise ValueError("a vocabulary over 64 MB is not broadcast")
        _vocabularies[ranks] = Vocabulary(tokens)
    return _vocabularies[ranks]


def encoder(key: str, read: Callable[[], Vocabulary], pattern: str) -> ByteBpe:
    """One encoder per process and vocabulary; a Python worker keeps it between tasks, and does not ``read`` its vocabulary a second time."""
    at = key, pattern
    if at not in _encoders:
        _encoders[at] = ByteBpe(read(), pattern)
        gc.freeze()  # the tables stay as long as the worker; collections pass them over
    return _encoders[at]


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    *,
    text: str = "text",
    with_ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """Add to each row of ``docs`` its token ids, by the rank file ``ranks``.

    Adds ``n_tokens`` (long); ``ids`` (array of int) with ``with_ids``; with
    ``digests`` ``ids_sha256`` and ``decoded_sha256``, the latter of the bytes
    that decoding the ids gives back. A column of the same name is replaced.
    A null text counts as empty (no ids), repeated rows are each encoded, an
    empty table gives an empty one. Very long texts are encoded in pieces cut
    where no pre-token of the pattern can cross, or whole where there is no such
    place. The vocabulary (a bounded file) is read by
    the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    found = vocabulary(ranks)
    sent, key = spark.sparkContext.broadcast(found), found.key
    added = [pa.field("n_tokens", pa.int64())]
    ddl: list[tuple[str, DataType]] = [("n_tokens", LongType())]
    if with_ids:
        added.append(pa.field("ids", pa.list_(pa.int32())))
        ddl.append(("ids", ArrayType(IntegerType())))
    if digests:
        added += [pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
        ddl += [("ids_sha256", StringType()), ("decoded_sha256", StringType())]
    names = [f.name for f in added]
    kept = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(key, lambda: sent.value, pattern)
        release(bpe.memo)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, listed, hashed, back = [], [], [], []
                for value in batch.column("whole"):
                    ids = bpe.encode(value.as_py() or "")
                    counts.append(len(ids))
                    if with_ids:
                        listed.append(pa.array(ids, pa.int32()))
                    if digests:
                        hashed.append(bpe.id_digest(ids))
                        back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                out = [*batch.columns[:-1], pa.array(counts, pa.int64())]
                if with_ids:
                    ends = [0]
                    for n in counts:
                        ends.append(ends[-1] + n)
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(listed)))
                if digests:
                    out += [pa.array(hashed, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], *names])

    schema = StructType(source.schema.fields[:-1])
    for name, kind in ddl:
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema).toDF(*kept, *names)


def decode(rows: DataFrame, ranks: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) to each row: the bytes that its array of ids stands for.

    Null ids give null, none give no bytes; an id that the vocabulary lacks is
    an error. Repeated rows are each decoded, very long arrays whole; an empty
    table gives an empty one; a column named ``decoded`` is replaced.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(read_ranks(ranks))
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    source = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sent.value
        for batch in batches:
            out = [None if v is None else b"".join(map(tokens.__getitem__, v)) for v in batch.column("whole").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    return source.mapInArrow(run, StructType(source.schema.fields[:-1]).add("decoded", "binary")).toDF(*kept, "decoded")
