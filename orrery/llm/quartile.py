"""Document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, keyed, ship

#: Buckets of triplets; two bits each go into the digest.
BUCKETS = 256
#: Bytes hashed at a time; triplets across the seam are counted.
CHUNK = 1 << 20
#: Documents to a partition of the range sort.
PART = 50_000
#: Steps from a triplet's first byte to its second and third.
SHAPES = ((1, 2), (1, 3), (2, 4))
#: Most that the lengths' part may add to the difference, in bucket steps.
LENGTH_STEPS = 24
#: A difference from here on is likeness 0: texts with nothing in common differ in about so many steps.
FAR = BUCKETS * 13 // 8


def counts(raw: bytes) -> np.ndarray:
    """How many byte triplets of ``raw`` fall in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + 4, len(raw) - at), at).astype(np.uint32)
        whole = min(CHUNK, len(raw) - at)
        for salt, (second, third) in enumerate(SHAPES):
            n = min(whole, len(b) - third)
            if n <= 0:
                continue
            mixed = (b[:n] | b[second : second + n] << 8 | b[third : third + n] << 16 | salt + 1 << 24) * np.uint32(2654435761)
            mixed ^= mixed >> 15
            total += np.bincount((mixed * np.uint32(2246822519)) >> 24, minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    """130 hex digits: the length's logarithm in steps of an eighth, then each bucket's quartile in two bits.

    Equal texts have equal fingerprints; a null text is an empty one.
    """
    raw = (text or "").encode()
    found = counts(raw)
    ordered = np.sort(found)
    edges = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (found[:, None] > edges[None, :]).sum(axis=1).astype(np.uint8)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    length = min(255, round(8 * float(np.log2(len(raw) + 1))))
    return f"{length:02x}{packed.tobytes().hex()}"


_STEPS = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])
_STEPS = np.where(_STEPS == 3, 6, _STEPS)
_BYTES = np.arange(256)
_APART = sum(_STEPS[(_BYTES >> s & 3)[:, None], (_BYTES >> s & 3)[None, :]] for s in (0, 2, 4, 6)).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0: one less the bounded difference over its bound."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    length = min(LENGTH_STEPS, abs(int(x[0]) - int(y[0])))
    return 1.0 - min(FAR, int(_APART[x[1:], y[1:]].sum()) + length) / FAR


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = print_ if changed == text else fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), print_, changed_print, likeness(print_, changed_print), likeness(print_, next_print))


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of each row with ``fingerprint``; null texts count as empty, texts are hashed whole.

    Repeated rows are each fingerprinted; an empty table gives an empty one; a column named ``fingerprint`` is replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in (keep or docs.columns) if c.lower() != "fingerprint"]
    one = F.pandas_udf(lambda s: s.map(fingerprint), "string")
    return docs.select(*[F.col(f"`{c}`") for c in kept], one(F.col(f"`{text}`")).alias("fingerprint"))


def with_edits(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """Per document its fingerprint, its edited text's, and their likeness; and that to the next document's.

    The next document has the next smaller id (null ids come last, equal ids go
    by locator, the last is followed by the first). One range shuffle puts
    every document beside the next; only the first and last of each partition
    are matched by partition number afterwards. A single document follows
    itself; an empty table gives an empty result. Ids may be of any type that
    sorts; texts are read whole; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "quartile")
    rows, key = keyed(docs, scratch)
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    source = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(key).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # So many rows to a partition at most, however large the table; a count reads no text.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART))
    source = source.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    id_type = source.schema["doc_id"].dataType
    result = RESULT.format(id_type.simpleString())
    schema = result + ", edge int, text string"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge", "text"]
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for id_, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    id_, value = id_.as_py(), value.as_py()
                    print_ = fingerprint(value)
                    if held is None:  # the partition's first document
                        out.append((None, part, None, print_, None, None, None, 0, value))
                    else:
                        out.append((*_row(*held, value, print_), None, None))
                    held = (id_, value, print_)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], names) if out else pa.RecordBatch.from_pylist([], arrow)
        if held is not None:  # and its last
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "n_chars": part, "fingerprint": held[2], "edge": 1, "text": held[1]}], arrow)

    found = scratch.table(source.mapInArrow(run, schema), "found")
    # Two texts a partition are left; their number does not grow with a partition's rows.
    firsts = found.where("edge = 0").select(F.col("n_chars").alias("part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    lasts = found.where("edge = 1").select(F.col("n_chars").alias("part"), "doc_id", "text", "fingerprint")
    used = sorted(r.part for r in firsts.select("part").collect())  # partition numbers only
    after = [(a, b) for a, b in zip(used, used[1:] + used[:1], strict=True)]
    if not after:
        return found.select(*names[:7])
    follows = spark.createDataFrame(after, "part long, after long")
    edges = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "fingerprint", "following", "next_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [dict(zip(names, _row(*r.values()), strict=False)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(arrow)[:7]))

    return found.where("edge is null").select(*names[:7]).unionAll(edges.mapInArrow(finish, result))
