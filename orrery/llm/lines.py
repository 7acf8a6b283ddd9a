"""Line deduplication by a deletion-neighbourhood join over characters.

The neighbourhood is taken in two steps, so that its size does not grow with
the square of a line. First a line's symbols are ``BLOCKS`` blocks of it, and
its variants are the line with one block deleted; nearly all lines share none
of these with another line and go no further. Of the lines that do, the
symbols of the deleted block are its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, keyed, ship

#: Blocks that a line is cut in; shorter lines have a block for each character.
BLOCKS = 4
#: An edit is allowed to lines that have so many characters for each edit.
CHARACTERS_AN_EDIT = 4
#: What a variant row says: own block less a character, own block whole, or the block of the longer line less a character.
REPLACED, WHOLE, CUT = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def normal(line: str) -> str:
    """The line's words, one space between them."""
    return b" ".join(line.encode().split()).decode()


def _remainder(line: str, start: int, end: int, seed: int) -> int:
    return xxhash.xxh3_64_intdigest((line[:start] + "\n" + line[end:]).encode(), seed & 0xFFFFFFFFFFFFFFFF)


def blocks(line: str, least: int = CHARACTERS_AN_EDIT, cuts: int = BLOCKS) -> Iterator[tuple[int, int, int, bool]]:
    """(key, start, end, longer) of each variant with one block deleted.

    Blocks are those of a line of this length, and, as ``longer``, those of a
    line one character shorter, each taking in one character more. So two
    lines one edit apart have a variant in common: the one that deletes the
    block in which the edit lies.
    """
    n = len(line)
    for length, longer in ((n, False), (n - 1, True)):
        if length < 1 or n + 1 - longer < least:
            continue
        for j in range(cuts):
            start, end = length * j // cuts, length * (j + 1) // cuts
            if start < end:
                yield _remainder(line, start, end + longer, length * cuts + j), start, end + longer, longer


def deletions(block: str, key: int) -> np.ndarray:
    """Hashes of ``block`` whole, and with each of its characters deleted; all under ``key``.

    The hash is a polynomial over the characters, so each variant takes one
    step from the sums before and after the deleted one.
    """
    h = np.frombuffer(block.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(h)
    h = (h + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x165667B19E3779F9)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _STEP), out=power[1:])
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)))
    without = before[:n] + (before[n] - before[1:]) * _BACK
    mixed = (np.concatenate((before[n:], without)) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(31)


def _marked(hashes: np.ndarray, marks: np.ndarray | int) -> np.ndarray:
    """Hashes told apart by ``marks``."""
    mixed = (hashes + np.uint64(marks) if isinstance(marks, int) else hashes + marks.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ mixed >> np.uint64(30)).view(np.int64)


def variants(line: str, live: set[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Of the blocks whose key is in ``live``, the hashed variants and what they say.

    A place goes into the hash of ``REPLACED`` variants: equal ones differ in
    the character there and nowhere else. A ``WHOLE`` variant equals a ``CUT``
    one where the latter's line has one character more.
    """
    for key, start, end, longer in blocks(line):
        if (key if key < 1 << 63 else key - (1 << 64)) not in live:
            continue
        found = deletions(line[start:end], key)
        if longer:
            yield np.unique(_marked(found[1:], 1)), CUT
        else:
            if len(line) >= CHARACTERS_AN_EDIT:
                yield _marked(found[1:], np.arange(2, end - start + 2)), REPLACED
            yield _marked(found[:1], 1), WHOLE


def within_one(a: str, b: str) -> bool:
    """Whether at most one character is inserted, deleted or replaced between ``a`` and ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _table(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, str]:
    """One record per line (``line`` counts from 0; at -1 stands the document with its lines' number as ``two``), the rows, and the locator's name."""
    rows, key = keyed(df, scratch)
    source = rows.select(F.col(key).alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                owner, number, one, two, keys = [], [], [], [], []
                for i, value in enumerate(batch.column("text")):
                    value = value.as_py()
                    split = [] if value is None else value.split("\n")
                    owner.append(i)
                    number.append(-1)
                    one.append(None)
                    two.append(len(split))
                    keys.append(None)
                    for n, line in enumerate(split):
                        line = normal(line)
                        owner.append(i)
                        number.append(n)
                        if line:
                            h = xxhash.xxh3_128_digest(line.encode())
                            one.append(int.from_bytes(h[:8], "big", signed=True))
                            two.append(int.from_bytes(h[8:], "big", signed=True))
                            keys.append([k if k < 1 << 63 else k - (1 << 64) for k, *_ in blocks(line)])
                        else:
                            one.append(None)
                            two.append(None)
                            keys.append(None)
                places = pa.array(owner, pa.int32())
                columns = [batch.column("row").take(places), batch.column("doc_id").take(places), pa.array(number, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "line", "one", "two", "keys"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(run, f"row string, doc_id {kind}, line int, one long, two long, keys array<long>")
    return scratch.table(found, "lines"), source, key


def repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, str]:
    """The lines that go, as (row, line), all lines (row, doc_id, line), and the locator's name.

    A line goes when an earlier one (by doc_id, locator, line number; null ids
    last) has the same words, or is one character insertion, deletion or
    replacement away once words stand one space apart, and the longer of the
    two has ``CHARACTERS_AN_EDIT`` characters or more; so of shorter lines only
    equal ones go. Lines without a word stay, a null text has no line, an empty
    one has one. Very long lines are compared whole. Repeated rows are
    documents of their own, told apart by their locator. An empty table gives
    empty results; other columns of ``docs`` are not looked at.

    Texts are read where they lie and only numbers are shuffled: 128 bits name
    a line's words, and each distinct line sends its variants less one block.
    Only lines that share one have their text fetched again, send the variants
    of that block's characters, and are compared in full with the earliest line
    that shares one. A variant that millions of lines share is one row per task
    after aggregation; no pair is made but of a line and its variant's earliest.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "lines")
    all_, source, key = _table(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), scratch)
    source_ids = all_.schema["doc_id"].dataType
    named = all_.where("one is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line", "keys")
    heads = scratch.table(named.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).select("one", "two", "n", "first.*"), "heads")
    several = heads.where("n > 1").select(F.col("one").alias("o"), F.col("two").alias("t"), F.col("row").alias("r"), F.col("line").alias("l"))
    later = named.join(several, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).where("row != r or line != l").select("row", "line")

    # Keys that two distinct lines share; a written table, so that it is broadcast where it is small and joined by a shuffle where not.
    shared = heads.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    shared = scratch.table(shared, "shared")
    cut = heads.select("none", "doc_id", "row", "line", F.explode("keys").alias("key"))
    alive = cut.join(shared, F.col("key") == F.col("k")).groupBy("none", "doc_id", "row", "line").agg(F.collect_set("key").alias("live"))
    wanted = alive.groupBy("row").agg(F.collect_list(F.struct("none", "doc_id", "line", "live")).alias("lines"))  # at most a document's lines
    fetched = source.select(F.col("row").alias("at"), "text").join(wanted, F.col("at") == F.col("row")).drop("at")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = []
                for row, value, chosen in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                    split = value.split("\n")
                    out += [{"none": c["none"], "doc_id": c["doc_id"], "row": row, "line": c["line"], "norm": normal(split[c["line"]]), "live": c["live"]} for c in chosen]
                yield pa.RecordBatch.from_pylist(out, schema)

    kind, ids = to_arrow_type(source_ids), source_ids.simpleString()
    schema = pa.schema([("none", pa.bool_()), ("doc_id", kind), ("row", pa.string()), ("line", pa.int32()), ("norm", pa.string()), ("live", pa.list_(pa.int64()))])
    texts = fetched.select("row", "text", "lines").mapInArrow(fetch, f"none boolean, doc_id {ids}, row string, line int, norm string, live array<long>")
    # Sorted, so that the numbers given to the lines are in their order.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.repartitionByRange(parts, "none", "doc_id", "row", "line").sortWithinPartitions("none", "doc_id", "row", "line")
    texts = scratch.table(texts.withColumn("id", F.monotonically_increasing_id()), "candidates")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found, says, owner = [], [], []
                for i, (line, live) in enumerate(zip(batch.column("norm").to_pylist(), batch.column("live").to_pylist(), strict=True)):
                    for hashes, role in variants(line, set(live)):
                        found.append(hashes)
                        says.append(np.full(len(hashes), role, np.int32))
                        owner.append(np.full(len(hashes), i, np.int32))
                if found:
                    places = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(says)), batch.column("id").take(places)], ["variant", "role", "id"])

    slim = scratch.table(texts.select("id", "norm", "live").mapInArrow(spread, "variant long, role int, id long"), "variants")
    first = [F.min(F.when(F.col("role") == role, F.col("id"))).alias(f"first_{role}") for role in (REPLACED, WHOLE, CUT)]
    best = slim.groupBy(F.col("variant").alias("v")).agg(*first, F.count("*").alias("n")).where("n > 1").drop("n")
    joined = slim.join(best, F.col("variant") == F.col("v"))
    partner = F.when(F.col("role") == REPLACED, F.col("first_0")).when(F.col("role") == WHOLE, F.col("first_2")).otherwise(F.col("first_1"))
    pairs = joined.select("id", partner.alias("other")).where("other < id").distinct()
    names = texts.select("id", "norm")
    both = pairs.join(names.toDF("id", "a"), "id").join(names.toDF("other", "b"), "other").select("id", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good, pa.bool_()))], ["id"])

    gone = scratch.table(both.mapInArrow(verify, "id long").distinct(), "gone")
    firsts = texts.join(gone, "id", "left_semi").select("row", "line")
    return later.unionAll(firsts), all_.where("line >= 0").select("row", "doc_id", "line"), key


def per_document(docs: DataFrame, **settings) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed and kept_lines (numbers of the lines that stay).

    A null text has no lines, so three times nothing; otherwise as :func:`repeated_lines` says.
    """
    scratch = settings.pop("scratch", None) or Scratch(docs.sparkSession, "lines")
    gone, _, _ = repeated_lines(docs, scratch=scratch, **settings)
    lines = docs.sparkSession.read.parquet(scratch.path("lines"))
    documents = lines.where("line = -1").select("row", "doc_id", F.col("two").cast("int").alias("n"))
    left = gone.groupBy("row").agg(F.collect_list("line").alias("lines"))  # at most a document's lines
    per = documents.join(left, "row", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return per.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.size("lines").cast("long").alias("n_removed"), F.array_except(every, "lines").alias("kept_lines"))
