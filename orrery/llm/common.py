"""What the operators of this subpackage share: scratch tables, row keys, code shipping, caches."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.scratch import Scratch, fresh, shared_dir, ship, sifted  # noqa: F401  shared by the operators

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, scratch: Scratch, *, paths: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row for good: file and row index, the content's locator.

    Rows that do not come straight from files are written to a scratch table
    first, so that the locator survives recomputation; there it is the part's
    number and the row index, the same in every run that deals rows alike, or
    with ``paths`` the file there.
    """
    name = fresh(docs, "_row_locator")
    where: Column = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    if _straight_from_files(docs):
        return docs.withColumn(name, where), name
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    numbered = where if paths else F.concat_ws("#", part, F.col("_metadata.row_index").cast("string"))
    for seen, written in scratch.rows:
        if seen is docs:
            return written.withColumn(name, numbered), name
    written = scratch.table(docs, f"rows-{len(scratch.rows)}")
    scratch.rows.append((docs, written))
    return written.withColumn(name, numbered), name


def _straight_from_files(docs: DataFrame) -> bool:
    lines = [line.lstrip(" +-:") for line in docs._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")]
    return lines[-1].startswith("Relation") and all(line.startswith(("Project", "Filter", "Relation")) for line in lines)


#: Spark's setting for the bytes of an Arrow batch (64 MB by default), and ours. The JVM and the worker hold a batch several times over in each task.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python hold ``BATCH`` bytes, unless the session has a bound of its own; each holds one row at least."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)


_memos: list[weakref.ref] = []


def release(*keep: TwoGenerations) -> None:
    """At a task's start: give back what earlier tasks of other operators left in this worker; their memos but for ``keep``, and freed memory."""
    for held in _memos:
        memo = held()
        if memo is not None and all(memo is not k for k in keep):
            memo.clear()
            memo.old = {}
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class TwoGenerations(dict):
    """A memo bounded at twice ``most`` entries: when the young half is full it becomes the old half. Keys over ``longest`` are not kept."""

    def __init__(self, compute, most: int = 250_000, longest: int = 1 << 30):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}
        _memos.append(weakref.ref(self))

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
            if len(key) > self.longest:
                return found
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def pieces_of(text: str, pattern, most: int = 1 << 18) -> Iterator[str]:
    """Cut ``text`` at matches of ``pattern`` (an empty place), in pieces of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        found = pattern.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text
