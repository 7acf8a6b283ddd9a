"""Tables in the folder that all executors share, rows sifted before a join, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, one of our own, deleted when the process ends; only on a
    local master, since no other machine could read it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor rereads them."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        self.spark = spark
        self.base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.rows: list[tuple[DataFrame, DataFrame]] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def sifted(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` is in that column of ``wanted``, and a few others; for a join that need not deal out all rows.

    A bitmap of hashes, 16 bits to a value and 16 MB at most, goes to all tasks.
    """
    bits = 1 << max(15, min(27, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    names, held, marks = rows.columns, fresh(rows, "_bucket"), fresh(rows, "_marks")
    marked = wanted.select(bucket.alias(held), bit.alias("bit")).groupBy(held).agg(F.bitmap_construct_agg("bit").alias(marks))
    byte = F.conv(F.hex(F.substring(F.col(marks), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.pmod(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return rows.withColumn(held, bucket).join(F.broadcast(marked), held).where(found).select(*[F.col(f"`{c}`") for c in names])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would.

    The archive is read by the driver alone, which serves it to the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it runs from an archive already
        target = os.path.join(tempfile.mkdtemp(prefix="orrery-code-"), "orrery_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(target)
    _shipped.add(sc.applicationId)
