"""Exact deduplication by streaming state: every digest ever seen stays in a disk-backed keyed store.

Only DataFrame functions are used here: the state is that of a streaming
aggregation held by Spark's own disk-backed provider.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, keyed

#: The keyed state lives on disk, with checkpoints in the shared folder; small partitions take no space ahead, and an
#: executor's stores share a bounded memory however many partitions it has.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    batches: int = 2,
    state: str | None = None,
    batch: str | None = None,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, str]:
    """Per row of ``docs``: locator, doc_id, keep_id, group_size, kept, text_sha256; and the locator's name.

    Texts are equal when their bytes are; null counts as empty. Of equal texts
    the row of the largest doc_id stays (null ids come before all others; among
    repeated ids, the row of the last locator). Very long texts are compared
    whole. An empty table gives an empty result, other columns of ``docs`` are
    not looked at.

    The rows' digests go in ``batches`` micro-batches through a stream whose
    state, keyed by digest and without expiry, holds the number of rows and the
    row that stays: its identifier and the locator of its content. With
    ``state``, a shared folder that the caller owns, checkpoint and state stay
    there: a later call with other rows finds the digests of all earlier ones,
    so ``keep_id`` and ``group_size`` are then of all rows ever given. The same
    rows given again, as after a failure, change nothing: a call's rows go by
    the name ``batch``, which by default is made from their ids and digests.
    The folder must not be used by two calls at once.

    Digests that the state has more than one row for are hits: their rows are
    compared byte by byte with the content that the state locates, in this
    table or in the files of an earlier call, and so is the content that stayed
    before. A digest under which bytes differ (no matter how weak ``digest``
    is) is noted for good, and all its rows, of every call, are grouped by
    their bytes. Rows of a hot digest are counted before they are shuffled;
    their comparison is a join that adaptive execution splits.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    if state:
        batch = batch or _name(docs, text, doc_id, digest)
        rows, key = keyed(docs, _Lasting(spark, "exact", f"{state}/content-{batch}"), paths=True)
    else:
        rows, key = keyed(docs, scratch)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = rows.select(F.col(key).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text"))
    source = source.withColumn("digest", digest(F.col("text")))
    narrow = scratch.table(source.select("row", "doc_id", "digest"), "digests")

    updates = _through_state(narrow, state or scratch.path("stream"), batch or "all", batches)
    if state:  # of all that it has ever held, what these rows ask for
        updates = updates.join(narrow.select("digest").distinct(), "digest", "left_semi")
    # A digest is changed by every batch that holds it; its last state has the largest count.
    latest = updates.groupBy("digest").agg(F.max_by(F.struct("keep", "rows"), "rows").alias("s"))
    # Written, so that adaptive execution may split the joins of a hot digest.
    found = scratch.table(latest.select("digest", "s.keep", "s.rows"), "found")
    several = found.where(F.col("rows") > 1).select(F.col("digest").alias("d"), F.col("keep.row").alias("keep_row"))
    members = source.join(several, F.col("digest") == F.col("d")).select("digest", "row", "doc_id", "text", "keep_row")
    members = scratch.table(members, "hits")
    content = members.where(F.col("row") == F.col("keep_row")).select(F.col("digest").alias("d"), F.col("text").alias("kept_text"))
    asked = members.select("digest", "text")
    if state:
        away = several.join(content.select("d"), "d", "left_anti").select(F.col("d").alias("digest"), F.col("keep_row").alias("row"))
        content = content.unionAll(_located(away, text, spark).select("digest", "text"))
        before = updates.select("digest", F.col("keep.row").alias("row")).distinct().join(several, F.col("digest") == F.col("d")).where(F.col("row") != F.col("keep_row"))
        asked = asked.unionAll(_located(before.select("digest", "row"), text, spark).select("digest", "text"))
    differing = asked.join(content, F.col("digest") == F.col("d")).where(F.col("text") != F.col("kept_text")).select("digest").distinct()
    collided = scratch.table(differing, "collided")
    if state:
        collided.write.mode("overwrite").parquet(f"{state}/collided/{batch}")
        collided = spark.read.schema(collided.schema).option("recursiveFileLookup", "true").parquet(f"{state}/collided").distinct()

    decided = narrow.join(found.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).drop("d")
    if not collided.isEmpty():
        if state:
            everyone = spark.read.schema(narrow.schema).option("recursiveFileLookup", "true").parquet(f"{state}/arrivals")
            everyone = _located(everyone.join(collided, "digest", "left_semi"), text, spark)
        else:
            everyone = members.join(collided, "digest", "left_semi")
        everyone = scratch.table(everyone.select("digest", "row", "doc_id", "text"), "collisions")
        last = F.max(F.struct("doc_id", "row")).alias("keep")
        regrouped = everyone.groupBy("digest", "text").agg(last, F.count("*").alias("rows"))
        apart = everyone.join(regrouped.select(F.col("digest").alias("d"), F.col("text").alias("t"), "keep", "rows"), [F.col("digest") == F.col("d"), F.col("text") == F.col("t")])
        apart = apart.select(F.col("row").alias("a_row"), F.col("keep").alias("a_keep"), F.col("rows").alias("a_rows"))
        decided = decided.join(apart, F.col("row") == F.col("a_row"), "left")
        decided = decided.withColumns({"rows": F.coalesce("a_rows", "rows"), "keep": F.coalesce("a_keep", "keep")})
    return decided.select(
        F.col("row").alias(key),
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ), key


class _Lasting(Scratch):
    """Tables that are written once: what a call that failed has written whole is found by the next."""

    def table(self, df: DataFrame, name: str) -> DataFrame:
        if not _whole(self.spark, self.path(name)):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return _there(spark, f"{path}/_SUCCESS")


def _name(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> str:
    """A name for just these rows, whatever their order: their number and two sums over ids and digests."""
    pair = F.col(f"`{doc_id}`"), digest(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    sums = [F.coalesce(F.sum(F.xxhash64(*pair, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    row = docs.agg(F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *sums), 256).alias("name")).first()
    return row.name[:32]


def _located(wanted: DataFrame, text: str, spark: SparkSession) -> DataFrame:
    """``wanted`` (row, a locator, and more) with the ``text`` that lies there; only the files named are read."""
    files = [r.file for r in wanted.select(F.substring_index("row", "#", 1).alias("file")).distinct().collect()]  # names of files only
    if not files:
        return wanted.withColumn("text", F.lit("")).limit(0)
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    stored = spark.read.parquet(*map(unquote, files)).select(where.alias("at"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return stored.join(wanted, F.col("at") == F.col("row")).drop("at")


def _through_state(narrow: DataFrame, folder: str, name: str, count: int) -> DataFrame:
    """What the state has held since it began, ``narrow`` included: per digest and batch that changed it, the row that stays and the number of rows.

    Rows arrive in ``count`` parts, each a micro-batch that finds the state as
    the one before left it; a part that has arrived does not arrive again. What
    a batch changed is written under its number, so a batch that is run again
    writes the same.
    """
    spark = narrow.sparkSession
    before = {setting: spark.conf.get(setting, None) for setting in STORE}
    for setting, value in STORE.items():
        spark.conf.set(setting, value)
    kept = F.max(F.struct("doc_id", "row")).alias("keep")
    arrivals, updates = f"{folder}/arrivals", f"{folder}/updates"
    part = F.pmod(F.xxhash64("row"), F.lit(count))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch-{n}")

    try:
        for i in range(count):
            if not _whole(spark, f"{arrivals}/{name}-{i}"):
                narrow.where(part == i).write.mode("overwrite").parquet(f"{arrivals}/{name}-{i}")
            stream = spark.readStream.schema(narrow.schema).option("recursiveFileLookup", "true").parquet(arrivals)
            state = stream.groupBy("digest").agg(kept, F.count("*").alias("rows"))
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
    finally:
        for setting, value in before.items():
            if value is None:
                spark.conf.unset(setting)
            else:
                spark.conf.set(setting, value)
    if not _there(spark, updates):  # nothing has ever come
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(updates)


def distinct_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; nulls, ties, repeats and empty tables as in :func:`duplicates`."""
    scratch = settings.pop("scratch", None) or Scratch(docs.sparkSession, "exact")
    rows, key = keyed(docs, scratch)
    found, locator = duplicates(docs, scratch=scratch, **settings)
    mark = fresh(rows, "_stays")
    stay = found.where("kept").select(F.col(locator).alias(mark))
    kept = rows.join(stay, F.col(key) == F.col(mark), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
