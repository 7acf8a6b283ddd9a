"""Mix sources to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, Scratch, fresh, keyed

#: No document is taken more often than this.
EPOCHS = 3
#: Documents to a partition of the range sort.
PART = 1_000_000


def words(text: Column) -> Column:
    """The number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, *, epochs: int = EPOCHS) -> DataFrame:
    """From one row per source (source, source_size) the words that the mix should take of each.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share
    all words by weight. A target stops at ``epochs`` times its source's size;
    the excess goes to the others by weight until none is above. In closed
    form: with sources sorted by cap over weight, those before the fill level
    get their cap, the rest the level times their weight. One row per source is
    all that meets in a task here.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = weighed.withColumns(
        {
            "caps_before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "budget": F.sum("source_size").over(everything),
        }
    )
    # The level is what is left when all sources capped before are full. It rises
    # up to the first source whose own cap lies above it, and falls after that.
    filled = filled.withColumn("level_here", (F.col("budget") - F.col("caps_before")) / F.col("weight_left"))
    level = F.max(F.when(F.col("cap") > F.col("level_here") * F.col("weight"), F.col("level_here"))).over(everything)
    filled = filled.withColumn("level", level)
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "weight", "budget", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    epochs: int = EPOCHS,
    seed: int = 42,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, str]:
    """How often each row of ``docs`` is taken.

    Every source's documents are shuffled by a seeded hash of id and text and
    queued one after another, up to ``epochs`` times over. A document's virtual
    finish time is the words queued so far in its source, its own included,
    over the source's target. The queue of all sources is served in order of
    that time; the first document that would pass the total budget (all words)
    ends the mix. Whole documents only.

    Returns the decisions (row locator, doc_id, size, source_size, target,
    times, taken) for every row, and the locator's name; the second frame of
    :func:`taken_rows` has the rows themselves. Null texts have size 0 and are
    never taken, as are sources of no words; null sources form one source;
    repeated rows are documents of their own, told apart by their locator; ties
    in time go by source, id and locator. So reruns agree, where rows repeat as
    long as these lie in the same files. An empty table gives
    an empty result.

    Very long texts are counted whole; columns of ``docs`` that are not named
    here are not looked at. At scale only (locator, id, source, size) move, and
    no task sees a whole source: running sums go over blocks of a source's hash
    range, as many as a block has rows, then within a block. The queue is one
    range sort by finish time; sums of its partitions find the one in which the
    budget ends, a running sum there the document.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    rows, key = keyed(docs, scratch)
    narrow = rows.select(
        F.col(key).alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        words(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")), F.lit(seed)).alias("base"),
    )
    # The one pass over the texts; everything below reads this narrow table.
    narrow = scratch.table(narrow, "sizes")
    total = narrow.count()
    blocks = max(1, math.isqrt(total))

    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.table(targets(sizes, epochs=epochs).coalesce(1), "targets")
    budget = F.coalesce(F.max("budget"), F.lit(0))

    # Rows of one id and text, if there are any, are told apart by their locator's end, so that they do not meet in one block.
    repeated = scratch.table(narrow.groupBy(F.col("base").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "repeated")
    narrow = narrow.join(repeated, F.col("base") == F.col("again"), "left")
    place = F.when(F.col("again").isNull(), F.col("base")).otherwise(F.xxhash64("base", F.substring_index("row", "/", -1)))
    dealt = narrow.withColumns({"place": place, "block": F.pmod(F.shiftrightunsigned(place, 20), F.lit(blocks))})
    in_block = ["source", "block"]
    sums = dealt.groupBy(*in_block).agg(F.sum("size").alias("block_size"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("block_size").over(upto), F.lit(0))).drop("block_size")
    within = Window.partitionBy("source", "block").orderBy("place", "doc_id", "row")
    queued = dealt.withColumn("here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = [queued["source"].eqNullSafe(sums["source"]), queued["block"] == sums["block"]]
    queued = queued.join(sums, same).select(queued["*"], sums["before"])
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    queued = queued.join(p, queued["source"].eqNullSafe(p["p_source"])).drop("p_source")
    queued = scratch.table(
        queued.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("before") + F.col("here")).alias("finish_words")),
        "queued",
    )

    copies = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "row", "doc_id", "source", "size", "source_size", "target", "finish_words",
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
    )
    finish = (F.col("epoch") * F.col("source_size") + F.col("finish_words")) / F.col("target")
    order = ["finish", F.col("source").asc_nulls_last(), "doc_id", "row", "epoch"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * epochs // PART))
    copies = copies.select("row", "doc_id", "source", "size", "epoch", finish.alias("finish"))
    queue = copies.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    queue = scratch.table(queue, "queue")
    by_part = queue.groupBy("part").agg(F.sum("size").alias("part_size"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_part = by_part.withColumn("through", F.sum("part_size").over(so_far))  # one row per partition
    limit = plan.agg(budget.alias("budget"))
    last = by_part.crossJoin(F.broadcast(limit)).where(F.col("through") > F.col("budget"))
    found = last.orderBy("part").withColumn("served", F.col("through") - F.col("part_size")).first()
    if found is None:
        served = queue.select("row")
    else:
        serving = Window.partitionBy("part").orderBy(*order)
        edge = queue.where(F.col("part") == found["part"])
        edge = edge.withColumn("through", F.sum("size").over(serving.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        edge = edge.where(F.col("through") + F.lit(found["served"]) <= F.lit(found["budget"])).select("row")
        served = queue.where(F.col("part") < found["part"]).select("row").unionAll(edge)
    times = served.groupBy("row").agg(F.count("*").alias("times"))
    decided = queued.join(times, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target",
        F.coalesce("times", F.lit(0)).alias("times"),
        (F.coalesce("times", F.lit(0)) * F.col("size")).alias("taken"),
    )
    return decided.withColumnRenamed("row", key), key


def taken_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Null and empty texts and those of no word are never taken; ties, repeated
    rows, very long texts and empty tables are as in :func:`mix`.
    """
    scratch = settings.pop("scratch", None) or Scratch(docs.sparkSession, "mixing")
    rows, key = keyed(docs, scratch)
    decided, _ = mix(docs, scratch=scratch, **settings)
    times = fresh(docs, "_times")
    chosen = decided.where(F.col("times") > 0).select(F.col(decided.columns[0]).alias(key), F.col("times").alias(times))
    copy = fresh(docs, "_copy")
    taken = rows.join(chosen, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
