"""What filters of documents do to one another: every order of them, step by step, over long-form windows.

Documents come down to cells, one for each part and set of failed filters, with
their counts. Cells are unpivoted against the steps of all orders; a running
bit-or window over a cell's earlier steps tells what has removed it before, and
sums under conditions and a window total for each filter are the measures.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: More filters have over 5,040 orders, each a row of every part and step.
MOST_FILTERS = 7
SPACES_JAVA = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: A few words, B few distinct ones, C many capitals, D any of ``#$%&*|``."""
    words = F.array_remove(F.split(text, SPACES_JAVA), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    filters: Callable[[Column], dict[str, Column]] = text_filters,
    repeats: str | None = "E",
    text: str = "text",
    doc_id: str = "doc_id",
    part: str = "source",
    scratch: Scratch | None = None,
) -> tuple[DataFrame, str]:
    """Counts of documents by part and failed filters: part, mask, docs, good, toxic; and the filters' letters by bit.

    ``repeats`` names the filter that a document fails whose text some smaller
    ``doc_id`` of the whole table has too; None leaves it out. Texts are equal
    when their SHA-256 is. Null texts count as empty, null parts as the empty
    string; a null id is neither smaller nor larger than any, and of repeated
    ids with equal texts none is. ``labels`` (doc_id, quality, toxic) may lack
    documents and may repeat them: one row with a 1 is enough. Very long texts
    are read whole, repeated rows each count, an empty table gives no cell,
    other columns are not looked at.

    Rows are narrowed and written before they are joined. A text of very many
    copies is counted where it is read; its copies meet the least id under both
    text and id, so they spread.
    """
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    failed = filters(whole)
    letters = "".join(failed) + (repeats or "")
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or any(len(x) != 1 for x in failed):
        raise ValueError(f"one to {MOST_FILTERS} filters, each named by one letter")
    bits = F.lit(0)
    for i, condition in enumerate(failed.values()):
        bits = bits.bitwiseOR(F.when(condition, 1 << i).otherwise(0))
    part_of = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    narrow = docs.select(part_of.alias("part"), F.col(f"`{doc_id}`").alias("doc_id"), bits.alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    narrow = scratch.table(narrow, "masks")
    if repeats:
        least = narrow.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "least_digest")
        narrow = narrow.join(least, (F.col("digest") == F.col("least_digest")) & (F.col("doc_id") == F.col("least")), "left")
        again = F.col("doc_id").isNotNull() & F.col("least").isNull()
        narrow = narrow.withColumn("mask", F.col("mask").bitwiseOR(F.when(again, 1 << len(failed)).otherwise(0)))
    if labels is None:
        marked = narrow.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        one = labels.groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
        marked = narrow.join(one, F.col("doc_id") == F.col("labelled"), "left")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", "mask").agg(F.count("*").alias("docs"), *sums), letters


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter does: a row each, zeros included.

    Columns: part, filter_order, step (from 1), kept (after the step), removed
    (by it), redundant (fails its filter, removed before), unique_fails (fails
    that filter only), good_lost and toxic_lost (removed by it), shapley (the
    filter's removed, over all orders). A part has at most 2 to the number of
    filters cells, so its rows in one task are bounded; no cell gives no row.
    """
    orders = ",".join(map("".join, permutations(letters)))
    # Cells go by part once; all windows and sums below hold a part together.
    steps = counted.repartition(F.col("part")).withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)])
    steps = steps.withColumn("bit", bits[F.col("letter")]).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(condition: Column, count: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(count)).otherwise(0))

    found = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    found = found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return found.drop("letter")


def audit(docs: DataFrame, labels: DataFrame | None = None, **settings) -> DataFrame:
    """:func:`interactions` of the :func:`cells` of ``docs``; nulls, ties, repeats, long texts, empty tables and clashing names as there."""
    counted, letters = cells(docs, labels, **settings)
    return interactions(counted, letters)
