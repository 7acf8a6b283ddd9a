"""A graph of neighbours over vectors: built list by list, stored as a table of adjacency, searched by rounds of joins.

The lower layer holds all vectors, each with its neighbours; the upper layer
one representative of each block of a list, where searches begin. Within a
block every vector but the representative has an arc from one that is nearer to
it, so all of a block can be reached from its representative.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import ranking as R
from orrery.operators.index import BLOCK_ROWS, BUILD_EFFORT, NEIGHBOURS, Centres, units
from orrery.scratch import Scratch, ship, sifted

#: Lists that a vector is compared in when its neighbours are chosen, and coarse cells that these are taken from.
SPREAD, CELLS = 4, 2
#: Representatives where a search begins.
ENTRIES = 8
#: Rows of a block that are compared with all of it at once.
STRIP = 256


def _chosen(block: np.ndarray, distance: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates ``near`` (nearest first) stay: those nearer to the row than to any that stays before, ``most`` at most."""
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        between = 1 - np.einsum("rjd,rd->rj", block[near[:, :j]], block[near[:, j]])
        shaded = (kept[:, :j] & (between <= distance[:, j : j + 1])).any(axis=1)
        kept[:, j] = ~shaded & (kept.sum(axis=1) < most) & np.isfinite(distance[:, j])
    return kept


def block_arcs(vectors: np.ndarray, home: np.ndarray, neighbours: int, effort: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arcs within one block: from, to, distance, whether it belongs to the tree; and the representative's row (-1: none at home).

    Each row is compared with all others, a strip at a time, and its ``effort``
    nearest are weighed. Rows at home, by their distance from the one in the
    middle, each get a tree arc from the nearest before them; of several equally
    near the last, so that copies form a chain.
    """
    n = len(vectors)
    own = np.flatnonzero(home)
    head = -1
    order = np.zeros(0, np.int64)
    if len(own):
        middle = units(vectors[own].mean(axis=0, keepdims=True))[0]
        head = int(own[np.argmax(vectors[own] @ middle)])
        order = own[np.argsort(-(vectors[own] @ vectors[head]), kind="stable")]
        order = np.concatenate(([head], order[order != head]))
    sources, targets, lengths, trees = [], [], [], []

    def add(a: np.ndarray, b: np.ndarray, d: np.ndarray, tree: bool) -> None:
        sources.append(a), targets.append(b), lengths.append(d), trees.append(np.full(len(a), tree))

    count = min(effort, n - 1)
    for at in range(0, n, STRIP):
        rows = np.arange(at, min(at + STRIP, n))
        distance = 1 - vectors[rows] @ vectors.T
        distance[np.arange(len(rows)), rows] = np.inf
        if count > 0:
            near = np.argpartition(distance, count - 1, axis=1)[:, :count]
            by = np.take_along_axis(distance, near, 1)
            sort = np.argsort(by, axis=1, kind="stable")
            near, by = np.take_along_axis(near, sort, 1), np.take_along_axis(by, sort, 1)
            kept = _chosen(vectors, by, near, neighbours)
            i, j = np.nonzero(kept)
            add(rows[i], near[i, j], by[i, j], False)
    for at in range(1, len(order), STRIP):
        places = np.arange(at, min(at + STRIP, len(order)))
        before = 1 - vectors[order[places]] @ vectors[order[: places[-1] + 1]].T
        before[np.arange(before.shape[1])[None, :] >= places[:, None]] = np.inf
        parent = before.shape[1] - 1 - np.argmin(np.round(before[:, ::-1], 9), axis=1)
        add(order[parent], order[places], before[np.arange(len(places)), parent], True)
    join = (lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind))
    return join(sources, np.int64), join(targets, np.int64), join(lengths, np.float64), join(trees, bool), head


class GraphIndex:
    """``nodes``: id, vector, neighbours (list and id of each), list; a folder a list. ``heads``: the upper layer (id, vector, list)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.nodes, self.heads = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/heads")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int, *, neighbours: int = NEIGHBOURS, effort: int = BUILD_EFFORT, seed: int = 7) -> GraphIndex:
        """The graph over every row of ``vectors`` (id, vector) that has a direction; ids are distinct.

        Each vector meets those of its ``SPREAD`` nearest lists, in blocks of at
        most ``BLOCK_ROWS``; a list of more is dealt into blocks by hash. Arcs
        are taken both ways, and a node keeps the nearest twice ``neighbours``
        of them, and all tree arcs. Null and zero vectors are left out; an empty
        table gives a graph that finds nothing.
        """
        spark = vectors.sparkSession
        scratch = Scratch(spark, "graph")
        norm = C.dot(F.col("vector"), F.col("vector"))
        rows = vectors.select("id", "vector").where("id is not null and vector is not null").where(norm > 0)
        centres = Centres.fit(rows, f"{path}/centres", lists, seed=seed)
        placed = centres.placed(rows, cells=CELLS, lists=SPREAD)
        nearest = Window.partitionBy("id").orderBy("angle", "list")
        placed = scratch.table(placed.withColumn("home", F.first("list").over(nearest)), "placed")
        blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        dealt = placed.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
        kind = rows.schema["id"].dataType.simpleString()

        def connect(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            block = units(np.array([np.asarray(v, np.float64) for v in pdf.vector]))
            here = (pdf.home == pdf.list).to_numpy()
            a, b, length, tree, head = block_arcs(block, here, neighbours, effort)
            ids, homes = pdf.id.to_numpy(), pdf.home.to_numpy()
            if head >= 0:  # an arc from nowhere: the representative
                a, b, length, tree = np.append(a, head), np.append(b, head), np.append(length, -1.0), np.append(tree, True)
            return pd.DataFrame({"a": ids[a], "a_list": homes[a], "b": ids[b], "b_list": homes[b], "distance": length, "tree": tree})

        ship(spark)
        schema = f"a {kind}, a_list int, b {kind}, b_list int, distance double, tree boolean"
        arcs = scratch.table(dealt.select("id", "vector", "list", "home", "block").groupBy("list", "block").applyInPandas(connect, schema), "arcs")
        heads = arcs.where("distance = -1").select(F.col("a").alias("id"))
        found = arcs.where("distance > -1")
        back = found.select(F.col("b").alias("a"), F.col("b_list").alias("a_list"), F.col("a").alias("b"), F.col("a_list").alias("b_list"), "distance", F.lit(False).alias("tree"))
        both = found.unionAll(back).groupBy("a", "b").agg(F.first("b_list").alias("b_list"), F.min("distance").alias("distance"), F.max("tree").alias("tree"))
        place = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
        kept = both.withColumn("place", place).where((F.col("place") <= 2 * neighbours) | F.col("tree"))
        lists_of = kept.groupBy("a").agg(F.collect_list(F.struct(F.col("b_list").alias("list"), F.col("b").alias("id"))).alias("neighbours"))
        own = placed.where("list = home").select("id", "vector", "list")
        none = F.array().cast(lists_of.schema["neighbours"].dataType)
        nodes = own.join(lists_of, F.col("id") == F.col("a"), "left").select("id", "vector", F.coalesce("neighbours", none).alias("neighbours"), "list")
        # A list's rows are dealt to as many files as it has blocks.
        spread = nodes.join(blocks, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")))
        written = f"id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, neighbours {lists_of.schema['neighbours'].dataType.simpleString()}, list int"
        spread.repartition("list", "part").select("id", "vector", "neighbours", "list").write.partitionBy("list").parquet(f"{path}/nodes")
        made = cls.__new__(cls)
        made.spark, made.path, made.nodes = spark, path, spark.read.schema(written).parquet(f"{path}/nodes")
        made.nodes.join(heads, "id", "left_semi").select("id", "vector", "list").write.parquet(f"{path}/heads")
        made.heads = spark.read.parquet(f"{path}/heads")
        scratch.drop("placed"), scratch.drop("arcs")
        return made

    def _met(self, wanted: DataFrame, column: str) -> DataFrame:
        """Each of ``wanted`` (list, id, ...; written) with its node's ``column``; only its lists are read, and few other nodes are dealt out."""
        lists = [r.list for r in wanted.select("list").distinct().limit(257).collect()]
        nodes = self.nodes.where(F.col("list").isin(*lists)) if len(lists) <= 256 else self.nodes
        return wanted.join(sifted(nodes.select("list", "id", column), "id", wanted.select("id")), ["list", "id"])

    def _scored(self, wanted: DataFrame, asked: DataFrame) -> DataFrame:
        """The nodes of ``wanted`` (query_id, list, id) with their distance from the query, whose vector goes to the nodes."""
        met = self._met(wanted, "vector").withColumnRenamed("vector", "found").join(asked, "query_id")
        return met.select("query_id", "id", "list", F.round(C.cosine_distance(F.col("found"), F.col("wanted")), 12).alias("distance"))

    def nearest_to_each(self, queries: DataFrame, k: int, *, effort: int, exclude_self: bool = True, entries: int = ENTRIES) -> DataFrame:
        """For each of ``queries`` (id, vector) the ``k`` nearest that a beam of ``effort`` finds: query_id, id, distance, rank, scored.

        A search begins at the ``entries`` representatives nearest to its query,
        ranked exactly. A round takes the nodes of every query's beam that have
        not been asked, joins their neighbours, and keeps the best ``effort``;
        the search ends when all of a beam have been asked. ``scored`` is the
        number of distances that were computed for a query in the lower layer.
        A beam has room for ``k`` rows and the query itself at least. Zero and null queries find nothing. All queries go in one run; a round's
        beams, ``effort`` rows a query, are written to the shared folder. They hold names and distances only: a query's
        vector meets a node's for their distance, and neighbours are taken of the nodes that stay in a beam.
        """
        spark, scratch = self.spark, Scratch(self.spark, "beam")
        effort = max(effort, k + int(exclude_self))
        asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("wanted")).where("query_id is not null and wanted is not null")
        asked = scratch.table(asked, "asked")
        start = R.nearest_to_each(self.heads.select("id", "vector"), queries, entries, exclude_self=False).select("query_id", "id")
        start = start.join(self.heads.select("id", "list"), "id").join(asked.select("query_id"), "query_id", "left_semi")
        fresh = scratch.table(start.select("query_id", "list", "id"), "wanted-0")
        best = Window.partitionBy("query_id").orderBy("distance", "id")
        beam, turn = None, 0
        while not fresh.isEmpty():
            met = self._scored(fresh, asked).where("distance is not null").withColumns({"done": F.lit(False), "scored": F.lit(1).cast("long")})
            if beam is not None:
                met = beam.withColumn("done", F.lit(True)).unionByName(met)
            total = F.sum("scored").over(Window.partitionBy("query_id"))
            place = F.row_number().over(best)
            met = met.withColumns({"total": total, "place": place}).where(F.col("place") <= effort)
            # The count of a query stands with its first row.
            met = met.withColumn("scored", F.when(F.col("place") == 1, F.col("total")).otherwise(F.lit(0)).cast("long")).drop("total", "place")
            beam = scratch.table(met, f"beam-{turn}")
            turn += 1
            steps = self._met(beam.where("not done").select("query_id", "list", "id"), "neighbours").select("query_id", F.explode("neighbours").alias("to"))
            steps = steps.select("query_id", F.col("to.list").alias("list"), F.col("to.id").alias("id"))
            steps = steps.dropDuplicates(["query_id", "id"])
            fresh = scratch.table(steps.join(beam.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "list", "id"), f"wanted-{turn}")
        if beam is None:
            kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {self.nodes.schema['id'].dataType.simpleString()}, distance double, rank int, scored long"
            return spark.createDataFrame([], kinds)
        counted = beam.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
        if exclude_self:
            counted = counted.where("query_id != id")
        return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "scored")

    def nearest(self, query: Sequence[float], limit: int, *, effort: int) -> DataFrame:
        """The ``limit`` nearest (id, distance) that a beam of ``effort`` finds, ties by id."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "id long, vector array<double>")
        return self.nearest_to_each(one, limit, effort=effort, exclude_self=False).select("id", "distance")

    def unreached(self) -> DataFrame:
        """The nodes (id) that no path from the upper layer leads to; found by rounds of joins, none in a whole graph."""
        scratch = Scratch(self.spark, "reach")
        arcs = scratch.table(self.nodes.select("id", F.explode("neighbours.id").alias("to")), "arcs")
        reached = scratch.table(self.heads.select("id"), "reached-0")
        step, turn = reached, 0
        while not step.isEmpty():
            turn += 1
            step = scratch.table(step.join(arcs, "id").select(F.col("to").alias("id")).distinct().join(reached, "id", "left_anti"), f"step-{turn}")
            reached = scratch.table(reached.unionAll(step), f"reached-{turn}")
        return self.nodes.select("id").join(reached, "id", "left_anti")


def effort_curve(lists: int, k: int) -> list[int]:
    """Efforts to measure recall at: k and its doublings, as long as a beam is smaller than a tenth of what there is."""
    return [k << n for n in range(max(1, round(math.log2(max(2, lists)))))]
