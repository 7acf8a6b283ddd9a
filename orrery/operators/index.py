"""Approximate search: lists around two levels of centres, a best-first walk of them with bounds, and a graph of neighbours.

Centres have two levels, about the square root of the lists each, so what a
task or the driver holds of them grows with the fourth root of the vectors.
Every vector is in the list of its nearest fine centre, in that list's folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import ranking as R
from orrery.scratch import Scratch, ship

#: Vectors for each centre that k-means is fitted on; every vector is indexed.
POINTS = 64
#: Rows of one coarse cell, or of one block of a list, that a task holds.
CELL_ROWS = 50_000
BLOCK_ROWS = 4096
#: Values of a tile of distances.
TILE = 1 << 22
#: What an arc cosine may be off near the centre of a list.
SLACK = 1e-7
#: Neighbours of a node, and candidates that are weighed when they are chosen.
NEIGHBOURS, BUILD_EFFORT = 16, 64


def list_counts(rows: int) -> tuple[int, int]:
    """The usual numbers of lists for a table: one for a thousand rows, and the finer square root."""
    return max(1, rows // 1000), max(1, round(math.sqrt(rows)))


def probe_steps(lists: int, curve: Sequence[int] = (1, 2, 5, 10, 20)) -> list[int]:
    return sorted({step for step in curve if step <= lists} | {max(1, round(math.sqrt(lists)))})


def units(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms == 0, 1, norms)


def _block(vectors: Sequence) -> np.ndarray:
    """Rows of a column of vectors as units."""
    return units(np.array([np.asarray(v, np.float64) for v in vectors])) if len(vectors) else np.zeros((0, 0))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


# --- centres ---------------------------------------------------------------------


def _sampled(vectors: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows of the lowest seeded hashes, about ``share`` of all."""
    if share >= 1:
        return vectors
    edge = int(-(1 << 63) + share * (1 << 64))
    return vectors.where(F.xxhash64("id", F.lit(seed)) <= F.lit(min(edge, (1 << 63) - 1)))


def _coarse(points: DataFrame, count: int, seed: int, rounds: int) -> np.ndarray:
    """Unit centres by rounds of k-means; a round is one aggregate, of which the driver gets ``count`` sums."""
    first = points.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(count).select("vector").collect()
    found = _block([r.vector for r in first])
    for _ in range(rounds):
        held = found

        def sums(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(held), np.zeros(len(held), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    block = _block(batch.column(0).slice(at, 4096).to_pylist())
                    near = np.argmax(block @ held.T, axis=1)
                    np.add.at(total, near, block)
                    n += np.bincount(near, minlength=len(held))
            for i in np.flatnonzero(n):
                width = total.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, i)), pa.array(np.arange(width)), pa.array(total[i])], ["centre", "place", "total"])

        added = points.select("vector").mapInArrow(sums, "centre long, place long, total double").groupBy("centre", "place").agg(F.sum("total").alias("total"))
        found = found.copy()
        for row in added.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("all")).collect():  # a row of each centre
            found[row.centre] = units(np.array([[t for _, t in row["all"]]]))[0]
    return found


def _near(block: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each row, nearest first, in tiles."""
    count = min(count, len(centres))
    step = max(1, TILE // max(1, len(centres)))
    return np.concatenate([np.argsort(-(block[at : at + step] @ centres.T), axis=1, kind="stable")[:, :count] for at in range(0, len(block), step)] or [np.zeros((0, count), np.int64)])


def _in_cells(vectors: DataFrame, coarse: np.ndarray, spread: int) -> DataFrame:
    """``vectors`` (id, vector, ...) with the coarse cells they belong to, the nearest ``spread``: a row for each."""
    source = vectors.where("vector is not null")
    at = source.columns.index("vector")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _near(_block(batch.column(at).to_pylist()), coarse, spread) if batch.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    dealt = source.mapInArrow(deal, f"{_kinds(source)}, cells array<int>")
    return dealt.select(*source.columns, F.explode("cells").alias("cell"))


def _kmeans(points: np.ndarray, count: int, seed: int, rounds: int) -> np.ndarray:
    found = points[np.random.default_rng(seed).choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(rounds):
        near = _near(points, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        full = np.bincount(near, minlength=len(found)) > 0
        found = np.where(full[:, None], units(sums), found)
    return found


class Centres:
    """Coarse centres (held by the driver, the fourth root of the vectors many) and a table of fine ones: cell, list, centre."""

    def __init__(self, coarse: np.ndarray, fine: DataFrame, per_cell: int):
        self.coarse, self.fine, self.per_cell = coarse, fine, per_cell

    @classmethod
    def fit(cls, vectors: DataFrame, path: str, lists: int, *, seed: int = 7, rounds: int = 8) -> Centres:
        """Centres for about ``lists`` lists, fitted on about ``POINTS`` vectors for each of them; written to ``path``.

        A table without vectors gets one centre, that of no direction.
        """
        spark = vectors.sparkSession
        rows = vectors.where("vector is not null").select("id", "vector")
        total = rows.count()
        count = max(1, min(round(math.sqrt(lists)), total))
        per_cell = max(1, math.ceil(lists / count))
        scratch = Scratch(spark, "centres")
        points = scratch.table(_sampled(rows, 2 * POINTS * lists / max(1, total), seed), "points")
        coarse = _coarse(points, count, seed, rounds) if not points.isEmpty() else np.zeros((1, 1))
        celled = scratch.table(_in_cells(points, coarse, 1), "cells")
        sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
        # Of a crowded cell a share of its points, by hash, so that a cell's fit is bounded by its own centres.
        edge = F.lit(2 * POINTS * per_cell) / F.col("n")
        some = celled.join(F.broadcast(sizes), "cell").where((F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 20)) / (1 << 20)) <= edge)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            found = _kmeans(_block(pdf.vector), per_cell, seed, rounds)
            cell = int(pdf.cell.iloc[0])
            return pd.DataFrame({"cell": cell, "list": cell * per_cell + np.arange(len(found)), "centre": list(found)})

        ship(spark)
        some.select("id", "vector", "cell").groupBy("cell").applyInPandas(fit, "cell int, list int, centre array<double>").write.parquet(path)
        scratch.drop("points"), scratch.drop("cells")
        return cls(coarse, spark.read.parquet(path), per_cell)

    def placed(self, vectors: DataFrame, *, cells: int = 1, lists: int = 1) -> DataFrame:
        """``vectors`` (id, vector) with the ``lists`` nearest lists of the ``cells`` nearest cells: list, angle to its centre.

        A task meets the fine centres of one cell at a time; a crowded cell is
        dealt in blocks by the rows that it has.
        """
        celled = _in_cells(vectors.select("id", "vector"), self.coarse, cells)
        sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks"))
        small = F.broadcast(sizes)  # a row of each coarse cell
        rows = celled.join(small, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        held = self.fine.join(small, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("list")
            names, centres = right["list"].to_numpy(), _block(right["centre"].to_pylist()) if right.num_rows else np.zeros((0, 1))
            out = []
            for batch in left.to_batches(max_chunksize=4096):
                block = _block(batch["vector"].to_pylist())
                near = _near(block, centres, lists)
                cosine = np.einsum("rd,rkd->rk", block, centres[near])
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                out.append(pa.Table.from_batches([batch.take(pa.array(at)).select(["id", "vector"])]).append_column("list", pa.array(names[near].ravel(), pa.int32())).append_column("angle", pa.array(np.arccos(np.clip(cosine.ravel(), -1, 1)))))
            return pa.concat_tables(out) if out else pa.table({"id": left["id"], "vector": left["vector"], "list": pa.array([], pa.int32()), "angle": pa.array([], pa.float64())})

        ship(vectors.sparkSession)
        schema = f"{_kinds(vectors.select('id', 'vector'))}, list int, angle double"
        met = rows.select("id", "vector", "cell", "block").groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(meet, schema)
        if cells > 1:
            rank = F.row_number().over(Window.partitionBy("id").orderBy("angle", "list"))
            met = met.withColumn("place", rank).where(F.col("place") <= lists).drop("place")
        return met


# --- lists -----------------------------------------------------------------------


@dataclass(frozen=True)
class Walk:
    """What a budgeted walk found: its rows in order (id, distance), whether the budget cut it short, and the vectors that it read."""

    found: list[tuple]
    scan_limited: bool
    read: int
    lists: int


class ListIndex:
    """Vectors dealt to the list of their nearest centre, one folder a list, so that a probe reads only its lists.

    ``table`` has the vectors (id, vector, list), ``lists`` a row of each list
    that is not empty: its centre, its rows and the largest angle to its centre.
    """

    def __init__(self, spark: SparkSession, path: str, centres: Centres, schema: str):
        self.spark, self.path, self.centres = spark, path, centres
        self.lists = spark.read.parquet(f"{path}/lists")
        self.table = spark.read.schema(schema).parquet(f"{path}/dealt")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int, *, seed: int = 7) -> ListIndex:
        """Index every row of ``vectors`` (id, vector) whose vector is not null, under about ``lists`` lists.

        A list's rows come from one coarse cell, so its files are at most the
        blocks of that cell. Zero vectors have no direction; they are kept in
        some list and found by no search. An empty table gives an index that
        finds nothing.
        """
        centres = Centres.fit(vectors, f"{path}/centres", lists, seed=seed)
        centres.placed(vectors).write.partitionBy("list").parquet(f"{path}/dealt")
        spark = vectors.sparkSession
        schema = f"{_kinds(vectors.select('id', 'vector'))}, angle double, list int"
        dealt = spark.read.schema(schema).parquet(f"{path}/dealt")
        radii = dealt.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
        centres.fine.join(radii, "list").select("list", "centre", "rows", "radius").write.parquet(f"{path}/lists")
        return cls(spark, path, centres, schema)

    def _angles(self, query: Sequence[float]) -> DataFrame:
        """The lists with the angle of their centre to ``query``."""
        wanted = F.array(*[F.lit(float(x)) for x in query])
        cosine = F.least(F.greatest(1 - C.cosine_distance(F.col("centre"), wanted), F.lit(-1.0)), F.lit(1.0))
        return self.lists.select("list", "rows", "radius", F.acos(cosine).alias("angle"))

    def nearest(self, query: Sequence[float], limit: int, *, probes: int, exclude=None) -> DataFrame:
        """The ``limit`` nearest (id, distance) of the ``probes`` lists whose centres are nearest."""
        near = [r.list for r in self._angles(query).orderBy("angle", "list").limit(probes).collect()]  # a few numbers
        return R.nearest(self.table.where(F.col("list").isin(*near)), list(query), limit, exclude=exclude)

    def nearest_to_each(self, queries: DataFrame, k: int, *, probes: int) -> DataFrame:
        """For each of ``queries`` the ``k`` nearest of its probed lists (query_id, id, distance, rank).

        Queries are ranked against the lists' centres, then meet the vectors by
        list; each task hands on the best ``k`` of a query and list.
        """
        centres = self.lists.select(F.col("list").alias("id"), F.col("centre").alias("vector"))
        near = R.nearest_to_each(centres, queries, probes, exclude_self=False).select("query_id", F.col("id").alias("list"))
        asked = near.join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("wanted")), "query_id")
        blocks = self.lists.select("list", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("blocks"))
        rows = self.table.select("id", "vector", "list").join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        asked = asked.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        id_kind = R.arrow_kind(self.table, "id")
        query_kind = R.arrow_kind(queries, "id")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], query_kind), "id": pa.array([], id_kind), "distance": pa.array([], pa.float64())})
            out = []
            ids, block = R.id_array(left["id"]), R.unit_rows(left["vector"].to_pylist())
            for tile in right.to_batches(max_chunksize=max(1, TILE // left.num_rows)):
                asked_ids, unit = R.id_array(tile["query_id"]), R.unit_rows(tile["wanted"].to_pylist())
                out.append(R.best_of(asked_ids, unit, ids, block, k, exclude_self=True))
            queries_of, ids_of, distances = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table({"query_id": pa.array(queries_of, query_kind), "id": pa.array(ids_of, id_kind), "distance": pa.array(distances, pa.float64())})

        ship(self.spark)
        left, right = rows.select("id", "vector", "list", "block"), asked.select("query_id", "wanted", "list", "block")
        schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {self.table.schema['id'].dataType.simpleString()}, distance double"
        scored = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(best, schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def walk(self, query: Sequence[float], limit: int, *, budget: int, narrowed: DataFrame | None = None, exclude=None, first: int = 1) -> Walk:
        """The first ``limit`` of ``narrowed`` (id; None: all) in strict order of distance, reading at most ``budget`` vectors.

        Lists come best first, by a lower bound: the angle to the centre less
        the list's radius, which no member can undercut. They are read in waves
        of ``first`` lists, doubled each time, whole lists only. The walk ends
        when ``limit`` rows are nearer than any list not yet read may hold, when
        no list is left, or before a list that the budget cannot pay. What it
        then has is the exact answer's beginning: rows that an unread list
        could precede are left out, so no row is ever out of order. Zero and
        null vectors are in no answer; ties go by id.

        The driver takes the lists in order as it needs them, and ``limit`` rows
        a wave.
        """
        bounded = self._angles(query).select("list", "rows", F.greatest(F.col("angle") - F.col("radius") - SLACK, F.lit(0.0)).alias("bound")).where("bound is not null")
        if not any(query):
            return Walk([], False, 0, 0)
        order = bounded.orderBy("bound", "list").toLocalIterator()
        upcoming = next(order, None)
        found: list[tuple] = []
        read, lists, wave, short = 0, 0, first, False

        def sure() -> list[tuple]:
            edge = math.inf if upcoming is None else 1 - math.cos(min(upcoming.bound, math.pi))
            return [row for row in found if row[1] < edge]

        while upcoming is not None and len(sure()) < limit:
            chosen, cost = [], 0
            while upcoming is not None and len(chosen) < wave and read + cost + upcoming.rows <= budget:
                chosen.append(upcoming.list)
                cost += upcoming.rows
                upcoming = next(order, None)
            if not chosen:
                short = True
                break
            rows = self.table.where(F.col("list").isin(*chosen))
            if narrowed is not None:
                rows = rows.join(narrowed.select("id"), "id", "left_semi")
            found += [(r.id, r.distance) for r in R.nearest(rows, list(query), limit, exclude=exclude).collect()]
            found = sorted(found, key=lambda r: (r[1], r[0]))[:limit]
            read += cost
            lists += len(chosen)
            wave *= 2
        return Walk(sure()[:limit], short, read, lists)
