"""Exact ranking by cosine distance: one query, many queries, pages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.functions.columns import dot
from orrery.scratch import Scratch, ship

#: Queries are shipped to the executors in blocks of so many values at most.
BLOCK_VALUES = 4_000_000
#: Distances that a task holds at once.
TILE = 1 << 22


def nearest(vectors: DataFrame, query: list[float], limit: int, *, exclude=None, narrowing: Column | None = None) -> DataFrame:
    """The ``limit`` vectors nearest to ``query`` (id, distance), ties by id.

    The narrowing is applied before the cut. The cut is a top-k in every task
    and a merge of those; nothing is shuffled but k rows a task.
    """
    if narrowing is not None:
        vectors = vectors.where(narrowing)
    if exclude is not None:
        vectors = vectors.where(F.col("id") != F.lit(exclude))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    # The query's length is taken once, here; a query without a direction is near to nothing.
    unit = F.array(*[F.lit(float(x) / length if length else None).cast("double") for x in query])
    distance = 1 - F.try_divide(dot(F.col("vector"), unit), F.sqrt(dot(F.col("vector"), F.col("vector"))))
    ranked = vectors.select("id", distance.alias("distance")).where("distance is not null")
    return ranked.orderBy("distance", "id").limit(limit)


def page(ranked: DataFrame, *, limit: int, offset: int = 0, max_distance: float | None = None) -> DataFrame:
    """One page of a ranking with ``has_more``: a look-ahead row tells; a threshold never refills a page."""
    found = ranked.orderBy("distance", "id").limit(offset + limit + 1).withColumn("place", F.row_number().over(Window.orderBy("distance", "id")))
    found = found.where(F.col("place") > offset)
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    more = F.max("place").over(Window.partitionBy()) > offset + limit
    return found.withColumn("has_more", more).where(F.col("place") <= offset + limit)


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def id_array(ids) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them: whole numbers as such, all others as strings by code point."""
    values = ids.to_pylist() if isinstance(ids, (pa.Array, pa.ChunkedArray)) else list(ids)
    return np.array(values, np.int64) if not values or isinstance(values[0], int) else np.array(values, np.str_)


def unit_rows(vectors: Sequence) -> np.ndarray:
    """Vectors at length one; a zero vector, which has no direction, becomes one of NaN."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, np.nan, norms)


def query_blocks(queries: DataFrame, values: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and unit vectors of ``queries``, read row by row, in blocks of at most ``values`` values (or one row)."""
    ids, rows = [], []
    for row in queries.select("id", "vector").where("id is not null and vector is not null").toLocalIterator():
        if rows and (len(rows) + 1) * len(row.vector) > values:
            yield id_array(ids), unit_rows(rows)
            ids, rows = [], []
        ids.append(row.id)
        rows.append(row.vector)
    if rows:
        yield id_array(ids), unit_rows(rows)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _first(distance: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((own, distance), axis=1)[:, :k]
    return np.take_along_axis(distance, order, 1), np.take_along_axis(own, order, 1)


def _distances(ids: np.ndarray, unit: np.ndarray, own: np.ndarray, block: np.ndarray, exclude_self: bool) -> np.ndarray:
    distance = np.round(1 - unit @ block.T, 12)
    if exclude_self:
        distance[ids[:, None] == own[None, :]] = np.nan
    return np.where(np.isnan(distance), np.inf, distance)


def _listed(ids: np.ndarray, distance: np.ndarray, own: np.ndarray) -> Found:
    kept = np.isfinite(distance)
    return np.broadcast_to(ids[:, None], distance.shape)[kept], own[kept], distance[kept]


def best_of(ids: np.ndarray, unit: np.ndarray, own: np.ndarray, block: np.ndarray, k: int, *, exclude_self: bool) -> Found:
    """Of each query (``ids``, ``unit``) the ``k`` nearest rows (``own``, ``block``), ties by id: query, id, distance."""
    distance = _distances(ids, unit, own, block, exclude_self)
    return _listed(ids, *_first(distance, np.broadcast_to(own, distance.shape), k))


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, *, exclude_self: bool = True, block_values: int = BLOCK_VALUES) -> DataFrame:
    """For each query the ``k`` nearest vectors (query_id, id, distance, rank), ties by id.

    Ids are whole numbers or strings. The queries, however many, go to every task in blocks of ``block_values``
    values; a task compares tiles of its batches by one matrix product and keeps
    its best k a query, and those are merged by a window over at most k rows of
    a query and task. Of more than one block each is a pass over the vectors,
    run at once, whose result is written to the shared folder. The driver holds
    one block at a time. Rows of a null id are not looked at.
    """
    kinds = arrow_kind(queries, "id"), arrow_kind(vectors, "id"), pa.float64()
    found_schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"

    def local(ids: np.ndarray, unit: np.ndarray) -> DataFrame:
        tile = max(1, TILE // len(ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for whole in batches:
                for at in range(0, whole.num_rows, tile):
                    batch = whole.slice(at, tile)
                    own = id_array(batch.column("id"))
                    distance = _distances(ids, unit, own, unit_rows(batch.column("vector").to_pylist()), exclude_self)
                    own = np.broadcast_to(own, distance.shape)
                    if best is not None:
                        distance, own = np.concatenate((best[0], distance), axis=1), np.concatenate((best[1], own), axis=1)
                    best = _first(distance, own, k)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(_listed(ids, *best), kinds, strict=True)], ["query_id", "id", "distance"])

        return vectors.select("id", "vector").where("id is not null and vector is not null").mapInArrow(run, found_schema)

    def merged(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    ship(vectors.sparkSession)
    blocks = query_blocks(queries, block_values)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return merged(vectors.sparkSession.createDataFrame([], found_schema))
    if second is None:
        return merged(local(*first))
    scratch = Scratch(vectors.sparkSession, "ranking")
    for n, block in enumerate(chain((first, second), blocks)):
        merged(local(*block)).drop("rank").write.parquet(scratch.path(f"found/block={n}"))
    return merged(vectors.sparkSession.read.schema(found_schema).option("recursiveFileLookup", "true").parquet(scratch.path("found")))
