"""Search as the catalogue answers it: a narrowed ranking over two tables, its page, and a budgeted scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.model import Narrowing, check_depth, cut_short, rows_needed
from orrery.operators import assets as A
from orrery.operators import ranking as R
from orrery.operators.index import ListIndex, list_counts, probe_steps  # noqa: F401  the index is part of search


@dataclass(frozen=True)
class Page:
    """A page's rows in order (rank, id, score, the asset's columns, statuses), and what is known of the ranking beyond it."""

    items: DataFrame
    has_more: bool
    scan_limited: bool


def of_model(vectors: DataFrame, model: str) -> DataFrame:
    """One model's vectors; a partition filter where the table is partitioned by model."""
    return vectors.where(F.col("model") == model)


def vector_of(vectors: DataFrame, asset_id, model: str) -> DataFrame:
    return of_model(vectors, model).where(F.col("asset_id") == F.lit(asset_id))


def store_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write vectors with one folder per model, and read them back."""
    vectors.write.partitionBy("model").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def nearest(vectors: DataFrame, assets: DataFrame, query: Sequence[float], limit: int, *, model: str, narrowing: Narrowing | None = None, exclude=None) -> DataFrame:
    """The ``limit`` assets nearest to ``query`` (id, distance), ties by id; a narrowing is met before the cut.

    Only a narrowed ranking looks at the assets: its condition is part of the
    join below the cut, so a rare match is found however far it lies.
    """
    own = of_model(vectors, model).select(F.col("asset_id").alias("id"), "vector")
    if narrowing:
        own = own.join(assets.where(narrowing.condition()).select("id"), "id", "left_semi")
    return R.nearest(own, list(query), limit, exclude=exclude)


def reachable(vectors: DataFrame, assets: DataFrame, *, model: str, narrowing: Narrowing | None, at_most: int, exclude=None) -> DataFrame:
    """How many vectors a search could reach, counted no further than ``at_most``."""
    own = of_model(vectors, model).select(F.col("asset_id").alias("id"))
    if exclude is not None:
        own = own.where(F.col("id") != F.lit(exclude))
    if narrowing:
        own = own.join(assets.where(narrowing.condition()).select("id"), "id", "left_semi")
    return own.limit(at_most).agg(F.count("*").alias("n"))


def enriched(page: DataFrame, assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """A page (id, distance, place) with its assets and their statuses, in its order; an asset that has vanished is left out.

    A page has at most a thousand rows by :func:`orrery.model.check_depth`, so it is broadcast.
    """
    small = F.broadcast(page.select("id", "place", C.score(F.col("distance")).alias("score")))
    found = assets.join(small, "id")
    own = jobs.join(F.broadcast(page.select(F.col("id").alias("asset_id"))), "asset_id", "left_semi")
    statuses = A.status_maps(own).withColumnRenamed("asset_id", "id")
    return found.join(statuses, "id", "left").orderBy("place")


def page(
    vectors: DataFrame,
    assets: DataFrame,
    jobs: DataFrame,
    query: Sequence[float],
    *,
    model: str,
    limit: int,
    offset: int = 0,
    min_score: float | None = None,
    narrowing: Narrowing | None = None,
    exclude=None,
    budget: int | None = None,
    index: ListIndex | None = None,
) -> Page:
    """One page of the ranking around ``query``.

    A threshold shortens a page and never refills it. With a ``budget`` a
    narrowed scan gives up after so many vectors, and ``scan_limited`` tells
    that more would match; without one the scan is exact and it is false. With
    an ``index`` of the model's vectors the budget is what its walk may read;
    without one all vectors are ranked and the budget is where the ranking is cut. The candidates, at most a thousand numbers, are read
    by the driver; two jobs, one more where a budgeted scan ran short.
    """
    check_depth(limit, offset, int(exclude is not None))
    needed = rows_needed(limit, offset)
    if budget is not None and index is not None:
        narrowed = assets.where(narrowing.condition()).select("id") if narrowing else None
        candidates = index.walk(query, needed, budget=budget, narrowed=narrowed, exclude=exclude).found
    elif budget is not None:
        candidates = [(r.id, r.distance) for r in budgeted(vectors, assets, query, needed, model=model, narrowing=narrowing, budget=budget, exclude=exclude).collect()]
    else:
        candidates = [(r.id, r.distance) for r in nearest(vectors, assets, query, needed, model=model, narrowing=narrowing, exclude=exclude).collect()]
    window = candidates[offset : offset + limit + 1]
    if min_score is not None:
        window = [c for c in window if c[1] <= 1 - min_score]
    scan_limited = False
    if narrowing and len(candidates) < needed and budget is not None:
        matching = reachable(vectors, assets, model=model, narrowing=narrowing, at_most=len(candidates) + 1, exclude=exclude).first().n
        scan_limited = cut_short(len(candidates), needed, matching)
    kind = vectors.schema["asset_id"].dataType.simpleString()
    rows = vectors.sparkSession.createDataFrame([(i, d, n) for n, (i, d) in enumerate(window[:limit])], f"id {kind}, distance double, place int")
    return Page(enriched(rows, assets, jobs), len(window) > limit, scan_limited)


def envelope(found: Page, *, limit: int, offset: int, model: str, encoder: str | None = None, truncated: bool = False, prefix: str = "/assets") -> DataFrame:
    """A page as one row of JSON: its items with links, and what the request asked for."""
    item = F.struct(F.struct("id", "source", "tags", "meta", F.col("statuses").alias("index_status"), C.links(F.col("id"), prefix).alias("links")).alias("asset"), "score")
    by_place = lambda a, b: a["place"] - b["place"]
    items = found.items.agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item"))), by_place).alias("rows"))  # one page
    said = {"limit": limit, "offset": offset, "has_more": found.has_more, "model": model, "encoder": encoder, "query_truncated": truncated, "scan_limited": found.scan_limited}
    columns = [F.lit(v).cast("string" if k == "encoder" else "int" if k in ("limit", "offset") else "string" if k == "model" else "boolean").alias(k) for k, v in said.items()]
    whole = F.struct(F.transform("rows", lambda r: r["item"]).alias("items"), *columns)
    return items.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("page"))


def budgeted(vectors: DataFrame, assets: DataFrame, query: Sequence[float], limit: int, *, model: str, narrowing: Narrowing | None, budget: int, exclude=None) -> DataFrame:
    """The first ``limit`` that meet the narrowing among the ``budget`` nearest vectors, in strict order of distance."""
    own = of_model(vectors, model).select(F.col("asset_id").alias("id"), "vector")
    reached = R.nearest(own, list(query), budget, exclude=exclude)
    if narrowing:
        reached = reached.join(assets.where(narrowing.condition()).select("id"), "id", "left_semi")
    return reached.orderBy("distance", "id").limit(limit)


def post_filtered(vectors: DataFrame, assets: DataFrame, query: Sequence[float], limit: int, *, model: str, narrowing: Narrowing | None, effort: int) -> DataFrame:
    """What a search finds that narrows its ``effort`` candidates afterwards: short pages, kept to measure the defect."""
    return budgeted(vectors, assets, query, limit, model=model, narrowing=narrowing, budget=effort)


def plan_of(ranked: DataFrame) -> str:
    """``exact`` where the narrowing is met below the cut, ``post-filter`` where above it; read from the plan."""
    lines = ranked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    cut = [i for i, line in enumerate(lines) if "Limit" in line]
    return "exact" if not semi or all(c < semi[0] for c in cut) else "post-filter"


# --- what an index read ---


def lists_read(ranked: DataFrame) -> str | None:
    """The partition filter of a ranking's scan; None where it read the whole table, so that a measure cannot be taken of it by mistake."""
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    at = plan.find("PartitionFilters: [")
    inside = plan[at + 19 : plan.find("]", at)] if at >= 0 else ""
    return inside or None


def guard_exact(ranked: DataFrame) -> DataFrame:
    """``ranked``, refused as a truth where it comes from an index."""
    if lists_read(ranked) and "list" in lists_read(ranked):
        raise ValueError("the truth must not come from an index")
    return ranked
