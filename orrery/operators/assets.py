"""The catalogue's assets: lookups, listings, edits, and what belongs with an asset, as DataFrames of the rows they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.model import CONTENT_TYPES, EMBEDDING_MODELS, JOB_STATUSES, SOURCES, Narrowing
from orrery.operators import jobs as J

#: Fixed value: the reason of jobs whose asset has lost its files.
FILE_MISSING = "file-missing"
#: Columns that an inserted asset gets when it does not bring them.
DEFAULTS = {"original_filename": "cast(null as string)", "tags": "cast(array() as array<string>)", "meta": "'{}'"}


def inserted(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` with the columns that an asset gets by default; an id comes from the content, so a rerun gives the same."""
    have = set(rows.columns)
    named = rows if "id" in have else rows.withColumn("id", F.substring("sha256", 1, 32))
    named = named if "created_at" in have else named.withColumn("created_at", now)
    for name, default in DEFAULTS.items():
        named = named.withColumn(name, F.coalesce(name, F.expr(default)) if name in have else F.expr(default))
    return named


def violations(assets: DataFrame) -> DataFrame:
    """Rows that break a rule of the table, with the ``rule``; a null breaks every rule but the file name's."""
    rules = {
        "content_type": F.col("content_type").isin(*CONTENT_TYPES),
        "file_ext": F.col("file_ext").isin(*CONTENT_TYPES.values()),
        "source": F.col("source").isin(*SOURCES),
        "width": F.col("width") > 0,
        "height": F.col("height") > 0,
        "size_bytes": F.col("size_bytes") > 0,
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return assets.withColumn("rule", F.explode(broken))


def job_violations(jobs: DataFrame) -> DataFrame:
    good = F.col("status").isin(*JOB_STATUSES) & (F.col("attempts") >= 0)
    return jobs.where(~F.coalesce(good, F.lit(False)))


def vector_violations(vectors: DataFrame, widths: dict[str, int] = EMBEDDING_MODELS) -> DataFrame:
    """Vectors of an unknown model or of another width than their model's."""
    fits = F.lit(False)
    for model, width in widths.items():
        fits = fits | ((F.col("model") == model) & (F.size("vector") == width))
    return vectors.where(~F.coalesce(fits, F.lit(False)))


def by_id(assets: DataFrame, asset_id) -> DataFrame:
    return assets.where(F.col("id") == F.lit(asset_id))


def by_content(assets: DataFrame, sha256: str) -> DataFrame:
    return assets.where(F.col("sha256") == sha256)


def by_ids(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """The assets that ``ids`` (id) names, each once; ids without an asset have none."""
    return assets.join(ids.select("id"), "id", "left_semi")


def existing(ids: DataFrame, assets: DataFrame) -> DataFrame:
    """Those of ``ids`` that have an asset."""
    return ids.join(assets.select("id"), "id", "left_semi")


def stored_files(assets: DataFrame) -> DataFrame:
    return assets.select("id", "file_ext")


def with_status(assets: DataFrame, jobs: DataFrame, model: str, state: str) -> DataFrame:
    """Assets whose newest job of the model is in the state; without a job there is no match."""
    newest = J.latest(jobs.where(F.col("model") == model)).where(F.col("status") == state)
    return assets.join(newest.select(F.col("asset_id").alias("id")), "id", "left_semi")


def listing(
    assets: DataFrame,
    *,
    limit: int,
    offset: int = 0,
    narrowing: Narrowing | None = None,
    source: str | None = None,
    index_status: tuple[str, str] | None = None,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """Assets newest first (ties by the larger id), of which ``limit`` from ``offset`` on, and one that tells whether more follow."""
    if narrowing:
        assets = assets.where(narrowing.condition())
    if source is not None:
        assets = assets.where(F.col("source") == source)
    if index_status is not None:
        assets = with_status(assets, jobs, *index_status)
    return assets.orderBy(F.desc("created_at"), F.desc("id")).limit(offset + limit + 1).offset(offset)


def find(assets: DataFrame, narrowing: Narrowing, limit: int) -> DataFrame:
    """The newest ``limit`` assets that meet the narrowing."""
    return assets.where(narrowing.condition()).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def status_maps(jobs: DataFrame) -> DataFrame:
    """Per asset a map from model to the newest job's status; models, a few, are sorted."""
    pairs = F.array_sort(F.collect_list(F.struct("model", "status")))
    return J.latest(jobs).groupBy("asset_id").agg(F.map_from_entries(pairs).alias("statuses"))


def tag_counts(assets: DataFrame, limit: int) -> DataFrame:
    tags = assets.select(F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def statistics(assets: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One row: assets, their bytes, and the seconds that the oldest open job has waited (null where none is open, never negative)."""
    whole = assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"))
    open_ = jobs.where(F.col("status").isin(*J.OPEN)).agg(F.min("created_at").alias("oldest"))
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))
    return whole.crossJoin(open_).select("assets", "size_bytes", F.when(F.col("oldest").isNotNull(), F.greatest(F.lit(0), waited)).alias("oldest_waiting_seconds"))  # one row each


def patch(assets: DataFrame, edits: DataFrame) -> DataFrame:
    """All assets after ``edits`` (id, tags, gives_tags, meta, gives_meta): what is not given stays, a given null clears."""
    new = edits.select("id", F.col("tags").alias("_tags"), "gives_tags", F.col("meta").alias("_meta"), "gives_meta")
    joined = assets.join(new, "id", "left")
    tags = F.when(F.col("gives_tags"), F.coalesce("_tags", F.array().cast("array<string>"))).otherwise(F.col("tags"))
    meta = C.patched(F.col("meta"), F.col("_meta"), F.coalesce("gives_meta", F.lit(False)))
    return joined.withColumns({"tags": tags, "meta": meta}).select(*assets.columns)


def deleted(ids: DataFrame, assets: DataFrame, vectors: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets, vectors and jobs that are left when the assets of ``ids`` (id) go."""
    gone = ids.select("id")
    of_asset = gone.withColumnRenamed("id", "asset_id")
    return assets.join(gone, "id", "left_anti"), vectors.join(of_asset, "asset_id", "left_anti"), jobs.join(of_asset, "asset_id", "left_anti")


def outcomes(arriving: DataFrame, assets: DataFrame, *order: str) -> DataFrame:
    """What becomes of ``arriving`` (id, sha256): its ``outcome`` and ``asset_id``.

    Content that is stored is a duplicate of its asset; of equal new contents
    the first by ``order`` is created and the others are duplicates of it.
    """
    place = F.struct(*dict.fromkeys((*order, "id")))
    first = arriving.groupBy("sha256").agg(F.min(place).alias("first")).select("sha256", F.col("first.id").alias("first_id"))
    stored = assets.select("sha256", F.col("id").alias("stored_id"))
    joined = arriving.join(first, "sha256").join(stored, "sha256", "left")
    created = F.col("stored_id").isNull() & (F.col("id") == F.col("first_id"))
    return joined.select("id", "sha256", F.when(created, "created").otherwise("duplicate").alias("outcome"), F.coalesce("stored_id", "first_id").alias("asset_id"))


def report(found: DataFrame) -> DataFrame:
    """How many files came to each outcome."""
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


def owner(path: Column) -> Column:
    """The asset that a stored file belongs to by its name; null where the name is none that the store writes."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    stem = F.regexp_extract(name, r"\A([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})(?:\.thumb\.webp|\.[a-z]+)\z", 1)
    return F.when((stem != "") & ~name.endswith(".part"), F.lower(stem))


def disk_differences(files: DataFrame, assets: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Files (path, modified) no younger than ``before`` that no asset owns, and assets that lack their original or their thumbnail.

    Young files are passed over: they may be an import's that is still under way.
    """
    owned = files.withColumn("id", owner(F.col("path")))
    orphans = owned.where(F.col("modified") <= before).join(assets.select("id"), "id", "left_anti").select("path")
    thumb = F.col("path").endswith(".thumb.webp")
    both = owned.where("id is not null").groupBy("id").agg(F.bool_or(thumb).alias("thumbnail"), F.bool_or(~thumb).alias("original")).where("thumbnail and original")
    return orphans, assets.select("id").join(both.select("id"), "id", "left_anti")


def prune(files: DataFrame, assets: DataFrame, jobs: DataFrame, *, before: Column, now: Column, apply: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orphaned files, assets without files, and all jobs: unchanged, or with ``apply`` failed where an asset's files are missing."""
    orphans, missing = disk_differences(files, assets, before)
    return orphans, missing, J.fail_for_assets(jobs, missing, FILE_MISSING, now) if apply else jobs


def corpus(assets: DataFrame, subjects: list[str], companions: list[str], limit: int, *order: str) -> DataFrame:
    """The first ``limit`` assets that show one of ``subjects`` and nothing but subjects and companions."""
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    fits = (F.size("tags") > 0) & F.arrays_overlap("tags", listed(subjects)) & (F.size(F.array_except("tags", listed(subjects + companions))) == 0)
    return assets.where(fits).orderBy(*(order or ("id",))).limit(limit)


def unseen(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Items of the next page that no earlier one has shown."""
    return found.join(shown.select("id"), "id", "left_anti")
