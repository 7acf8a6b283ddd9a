"""The leased work queue: each transition is a DataFrame of the rows it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("pending", "running")
#: With one of these an asset is not queued again.
BLOCKING = (*OPEN, "failed")
#: Fixed value: attempts after which a job has failed for good, unless the caller says otherwise.
MOST_ATTEMPTS = 3


def due(now: Column) -> Column:
    waiting = (F.col("status") == "pending") & (F.col("available_at") <= now)
    return waiting | ((F.col("status") == "running") & (F.col("lease_expires_at") < now))


def state(now: Column) -> Column:
    """waiting, not_yet_due, held, expired, failed or done."""
    pending, running = F.col("status") == "pending", F.col("status") == "running"
    return (
        F.when(pending & (F.col("available_at") <= now), "waiting")
        .when(pending, "not_yet_due")
        .when(running & (F.col("lease_expires_at") >= now), "held")
        .when(running, "expired")
        .otherwise(F.col("status"))
    )


def claim(jobs: DataFrame, *, now: Column, limit: int, lease_seconds: int = 300) -> DataFrame:
    """The first ``limit`` due jobs by availability and id, as they are once claimed: started now, under a lease, one attempt more."""
    taken = jobs.where(due(now)).orderBy("available_at", "id").limit(limit)
    values = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_expires_at": now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))}
    if "started_at" in jobs.columns:
        values["started_at"] = now.cast(jobs.schema["started_at"].dataType)
    return taken.withColumns(values)


def _seconds(length: Column) -> Column:
    return F.make_dt_interval(secs=length.cast("decimal(18,6)"))


def _changed(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    """``jobs`` with new values where a condition holds, in the columns that there are."""
    holds = F.coalesce(where, F.lit(False))
    kind = {f.name: f.dataType for f in jobs.schema.fields}
    return jobs.withColumns({n: F.when(holds, v.cast(kind[n])).otherwise(F.col(n)) for n, v in values.items() if n in kind})


def _held(jobs: DataFrame, tokens: DataFrame) -> tuple[DataFrame, Column]:
    """``jobs`` joined with claims (id, lease_expires_at, ...), and whether the claim still holds the lease."""
    claims = tokens.withColumnRenamed("lease_expires_at", "token")
    return jobs.join(claims, "id", "left"), (F.col("status") == "running") & (F.col("lease_expires_at") == F.col("token"))


def finish(jobs: DataFrame, claims: DataFrame, *, now: Column | None = None) -> DataFrame:
    """All jobs, done where a claim (id, lease_expires_at) still holds the lease; a late one changes nothing."""
    joined, holds = _held(jobs, claims.select("id", "lease_expires_at"))
    none = F.lit(None)
    values = {"last_error": none, "lease_expires_at": none} | ({} if now is None else {"finished_at": now})
    return _changed(joined, holds, status=F.lit("done"), **values).select(*jobs.columns)


def settle(jobs: DataFrame, results: DataFrame, *, now: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """All jobs after ``results`` (id, lease_expires_at, error) of claims that still hold their lease.

    Without an error a job is done. With one it goes back to the queue, due
    after a wait that doubles with each attempt, or has failed for good once
    ``most`` attempts are spent.
    """
    joined, holds = _held(jobs, results.select("id", "lease_expires_at", F.col("error").alias("_error")))
    good, spent = F.col("_error").isNull(), F.col("attempts") >= most
    again = ~good & ~spent
    later = now + _seconds(F.lit(10) * F.pow(F.lit(2), F.greatest("attempts", F.lit(1))))
    changed = _changed(
        joined, holds,
        status=F.when(good, "done").when(spent, "failed").otherwise("pending"),
        available_at=F.when(again, later).otherwise(F.col("available_at")),
        finished_at=F.when(~again, now).otherwise(F.col("finished_at")) if "finished_at" in jobs.columns else now,
        started_at=F.when(~again, F.col("started_at")) if "started_at" in jobs.columns else now,
        last_error=F.col("_error"), lease_expires_at=F.lit(None),
    )
    return changed.select(*jobs.columns)


def reset(jobs: DataFrame, asset_ids: DataFrame, models: list[str] | None = None, *, now: Column) -> DataFrame:
    """All jobs, those of the assets ``asset_ids`` (id) waiting again with a clean slate; ``models`` None means all, an empty list none."""
    joined = jobs.join(asset_ids.select(F.col("id").alias("asset_id"), F.lit(True).alias("_named")).distinct(), "asset_id", "left")
    of_model = F.lit(True) if models is None else F.col("model").isin(*models) if models else F.lit(False)
    none = F.lit(None)
    changed = _changed(joined, F.col("_named") & of_model, status=F.lit("pending"), attempts=F.lit(0), available_at=now, last_error=none, lease_expires_at=none, started_at=none, finished_at=none)
    return changed.select(*jobs.columns)


def fail_for_assets(jobs: DataFrame, asset_ids: DataFrame, reason: str, now: Column) -> DataFrame:
    """All jobs, the open ones of the assets ``asset_ids`` (id) failed with a reason."""
    joined = jobs.join(asset_ids.select(F.col("id").alias("asset_id"), F.lit(True).alias("_named")).distinct(), "asset_id", "left")
    return _changed(joined, F.col("_named") & F.col("status").isin(*OPEN), status=F.lit("failed"), last_error=F.lit(reason), finished_at=now).select(*jobs.columns)


def enqueue(assets: DataFrame, models: list[str], now: Column) -> DataFrame:
    """A waiting job of each model for each asset, in the models' order."""
    named = assets.select(F.col("id").alias("asset_id"), F.explode(F.array(*map(F.lit, models))).alias("model"))
    return _new(named, now)


def _new(named: DataFrame, now: Column) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return named.select(
        F.xxhash64("asset_id", "model", now.cast("string")).alias("id"), "asset_id", "model", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        now.alias("available_at"), none.alias("lease_expires_at"), F.lit(None).cast("string").alias("last_error"),
        now.alias("created_at"), none.alias("started_at"), none.alias("finished_at"),
    )


def selected(ids: DataFrame, vectors: DataFrame, *, model: str, has_one: bool | None = None, answering_for: str | None = None) -> DataFrame:
    """Those of ``ids`` (asset_id and more) that have a vector of ``model`` or lack one, and that ``answering_for`` has one of."""
    of = lambda key: vectors.where(F.col("model") == key).select("asset_id")
    if has_one is not None:
        ids = ids.join(of(model), "asset_id", "left_semi" if has_one else "left_anti")
    return ids if answering_for is None else ids.join(of(answering_for), "asset_id", "left_semi")


def queue(assets: DataFrame, vectors: DataFrame, jobs: DataFrame, *, model: str, has_one: bool, answering_for: str | None = None, now: Column) -> tuple[DataFrame, DataFrame]:
    """New jobs of a model for the selected assets without blocking work, and the assets passed over whose only such work has failed.

    ``has_one`` False fills in what is missing, True rebuilds; with
    ``answering_for`` only assets that the other model answers for.
    """
    chosen = selected(assets.select(F.col("id").alias("asset_id"), "created_at"), vectors, model=model, has_one=has_one, answering_for=answering_for)
    work = lambda states: jobs.where((F.col("model") == model) & F.col("status").isin(*states)).select("asset_id")
    new = chosen.join(work(BLOCKING), "asset_id", "left_anti").select("asset_id", F.lit(model).alias("model"))
    passed = chosen.join(work(OPEN), "asset_id", "left_anti").join(work(("failed",)), "asset_id", "left_semi")
    return _new(new, now), passed.orderBy("created_at", "asset_id").select("asset_id")


def outstanding(jobs: DataFrame, vectors: DataFrame | None = None, *, now: Column, model: str, has_one: bool | None = None, answering_for: str | None = None) -> DataFrame:
    """What a model still owes (state, created_at, id, asset_id): waiting, not_yet_due, held, expired or failed.

    A state's rows, in the order of created_at and id, are its list; rows, so that no list has to fit in a task.
    """
    owed = jobs.where((F.col("model") == model) & F.col("status").isin(*BLOCKING)).select(state(now).alias("state"), "created_at", "id", "asset_id")
    return owed if vectors is None else selected(owed, vectors, model=model, has_one=has_one, answering_for=answering_for)


def work_report(jobs: DataFrame, asset_ids: DataFrame) -> DataFrame:
    """Per asset of ``asset_ids`` (id) whether it is indexed (it has work and all of it is done), else the models queued, held and failed."""
    newest = latest(jobs).join(asset_ids.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    models = lambda status: F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("model"))))  # noqa: E731  a few models
    per = newest.groupBy("asset_id").agg(F.bool_and(F.col("status") == "done").alias("indexed"), models("pending").alias("waiting"), models("running").alias("held"), models("failed").alias("failed"))
    empty = F.array().cast("array<string>")
    return asset_ids.select(F.col("id").alias("asset_id")).join(per, "asset_id", "left").select(
        "asset_id", F.coalesce("indexed", F.lit(False)).alias("indexed"), *[F.coalesce(c, empty).alias(c) for c in ("waiting", "held", "failed")]
    )


def of_asset(jobs: DataFrame, asset_id) -> DataFrame:
    return jobs.where(F.col("asset_id") == F.lit(asset_id)).orderBy("model", F.desc("created_at"), F.desc("id"))


def uncovered(vectors: DataFrame, key: str, by: str) -> DataFrame:
    """Assets that have a vector of ``key`` and none of ``by``; the two are not interchangeable."""
    of = lambda model: vectors.where(F.col("model") == model).select("asset_id")
    return of(key).join(of(by), "asset_id", "left_anti")


def retire(vectors: DataFrame, key: str, by: str) -> DataFrame:
    """All vectors, those of ``key`` left out if and only if ``by`` covers every one of them; condition and deletion are one plan."""
    missing = uncovered(vectors, key, by).agg((F.count("*") > 0).alias("_missing"))  # one row
    return vectors.crossJoin(F.broadcast(missing)).where((F.col("model") != key) | F.col("_missing")).drop("_missing")


def retirement(vectors: DataFrame, jobs: DataFrame, key: str, by: str, now: Column) -> DataFrame:
    """One row that says whether ``key`` may be retired: refused while work of ``by`` is outstanding or an asset is not covered."""
    debt = outstanding(jobs, now=now, model=by).agg(F.count("*").alias("outstanding"))
    gap = uncovered(vectors, key, by).agg(F.count("*").alias("uncovered"))
    held = vectors.where(F.col("model") == key).agg(F.count("*").alias("vectors"))
    verdict = F.when(F.col("outstanding") > 0, "work outstanding").when(F.col("uncovered") > 0, "not covered").when(F.col("vectors") == 0, "nothing to retire").otherwise("retired")
    return debt.crossJoin(gap).crossJoin(held).withColumn("verdict", verdict)  # one row each


def plan(vectors: DataFrame, jobs: DataFrame, *, model: str, answering_for: str | None = None, now: Column) -> DataFrame:
    """What a rebuild, or a replacement of another model, would do (what, n), without doing any of it."""
    compute = uncovered(vectors, answering_for, model) if answering_for else vectors.where(F.col("model") == model)
    owed = outstanding(jobs, vectors, now=now, model=model, has_one=answering_for is None, answering_for=answering_for)
    what = F.when(F.col("state").isin("waiting", "expired"), "drainable").otherwise(F.col("state"))
    live = outstanding(jobs, now=now, model=model).where("state = 'held'").agg(F.lit("held_anywhere").alias("what"), F.count("*").alias("n"))
    return compute.agg(F.lit("to_compute").alias("what"), F.count("*").alias("n")).unionAll(owed.groupBy(what.alias("what")).agg(F.count("*").alias("n"))).unionAll(live)


def latest(jobs: DataFrame) -> DataFrame:
    """The newest job of each asset and model, ties by the larger id; an aggregate, so a hot asset is combined in each task."""
    newest = F.max_by(F.col("status"), F.struct("created_at", "id")).alias("status")
    return jobs.groupBy("asset_id", "model").agg(newest)


def without_vector(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    return assets.join(vectors.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
