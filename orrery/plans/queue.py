"""Queries of the work queue, coverage and retirement."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import jobs as J
from orrery.operators import search as S
from orrery.plans import fixtures as X

#: The columns that tell a job's state.
STATE = ("id", "status", "attempts", "available_at", "lease_expires_at", "last_error", "finished_at")


def _brief(jobs):
    return jobs.groupBy("status", "attempts", "last_error", F.col("lease_expires_at").isNull().alias("no_lease"), F.col("finished_at").isNull().alias("unfinished")).agg(F.count("*").alias("n"))


def lease_states(spark, sf):
    return X.jobs(spark, sf).groupBy(J.state(X.now()).alias("state")).agg(F.count("*").alias("n"))


def claimed(spark, sf):
    return J.claim(X.jobs(spark, sf), now=X.now(), limit=25, lease_seconds=90).select("id", "status", "attempts", "lease_expires_at")


def claim_times(spark, sf):
    """When claimed jobs were started, and under which lease."""
    return J.claim(X.jobs(spark, sf), now=X.now(), limit=60, lease_seconds=90).select("id", "started_at", "lease_expires_at")


def _results(spark, sf):
    """Results of all running jobs; half of the claims have lost their lease, and dear ones went wrong."""
    jobs = X.jobs(spark, sf).where("status = 'running'")
    late = F.when(F.col("asset_id") > 700, F.col("lease_expires_at")).otherwise(F.col("available_at"))
    return jobs.select("id", late.alias("lease_expires_at"), F.when(F.col("attempts") > 0, F.lit("broken")).alias("error"))


def finished(spark, sf):
    jobs = X.jobs(spark, sf)
    return _brief(J.finish(jobs, _results(spark, sf), now=X.now()))


def settled(spark, sf):
    return _brief(J.settle(X.jobs(spark, sf), _results(spark, sf), now=X.now()))


def retried(spark, sf):
    """When jobs that went wrong are due again."""
    left = J.settle(X.jobs(spark, sf), _results(spark, sf), now=X.now())
    return left.where("last_error = 'broken' AND status = 'pending'").select("id", F.timestamp_diff("SECOND", X.now(), F.col("available_at")).cast("long").alias("wait"))


def _some(spark, sf):
    return X.assets(spark, sf).where("source = 'folder'").select("id")


def reset(spark, sf):
    return _brief(J.reset(X.jobs(spark, sf), _some(spark, sf), [X.CLIP], now=X.now()))


def reset_none(spark, sf):
    return _brief(J.reset(X.jobs(spark, sf), _some(spark, sf), [], now=X.now()))


def failed_for_assets(spark, sf):
    return _brief(J.fail_for_assets(X.jobs(spark, sf), _some(spark, sf), "gone", X.now()))


def enqueued(spark, sf):
    return J.enqueue(_some(spark, sf), [X.CLIP, X.DINO], X.now()).select("asset_id", "model", "status", "attempts", "available_at")


def _queue(spark, sf, **how):
    return J.queue(X.assets(spark, sf), X.vectors(spark, sf), X.jobs(spark, sf).where("attempts < 3"), now=X.now(), **how)


def queued_missing(spark, sf):
    return _queue(spark, sf, model=X.DINO, has_one=False)[0].select("asset_id", "model", "status")


def queued_rebuild(spark, sf):
    return _queue(spark, sf, model=X.DINO, has_one=True)[0].select("asset_id", "model", "status")


def queued_replacing(spark, sf):
    return _queue(spark, sf, model=X.DINO, has_one=False, answering_for=X.CLIP)[0].select("asset_id", "model", "status")


def passed_over(spark, sf):
    return _queue(spark, sf, model=X.CLIP, has_one=False)[1]


def outstanding(spark, sf):
    return J.outstanding(X.jobs(spark, sf), X.vectors(spark, sf), now=X.now(), model=X.DINO, has_one=False, answering_for=X.CLIP).select("state", "id", "asset_id")


def work_report(spark, sf):
    flat = lambda c: F.array_join(c, ",").alias(c)
    return J.work_report(X.jobs(spark, sf), X.assets(spark, sf).select("id")).select("asset_id", "indexed", flat("waiting"), flat("held"), flat("failed"))


def jobs_of_asset(spark, sf):
    place = F.row_number().over(S.Window.orderBy("model", F.desc("created_at"), F.desc("id")))
    return J.of_asset(X.jobs(spark, sf), 330).withColumn("place", place).select("place", "id", "model")


def vector_count(spark, sf):
    return S.of_model(X.vectors(spark, sf), X.DINO).agg(F.count("*").alias("n"))


def uncovered(spark, sf):
    return J.uncovered(X.vectors(spark, sf), X.CLIP, X.DINO)


def retired(spark, sf):
    """The covered model goes, the one that is not covered stays."""
    v = X.vectors(spark, sf)
    left = lambda df, name: df.groupBy("model").agg(F.count("*").alias("n")).withColumn("retired", F.lit(name))
    return left(J.retire(v, X.DINO, X.CLIP), X.DINO).unionAll(left(J.retire(v, X.CLIP, X.DINO), X.CLIP))


def retirement(spark, sf):
    return J.retirement(X.vectors(spark, sf), X.jobs(spark, sf).where("status = 'done'"), X.CLIP, X.DINO, X.now())


def retirement_verdicts(spark, sf):
    """Each of the four verdicts: by all jobs, by those that are done, of a covered model, of a model without vectors."""
    vectors, all_ = X.vectors(spark, sf), X.jobs(spark, sf)
    done, out = all_.where("status = 'done'"), None
    for jobs, key, by in ((all_, X.CLIP, X.DINO), (done, X.CLIP, X.DINO), (done, X.DINO, X.CLIP), (done, "retired-before", X.CLIP)):
        row = J.retirement(vectors, jobs, key, by, X.now()).withColumn("model", F.lit(key))
        out = row if out is None else out.unionAll(row)
    return out


def rebuild_plan(spark, sf):
    return J.plan(X.vectors(spark, sf), X.jobs(spark, sf), model=X.DINO, answering_for=X.CLIP, now=X.now())


QUERIES = {
    f.__name__: f
    for f in (
        lease_states, claimed, finished, settled, retried, reset, reset_none, failed_for_assets, enqueued, queued_missing, queued_rebuild, queued_replacing, passed_over,
        outstanding, work_report, jobs_of_asset, vector_count, uncovered, retired, retirement, retirement_verdicts, rebuild_plan, claim_times,
    )
}

_N = X.NOW
_BRIEF = "SELECT status, attempts::INTEGER AS attempts, last_error, lease_expires_at IS NULL AS no_lease, finished_at IS NULL AS unfinished, count(*) AS n FROM ({}) GROUP BY ALL".format
_HOLDS = "status = 'running' AND asset_id > 700"
_BROKEN = "attempts > 0"
_SOME = f"asset_id IN (SELECT id FROM {X.ASSETS} WHERE source = 'folder')"
_STATE = f"""CASE WHEN status = 'pending' AND available_at <= {_N} THEN 'waiting' WHEN status = 'pending' THEN 'not_yet_due'
    WHEN status = 'running' AND lease_expires_at >= {_N} THEN 'held' WHEN status = 'running' THEN 'expired' ELSE status END"""
_FEW = f"(SELECT * FROM {X.JOBS} WHERE attempts < 3)"


def _has(model: str, column: str = "id") -> str:
    return f"{column} IN (SELECT asset_id FROM {X.VECTORS} WHERE model = '{model}')"


def _queued(model: str, where: str) -> str:
    work = f"SELECT asset_id FROM {_FEW} WHERE model = '{model}' AND status IN ('pending', 'running', 'failed')"
    return f"SELECT id AS asset_id, '{model}' AS model, 'pending' AS status FROM {X.ASSETS} WHERE {where} AND id NOT IN ({work})"


_OWED = f"(SELECT {_STATE} AS state, id, asset_id FROM {X.JOBS} WHERE model = '{X.DINO}' AND status IN ('pending', 'running', 'failed') AND NOT {_has(X.DINO, 'asset_id')} AND {_has(X.CLIP, 'asset_id')})"

def _verdict(jobs: str, key: str, by: str) -> str:
    return f"""SELECT '{key}' AS model, outstanding, uncovered, vectors, CASE WHEN outstanding > 0 THEN 'work outstanding' WHEN uncovered > 0 THEN 'not covered'
            WHEN vectors = 0 THEN 'nothing to retire' ELSE 'retired' END AS verdict
        FROM (SELECT (SELECT count(*) FROM {X.JOBS} WHERE model = '{by}' AND status IN ('pending', 'running', 'failed') AND {jobs}) AS outstanding,
                     (SELECT count(*) FROM {X.VECTORS} WHERE model = '{key}' AND asset_id NOT IN (SELECT asset_id FROM {X.VECTORS} WHERE model = '{by}')) AS uncovered,
                     (SELECT count(*) FROM {X.VECTORS} WHERE model = '{key}') AS vectors)"""


ORACLE_SQL = {
    "retirement_verdicts": " UNION ALL ".join(
        _verdict(*case) for case in (("true", X.CLIP, X.DINO), ("status = 'done'", X.CLIP, X.DINO), ("status = 'done'", X.DINO, X.CLIP), ("status = 'done'", "retired-before", X.CLIP))
    ),
    "claim_times": f"""SELECT id, {_N} AS started_at, {_N} + INTERVAL 90 SECOND AS lease_expires_at FROM {X.JOBS}
        WHERE (status = 'pending' AND available_at <= {_N}) OR (status = 'running' AND lease_expires_at < {_N}) ORDER BY available_at, id LIMIT 60""",
    "lease_states": f"SELECT {_STATE} AS state, count(*) AS n FROM {X.JOBS} GROUP BY 1",
    "claimed": f"""SELECT id, 'running' AS status, (attempts + 1)::INTEGER AS attempts, {_N} + INTERVAL 90 SECOND AS lease_expires_at FROM {X.JOBS}
        WHERE (status = 'pending' AND available_at <= {_N}) OR (status = 'running' AND lease_expires_at < {_N}) ORDER BY available_at, id LIMIT 25""",
    "finished": _BRIEF(f"""SELECT CASE WHEN {_HOLDS} THEN 'done' ELSE status END AS status, attempts, last_error, CASE WHEN {_HOLDS} THEN NULL ELSE lease_expires_at END AS lease_expires_at,
        CASE WHEN {_HOLDS} THEN {_N} END AS finished_at FROM {X.JOBS}"""),
    "settled": _BRIEF(f"""SELECT CASE WHEN {_HOLDS} THEN CASE WHEN NOT {_BROKEN} THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, attempts,
        CASE WHEN {_HOLDS} AND {_BROKEN} THEN 'broken' END AS last_error, CASE WHEN {_HOLDS} THEN NULL ELSE lease_expires_at END AS lease_expires_at,
        CASE WHEN {_HOLDS} AND (NOT {_BROKEN} OR attempts >= 3) THEN {_N} END AS finished_at FROM {X.JOBS}"""),
    "retried": f"SELECT id, (10 * pow(2, attempts))::BIGINT AS wait FROM {X.JOBS} WHERE {_HOLDS} AND {_BROKEN} AND attempts < 3",
    "reset": _BRIEF(f"""SELECT CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE attempts END AS attempts, last_error,
        CASE WHEN hit THEN NULL ELSE lease_expires_at END AS lease_expires_at, finished_at FROM (SELECT *, {_SOME} AND model = '{X.CLIP}' AS hit FROM {X.JOBS})"""),
    "reset_none": _BRIEF(f"SELECT * FROM {X.JOBS}"),
    "failed_for_assets": _BRIEF(f"""SELECT CASE WHEN hit THEN 'failed' ELSE status END AS status, attempts, CASE WHEN hit THEN 'gone' END AS last_error, lease_expires_at,
        CASE WHEN hit THEN {_N} END AS finished_at FROM (SELECT *, {_SOME} AND status IN ('pending', 'running') AS hit FROM {X.JOBS})"""),
    "enqueued": f"SELECT id AS asset_id, m AS model, 'pending' AS status, 0 AS attempts, {_N} AS available_at FROM {X.ASSETS}, (VALUES ('{X.CLIP}'), ('{X.DINO}')) t(m) WHERE source = 'folder'",
    "queued_missing": _queued(X.DINO, f"NOT {_has(X.DINO)}"),
    "queued_rebuild": _queued(X.DINO, _has(X.DINO)),
    "queued_replacing": _queued(X.DINO, f"NOT {_has(X.DINO)} AND {_has(X.CLIP)}"),
    "passed_over": f"""SELECT id AS asset_id FROM {X.ASSETS} WHERE NOT {_has(X.CLIP)} AND id NOT IN (SELECT asset_id FROM {_FEW} WHERE model = '{X.CLIP}' AND status IN ('pending', 'running'))
        AND id IN (SELECT asset_id FROM {_FEW} WHERE model = '{X.CLIP}' AND status = 'failed')""",
    "outstanding": f"SELECT state, id, asset_id FROM {_OWED}",
    "work_report": f"""SELECT a.id AS asset_id, coalesce(bool_and(status = 'done'), false) AS indexed,
        coalesce(string_agg(model, ',' ORDER BY model) FILTER (status = 'pending'), '') AS waiting, coalesce(string_agg(model, ',' ORDER BY model) FILTER (status = 'running'), '') AS held,
        coalesce(string_agg(model, ',' ORDER BY model) FILTER (status = 'failed'), '') AS failed FROM {X.ASSETS} a LEFT JOIN {X.LATEST} l ON l.asset_id = a.id GROUP BY 1""",
    "jobs_of_asset": f"SELECT row_number() OVER (ORDER BY model, created_at DESC, id DESC)::INTEGER AS place, id, model FROM {X.JOBS} WHERE asset_id = 330",
    "vector_count": f"SELECT count(*) AS n FROM {X.VECTORS} WHERE model = '{X.DINO}'",
    "uncovered": f"SELECT asset_id FROM {X.VECTORS} WHERE model = '{X.CLIP}' AND NOT {_has(X.DINO, 'asset_id')}",
    "retired": f"""SELECT model, count(*) AS n, '{X.DINO}' AS retired FROM {X.VECTORS} WHERE model = '{X.CLIP}' GROUP BY 1
        UNION ALL SELECT model, count(*), '{X.CLIP}' FROM {X.VECTORS} GROUP BY 1""",
    "retirement": f"""SELECT 0::BIGINT AS outstanding, (SELECT count(*) FROM embeddings WHERE label <= 3) AS uncovered, (SELECT count(*) FROM embeddings) AS vectors, 'not covered' AS verdict""",
    "rebuild_plan": f"""SELECT 'to_compute' AS what, count(*) AS n FROM embeddings WHERE label <= 3
        UNION ALL SELECT CASE WHEN state IN ('waiting', 'expired') THEN 'drainable' ELSE state END, count(*) FROM {_OWED} GROUP BY 1
        UNION ALL SELECT 'held_anywhere', count(*) FROM {X.JOBS} WHERE model = '{X.DINO}' AND status = 'running' AND lease_expires_at >= {_N}""",
}
