"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.model import Narrowing
from orrery.operators import assets as A
from orrery.plans import fixtures as X

BOTH = Narrowing(tags_all=("red", "plate"))
LOT = Narrowing(meta={"lot": "3"})


def _customers(spark, sf):
    return X.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


def tags_both(spark, sf):
    return X.assets(spark, sf).where(BOTH.condition()).select("id")


def meta_lot(spark, sf):
    """The string member matches, the number of the same digits does not."""
    return X.assets(spark, sf).select("id", LOT.condition().alias("matches"))


def asset_by_id(spark, sf):
    return A.by_id(X.assets(spark, sf), 42).select("id", "sha256", "source")


def asset_by_content(spark, sf):
    wanted = X.assets(spark, sf).orderBy("sha256").first().sha256  # one value
    return A.by_content(X.assets(spark, sf), wanted).select("id", "sha256")


def assets_by_ids(spark, sf):
    return A.by_ids(X.assets(spark, sf), _customers(spark, sf)).select("id", "file_ext")


def existing_ids(spark, sf):
    return A.existing(_customers(spark, sf), X.assets(spark, sf).where("source = 'upload'"))


def stored_files(spark, sf):
    return A.stored_files(X.assets(spark, sf))


def listing_page(spark, sf):
    found = A.listing(X.assets(spark, sf), limit=20, offset=5, narrowing=Narrowing(tags_any=("red", "hot")), source="folder", index_status=(X.CLIP, "pending"), jobs=X.jobs(spark, sf))
    return found.select("id", "created_at")


def found_assets(spark, sf):
    return A.find(X.assets(spark, sf), LOT, 15).select("id")


def with_status(spark, sf):
    return A.with_status(X.assets(spark, sf), X.jobs(spark, sf), X.DINO, "failed").select("id")


def statistics(spark, sf):
    return A.statistics(X.assets(spark, sf), X.jobs(spark, sf), X.now())


def status_pairs(spark, sf):
    """The map of each asset, read back by its keys."""
    return A.status_maps(X.jobs(spark, sf)).select("asset_id", F.element_at("statuses", X.CLIP).alias("clip"), F.element_at("statuses", X.DINO).alias("dino"))


def violations(spark, sf):
    return A.violations(X.assets(spark, sf)).select("id", "rule")


def job_violations(spark, sf):
    return A.job_violations(X.jobs(spark, sf).withColumn("attempts", F.col("attempts") - 1)).select("id")


def vector_violations(spark, sf):
    return A.vector_violations(X.vectors(spark, sf), {X.CLIP: 64, X.DINO: 32}).select("asset_id", "model")


def _edits(spark, sf):
    a = X.assets(spark, sf).where("width > 20")
    return a.select("id", F.when(F.col("height") > 30, F.array(F.lit("new"))).alias("tags"), (F.col("height") > 25).alias("gives_tags"), F.lit(None).cast("string").alias("meta"), (F.col("source") == "folder").alias("gives_meta"))


def patched(spark, sf):
    return A.patch(X.assets(spark, sf), _edits(spark, sf)).select("id", F.concat_ws(" ", "tags").alias("tags"), "meta")


def cascade(spark, sf):
    """Rows left in each table when the assets with a clip-only vector go."""
    a, v, j = X.assets(spark, sf), X.vectors(spark, sf), X.jobs(spark, sf)
    left = A.deleted(a.where("source = 'folder'").select("id"), a, v, j)
    n = lambda df, name: df.agg(F.lit(name).alias("kept_in"), F.count("*").alias("n"))
    return n(left[0], "assets").unionAll(n(left[1], "vectors")).unionAll(n(left[2], "jobs"))


def new_content(spark, sf):
    """Parts that arrive, of which the dearer ones are stored."""
    a = X.assets(spark, sf)
    return A.outcomes(a.select("id", "sha256"), a.where("height > 45").groupBy("sha256").agg(F.min("id").alias("id")), "id").select("id", "outcome", "asset_id")


def arrival_report(spark, sf):
    a = X.assets(spark, sf)
    return A.report(A.outcomes(a.select("id", "sha256"), a.where("height > 45").groupBy("sha256").agg(F.min("id").alias("id")), "id"))


def _stored(spark, sf):
    """Assets of uuid names, and the files a disk holds of some of them."""
    name = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    a = X.assets(spark, sf).withColumn("id", name)
    file = lambda rows, end: rows.select(F.concat(F.lit("/m/00/"), "id", end).alias("path"), F.col("created_at").alias("modified"))
    files = file(a.where("height > 5"), F.concat(F.lit("."), "file_ext")).unionAll(file(a.where("height > 10"), F.lit(".thumb.webp"))).unionAll(file(a.where("height > 48"), F.lit(".aa.part")))
    return a, files


def orphaned_files(spark, sf):
    a, files = _stored(spark, sf)
    return A.disk_differences(files, a.where("source = 'upload'"), F.expr("TIMESTAMP '2020-01-01 10:00:00'"))[0]


def missing_files(spark, sf):
    a, files = _stored(spark, sf)
    return A.disk_differences(files, a, X.now())[1]


def pruned(spark, sf):
    """Jobs by status once the assets without files have had theirs failed."""
    a, files = _stored(spark, sf)
    jobs = X.jobs(spark, sf).withColumn("asset_id", F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("asset_id").cast("string"), 12, "0")))
    left = A.prune(files, a, jobs, before=X.now(), now=X.now(), apply=True)[2]
    return left.groupBy("status", "last_error").agg(F.count("*").alias("n"))


def chosen_corpus(spark, sf):
    return A.corpus(X.assets(spark, sf), ["plate", "ring"], ["red", "hot", "small", "large", "promo"], 80, "created_at", "id").select("id")


def unseen(spark, sf):
    a = X.assets(spark, sf)
    return A.unseen(a.where(F.col("source") == "folder").select("id"), a.where("height < 30").select("id"))


def asset_links(spark, sf):
    return X.assets(spark, sf).select("id", C.links(F.col("id"), "/assets")["thumbnail"].alias("thumbnail"))


QUERIES = {
    f.__name__: f
    for f in (
        tags_both, meta_lot, asset_by_id, asset_by_content, assets_by_ids, existing_ids, stored_files, listing_page, found_assets, with_status, statistics, status_pairs,
        violations, job_violations, vector_violations, patched, cascade, new_content, arrival_report, orphaned_files, missing_files, pruned, chosen_corpus, unseen, asset_links,
    )
}

_LOT = """coalesce(json_extract(meta, '$.lot')::VARCHAR = '"3"', false)"""
_STORE = f"(SELECT sha256, min(id) AS id FROM {X.ASSETS} WHERE height > 45 GROUP BY 1)"
_NAME = "'00000000-0000-0000-0000-' || lpad({}::VARCHAR, 12, '0')".format
_OUTCOMES = f"""(SELECT a.id, CASE WHEN s.id IS NULL AND a.id = min(a.id) OVER (PARTITION BY a.sha256) THEN 'created' ELSE 'duplicate' END AS outcome,
    coalesce(s.id, min(a.id) OVER (PARTITION BY a.sha256)) AS asset_id FROM {X.ASSETS} a LEFT JOIN {_STORE} s ON s.sha256 = a.sha256)"""

ORACLE_SQL = {
    "tags_both": f"SELECT id FROM {X.ASSETS} WHERE list_has_all(tags, ['red', 'plate'])",
    "meta_lot": f"SELECT id, {_LOT} AS matches FROM {X.ASSETS}",
    "asset_by_id": f"SELECT id, sha256, source FROM {X.ASSETS} WHERE id = 42",
    "asset_by_content": f"SELECT id, sha256 FROM {X.ASSETS} WHERE sha256 = (SELECT min(sha256) FROM {X.ASSETS})",
    "assets_by_ids": f"SELECT id, file_ext FROM {X.ASSETS} WHERE id IN (SELECT c_custkey FROM customer)",
    "existing_ids": f"SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT id FROM {X.ASSETS} WHERE source = 'upload')",
    "stored_files": f"SELECT id, file_ext FROM {X.ASSETS}",
    "listing_page": f"""SELECT id, created_at FROM {X.ASSETS} WHERE list_has_any(tags, ['red', 'hot']) AND source = 'folder'
        AND id IN (SELECT asset_id FROM {X.LATEST} WHERE model = '{X.CLIP}' AND status = 'pending') ORDER BY created_at DESC, id DESC LIMIT 21 OFFSET 5""",
    "found_assets": f"SELECT id FROM {X.ASSETS} WHERE {_LOT} ORDER BY created_at DESC, id DESC LIMIT 15",
    "with_status": f"SELECT id FROM {X.ASSETS} WHERE id IN (SELECT asset_id FROM {X.LATEST} WHERE model = '{X.DINO}' AND status = 'failed')",
    "statistics": f"""SELECT (SELECT count(*) FROM {X.ASSETS}) AS assets, (SELECT sum(size_bytes)::BIGINT FROM {X.ASSETS}) AS size_bytes,
        greatest(0, date_diff('second', min(created_at), {X.NOW})) AS oldest_waiting_seconds FROM {X.JOBS} WHERE status IN ('pending', 'running')""",
    "status_pairs": f"SELECT asset_id, max(status) FILTER (model = '{X.CLIP}') AS clip, max(status) FILTER (model = '{X.DINO}') AS dino FROM {X.LATEST} GROUP BY 1",
    "violations": f"SELECT id, 'content_type' AS rule FROM {X.ASSETS} WHERE content_type = 'image/gif' UNION ALL SELECT id, 'width' FROM {X.ASSETS} WHERE width <= 0 UNION ALL SELECT id, 'height' FROM {X.ASSETS} WHERE height <= 0 UNION ALL SELECT id, 'size_bytes' FROM {X.ASSETS} WHERE size_bytes <= 0",
    "job_violations": f"SELECT id FROM {X.JOBS} WHERE attempts - 1 < 0",
    "vector_violations": f"SELECT asset_id, model FROM {X.VECTORS} WHERE model = '{X.DINO}'",
    "patched": f"""SELECT id, CASE WHEN width > 20 AND height > 25 THEN CASE WHEN height > 30 THEN 'new' ELSE '' END ELSE own END AS tags,
        CASE WHEN width > 20 AND source = 'folder' THEN '{{}}' ELSE meta END AS meta
        FROM (SELECT a.* EXCLUDE (tags), CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN p_name ELSE p_name || ' ' || lower(p_type) END AS own
        FROM {X.ASSETS} a JOIN part ON part.p_partkey = a.id)""",
    "cascade": f"""SELECT 'assets' AS kept_in, count(*) AS n FROM {X.ASSETS} WHERE source <> 'folder'
        UNION ALL SELECT 'vectors', count(*) FROM {X.VECTORS} WHERE asset_id NOT IN (SELECT id FROM {X.ASSETS} WHERE source = 'folder')
        UNION ALL SELECT 'jobs', count(*) FROM {X.JOBS} WHERE asset_id NOT IN (SELECT id FROM {X.ASSETS} WHERE source = 'folder')""",
    "new_content": f"SELECT id, outcome, asset_id FROM {_OUTCOMES}",
    "arrival_report": f"SELECT outcome, count(*) AS n FROM {_OUTCOMES} GROUP BY 1",
    "orphaned_files": f"""SELECT '/m/00/' || {_NAME('id')} || e AS path FROM {X.ASSETS}, (VALUES ('.x', 5), ('.thumb.webp', 10), ('.aa.part', 48)) f(e0, least),
        LATERAL (SELECT CASE WHEN e0 = '.x' THEN '.' || file_ext ELSE e0 END AS e)
        WHERE height > least AND created_at <= TIMESTAMP '2020-01-01 10:00:00' AND (source <> 'upload' OR e0 = '.aa.part')""",
    "missing_files": f"SELECT {_NAME('id')} AS id FROM {X.ASSETS} WHERE height <= 10",
    "pruned": f"""SELECT CASE WHEN gone THEN 'failed' ELSE status END AS status, CASE WHEN gone THEN 'file-missing' END AS last_error, count(*) AS n
        FROM (SELECT status, status IN ('pending', 'running') AND asset_id IN (SELECT id FROM {X.ASSETS} WHERE height <= 10) AS gone FROM {X.JOBS}) GROUP BY 1, 2""",
    "chosen_corpus": f"""SELECT id FROM {X.ASSETS} WHERE list_has_any(tags, ['plate', 'ring']) AND list_has_all(['plate', 'ring', 'red', 'hot', 'small', 'large', 'promo'], tags)
        ORDER BY created_at, id LIMIT 80""",
    "unseen": f"SELECT id FROM {X.ASSETS} WHERE source = 'folder' AND height >= 30",
    "asset_links": f"SELECT id, '/assets/' || id || '/thumbnail' AS thumbnail FROM {X.ASSETS}",
}
