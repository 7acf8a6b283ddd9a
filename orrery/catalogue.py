"""The catalogue's queries over the test tables, with the SQL they must agree with.

Vectors are ``embeddings``; parts are assets whose tags are the words of their
type; orders are jobs of their customers; event props are metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import jobs as J
from orrery.operators import ranking as R

NOW = "TIMESTAMP '1996-01-01 00:00:00'"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark, sf):
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(spark, sf) -> list[float]:
    return _vectors(spark, sf).where("id = 0").first().vector  # one vector


def _assets(spark, sf):
    tags = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"), F.col("p_size").cast("long").alias("size_bytes"), "p_name")


def _jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("model"), status.alias("status"),
        F.lit(0).alias("attempts"), F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("lease_expires_at"), F.col("o_orderdate").alias("created_at"),
    )


_RANKED = """SELECT e.vec_id AS id, e.label, 1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
    (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS d
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""
_ASSETS = "(SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS tags, p_size AS size_bytes FROM part)"
_JOBS = """(SELECT o_orderkey AS id, o_custkey AS asset_id, o_orderpriority AS model, o_orderdate AS available_at, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END AS status FROM orders)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 9))


def top_k(spark, sf):
    return _rounded(R.nearest(_vectors(spark, sf), _query(spark, sf), 21, exclude=0))


def narrowed_top_k(spark, sf):
    return _rounded(R.nearest(_vectors(spark, sf), _query(spark, sf), 21, narrowing=F.col("label").isin(1, 3)))


def ranked_page(spark, sf):
    ranked = R.nearest(_vectors(spark, sf), _query(spark, sf), 26)
    return _rounded(R.page(ranked, limit=20, offset=5)).select("id", "distance", "has_more")


def threshold_page(spark, sf):
    ranked = R.nearest(_vectors(spark, sf), _query(spark, sf), 21)
    return _rounded(R.page(ranked, limit=20, max_distance=0.8)).select("id", "distance", "has_more")


def batch_top_k(spark, sf):
    vectors = _vectors(spark, sf)
    return R.nearest_to_each(vectors, vectors.where("id % 100 = 0"), 10).select("query_id", "id", "rank", F.round("distance", 9).alias("distance"))


def tags_all(spark, sf):
    return _assets(spark, sf).where(C.tags_all(F.col("tags"), ["promo", "plate"])).select("id")


def tags_any(spark, sf):
    return _assets(spark, sf).where(C.tags_any(F.col("tags"), ["promo", "plate"])).select("id")


def meta_typed(spark, sf):
    """Clicks have the number as text: only they match."""
    as_text = F.concat(F.lit('{"k":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    props = F.when(F.col("event_type") == "click", as_text).otherwise(F.col("props"))
    return _read(spark, sf, "events").select("event_id", C.meta_equals(props, "k", "69").alias("matches"))


def tag_counts(spark, sf):
    tags = _assets(spark, sf).select(F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


def summary(spark, sf):
    return _assets(spark, sf).agg(F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def jobs_by_status(spark, sf):
    return _jobs(spark, sf).groupBy("model", "status").agg(F.count("*").alias("n"))


def oldest_waiting(spark, sf):
    return _jobs(spark, sf).where(F.col("status").isin(*J.OPEN)).agg(F.min("created_at").alias("oldest"))


def latest_status(spark, sf):
    return J.latest(_jobs(spark, sf))


def status_map(spark, sf):
    pairs = J.latest(_jobs(spark, sf)).groupBy("asset_id").agg(F.sort_array(F.collect_list(F.concat_ws("=", "model", "status"))).alias("s"))
    return pairs.select("asset_id", F.array_join("s", ",").alias("statuses"))


def job_states(spark, sf):
    return _jobs(spark, sf).groupBy(J.state(F.expr(NOW)).alias("state")).agg(F.count("*").alias("n"))


def claim(spark, sf):
    return J.claim(_jobs(spark, sf), now=F.expr(NOW), limit=16).select("id", "status", "attempts")


def has_work(spark, sf):
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(_jobs(spark, sf).where("status = 'pending'").select(F.col("asset_id").alias("id")), "id", "left_semi")


def missing_vector(spark, sf):
    return J.without_vector(_read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _vectors(spark, sf).where("label < 5"))


def coverage(spark, sf):
    v = _vectors(spark, sf)
    return v.select("id").join(v.where("label > 3").select("id"), "id", "left_anti").agg(F.count("*").alias("uncovered"))


def newest_page(spark, sf):
    return _jobs(spark, sf).select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(31).offset(10)


def bounded_count(spark, sf):
    return _assets(spark, sf).where(C.tags_any(F.col("tags"), ["plate"])).limit(50).agg(F.count("*").alias("n"))


def upserted(spark, sf):
    old = _vectors(spark, sf).select("id", "label")
    return J.upsert(old, old.where("label > 6").withColumn("label", F.col("label") + 100), ["id"])


def content_identity(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.where("sha256 is not null").groupBy("sha256").agg(F.min("doc_id").alias("stored"), (F.count("*") - 1).alias("duplicates"))


def percentile(spark, sf):
    nearest_rank = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice)")
    return _read(spark, sf, "orders").groupBy("o_orderpriority").agg(nearest_rank.alias("p95"))


def normal_tags(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", C.normalise_tag(F.concat(F.lit(" "), F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise(F.col("p_type")))).alias("tag"))


def concept_recall(spark, sf):
    """Of each query's ten nearest the share with its label."""
    vectors = _vectors(spark, sf)
    near = R.nearest_to_each(vectors, vectors.where("id % 100 = 0"), 10)
    named = near.join(vectors.select("id", "label"), "id").join(vectors.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return named.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 9).alias("recall"))


_BATCH = """SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, q.label AS own, round(1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
    (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 12) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY d, e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 10"""

QUERIES = {
    f.__name__: f
    for f in (
        top_k, narrowed_top_k, ranked_page, threshold_page, batch_top_k, tags_all, tags_any, meta_typed, tag_counts, summary, jobs_by_status, oldest_waiting,
        latest_status, status_map, job_states, claim, has_work, missing_vector, coverage, newest_page, bounded_count, upserted, content_identity, percentile,
        normal_tags, concept_recall,
    )
}

ORACLE_SQL = {
    "top_k": f"SELECT id, round(d, 9) AS distance FROM ({_RANKED}) WHERE id <> 0 ORDER BY d, id LIMIT 21",
    "narrowed_top_k": f"SELECT id, round(d, 9) AS distance FROM ({_RANKED}) WHERE label IN (1, 3) ORDER BY d, id LIMIT 21",
    "ranked_page": f"SELECT id, round(d, 9) AS distance, (SELECT count(*) > 25 FROM embeddings) AS has_more FROM ({_RANKED}) ORDER BY d, id LIMIT 20 OFFSET 5",
    "threshold_page": f"""WITH c AS (SELECT * FROM (SELECT id, d, row_number() OVER (ORDER BY d, id) AS place FROM ({_RANKED})) WHERE place <= 21 AND d <= 0.8)
        SELECT id, round(d, 9) AS distance, (SELECT max(place) > 20 FROM c) AS has_more FROM c WHERE place <= 20""",
    "batch_top_k": f"SELECT query_id, id, rank::INTEGER AS rank, round(d, 9) AS distance FROM ({_BATCH})",
    "tags_all": f"SELECT id FROM {_ASSETS} WHERE list_has_all(tags, ['promo', 'plate'])",
    "tags_any": f"SELECT id FROM {_ASSETS} WHERE list_has_any(tags, ['promo', 'plate'])",
    "meta_typed": "SELECT event_id, coalesce(event_type = 'click' AND json_extract(props, '$.k')::VARCHAR = '69', false) AS matches FROM events",
    "tag_counts": f"SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM {_ASSETS}) GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
    "summary": f"SELECT count(*) AS assets, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes FROM {_ASSETS}",
    "jobs_by_status": f"SELECT model, status, count(*) AS n FROM {_JOBS} GROUP BY ALL",
    "oldest_waiting": f"SELECT min(created_at) AS oldest FROM {_JOBS} WHERE status IN ('pending', 'running')",
    "latest_status": f"SELECT asset_id, model, status FROM {_JOBS} QUALIFY row_number() OVER (PARTITION BY asset_id, model ORDER BY created_at DESC, id DESC) = 1",
    "status_map": f"""SELECT asset_id, string_agg(model || '=' || status, ',' ORDER BY model || '=' || status) AS statuses FROM
        (SELECT * FROM {_JOBS} QUALIFY row_number() OVER (PARTITION BY asset_id, model ORDER BY created_at DESC, id DESC) = 1) GROUP BY asset_id""",
    "job_states": f"""SELECT CASE WHEN status = 'pending' AND available_at <= {NOW} THEN 'waiting' WHEN status = 'pending' THEN 'not_yet_due'
        WHEN status = 'running' AND available_at >= {NOW} THEN 'held' WHEN status = 'running' THEN 'expired' ELSE status END AS state, count(*) AS n FROM {_JOBS} GROUP BY 1""",
    "claim": f"""SELECT id, 'running' AS status, 1 AS attempts FROM {_JOBS} WHERE (status = 'pending' AND available_at <= {NOW})
        OR (status = 'running' AND available_at < {NOW}) ORDER BY available_at, id LIMIT 16""",
    "has_work": f"SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT asset_id FROM {_JOBS} WHERE status = 'pending')",
    "missing_vector": "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE label < 5 AND vec_id = c_custkey)",
    "coverage": "SELECT count(*) AS uncovered FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label > 3)",
    "newest_page": f"SELECT id, created_at FROM {_JOBS} ORDER BY created_at DESC, id DESC LIMIT 21 OFFSET 10",
    "bounded_count": f"SELECT least(50, count(*)) AS n FROM {_ASSETS} WHERE list_has_any(tags, ['plate'])",
    "upserted": "SELECT vec_id AS id, CASE WHEN label > 6 THEN label + 100 ELSE label END AS label FROM embeddings",
    "content_identity": "SELECT sha256(text) AS sha256, min(doc_id) AS stored, count(*) - 1 AS duplicates FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "percentile": "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1",
    "normal_tags": "SELECT p_partkey, CASE WHEN regexp_full_match(lower(raw), '[a-z0-9][a-z0-9_-]{0,63}') THEN lower(raw) END AS tag FROM (SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand ELSE p_type END AS raw FROM part)",
    "concept_recall": f"SELECT query_id, round(avg((label = own)::INTEGER), 9) AS recall FROM ({_BATCH}) GROUP BY query_id",
}
