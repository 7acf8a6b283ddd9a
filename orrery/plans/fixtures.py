"""The catalogue's tables made from the test tables, in Spark and, word for word, in SQL.

Parts are assets, embeddings their vectors under one model or two, orders their
jobs; an order's lease ends three days after it is due, so the two are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP '1998-07-01 12:00:00'"
CLIP, DINO = "clip-vit-l14", "dinov2-large"


def now():
    return F.expr(NOW)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_ASSETS = """p_partkey AS id, {timestamp} AS created_at, {hash} AS sha256,
    'image/' || CASE WHEN p_size % 3 = 0 THEN 'png' WHEN p_size % 3 = 1 THEN 'jpeg' ELSE 'gif' END AS content_type,
    CASE WHEN p_size % 3 = 0 THEN 'png' ELSE 'jpg' END AS file_ext, p_size - 1 AS width, p_size AS height, CAST(p_size AS BIGINT) * 100 AS size_bytes,
    CASE WHEN p_size % 2 = 0 THEN 'upload' ELSE 'folder' END AS source, {tags} AS tags,
    '{{"brand":"' || p_brand || '","lot":' || CASE WHEN p_size > 25 THEN '"' || CAST(p_size % 5 AS {text}) || '"' ELSE CAST(p_size % 5 AS {text}) END || '}}' AS meta"""
_JOBS = """o_orderkey AS id, o_custkey AS asset_id, CASE WHEN o_orderpriority < '3' THEN 'clip-vit-l14' ELSE 'dinov2-large' END AS model,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE CASE WHEN o_totalprice > 250000 THEN 'failed' ELSE 'done' END END AS status,
    CAST(floor(o_totalprice / 150000) AS INT) AS attempts, o_orderdate AS available_at,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '3' DAY END AS lease_expires_at, CAST(NULL AS {text}) AS last_error,
    o_orderdate - INTERVAL '1' DAY AS created_at, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at"""

ASSETS = "(SELECT " + _ASSETS.format(
    timestamp="TIMESTAMP '2020-01-01 00:00:00' + to_minutes(p_partkey % 997)", hash="sha256(p_name || p_brand)", tags="list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))", text="VARCHAR"
) + " FROM part)"
JOBS = "(SELECT " + _JOBS.format(text="VARCHAR") + " FROM orders)"
VECTORS = f"""(SELECT vec_id AS asset_id, '{CLIP}' AS model, embedding AS vector FROM embeddings UNION ALL
    SELECT vec_id AS asset_id, '{DINO}' AS model, embedding AS vector FROM embeddings WHERE label > 3)"""


def assets(spark, sf) -> DataFrame:
    spark_sql = _ASSETS.format(
        timestamp="TIMESTAMP '2020-01-01 00:00:00' + make_dt_interval(0, 0, CAST(p_partkey % 997 AS INT))", hash="sha2(p_name || p_brand, 256)",
        tags="array_distinct(split(p_name || ' ' || lower(p_type), ' '))", text="STRING",
    )
    return read(spark, sf, "part").selectExpr(*_columns(spark_sql))


def _columns(listed: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(listed):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and not depth:
                out.append(listed[start:i].strip())
                start = i + 1
    return [*out, listed[start:].strip()]


def jobs(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").selectExpr(*_columns(_JOBS.format(text="STRING")))


def vectors(spark, sf) -> DataFrame:
    stored = read(spark, sf, "embeddings")
    of = lambda rows, model: rows.select(F.col("vec_id").alias("asset_id"), F.lit(model).alias("model"), F.col("embedding").alias("vector"))
    return of(stored, CLIP).unionAll(of(stored.where("label > 3"), DINO))


def query(spark, sf, vec_id: int = 0) -> list[float]:
    return list(read(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)  # one vector


def distance(a: str, b: str) -> str:
    """The cosine distance in SQL."""
    dot = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])".format
    return f"1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def ranked(model: str, vec_id: int = 0) -> str:
    """All vectors of a model by distance in SQL (id, d)."""
    return f"""(SELECT v.asset_id AS id, {distance('v.vector', 'q.embedding')} AS d FROM {VECTORS} v, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q
        WHERE v.model = '{model}')"""


#: Of each asset and model the newest job, in SQL.
LATEST = f"(SELECT * FROM {JOBS} QUALIFY row_number() OVER (PARTITION BY asset_id, model ORDER BY created_at DESC, id DESC) = 1)"
