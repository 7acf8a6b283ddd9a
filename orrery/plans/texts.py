"""Queries of text, metadata and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.functions import embedders as E
from orrery.plans import fixtures as X


def _parts(spark, sf):
    return X.read(spark, sf, "part")


def split_tags(spark, sf):
    raw = F.array(F.concat(F.upper(F.regexp_replace("p_name", " ", ", ")), F.lit(",, ")), F.col("p_type"))
    return _parts(spark, sf).select("p_partkey", F.array_join(C.split_tags(raw), " ").alias("tags"))


def label_tags(spark, sf):
    return _parts(spark, sf).select("p_partkey", C.label_tag(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  x "), F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(""))).alias("tag"))


def tag_unions(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.array_join(C.tag_union(F.array(F.lit("run"), F.lit("red")), F.split("p_name", " ")), " ").alias("tags"))


def merged_metadata(spark, sf):
    """Three layers, read back by their members: the last one wins, numbers stay numbers."""
    own = F.when(F.col("size_bytes") > 2000, F.col("meta"))
    merged = C.metadata_merge(F.lit('{"lot":9,"run":"a"}'), own, F.to_json(F.struct(F.col("file_ext").alias("source_path"))))
    return X.assets(spark, sf).select("id", F.get_json_object(merged, "$.lot").alias("lot"), F.get_json_object(merged, "$.run").alias("run"), F.get_json_object(merged, "$.source_path").alias("source_path"), C.meta_equals(merged, "lot", "3").alias("text_three"))


def metadata_checks(spark, sf):
    nested = F.concat(F.lit('{"a":'), F.repeat(F.lit("["), F.col("p_size") % 6), F.repeat(F.lit("]"), F.col("p_size") % 6), F.when(F.col("p_size") % 6 == 0, "1").otherwise(""), F.lit("}"))
    raw = F.when(F.col("p_size") > 45, F.col("p_name")).when(F.col("p_size") > 42, F.lit("[]")).when(F.col("p_size") > 40, F.concat(F.lit('{"k":"'), F.repeat(F.lit("x"), 9000), F.lit('"}'))).when(F.col("p_size") < 2, F.lit("  ")).otherwise(nested)
    return _parts(spark, sf).select("p_partkey", C.metadata_problem(raw).alias("problem"), C.json_depth(raw).alias("depth"), C.metadata(raw).isNull().alias("refused"))


def bounded_reasons(spark, sf):
    long = F.repeat(F.lit("ab"), 1100)
    reason = C.reason_for(F.lit("Broken"), F.when(F.col("p_size") > 30, long).otherwise(F.col("p_name")), F.col("p_size") > 10)
    return _parts(spark, sf).select("p_partkey", F.octet_length(reason).alias("bytes"), F.substring(reason, 1, 20).alias("start"), reason.endswith(C.CUT_MARK).alias("cut"))


def addresses(spark, sf):
    declared = F.when(F.col("p_size") > 30, F.concat(F.lit("https://x.org/"), "p_name")).when(F.col("p_size") > 20, F.concat(F.lit("http://"), F.repeat(F.lit("y"), 510))).otherwise(F.col("p_name"))
    return _parts(spark, sf).select("p_partkey", C.address(declared, F.concat(F.lit("https://own/"), C.picture_name(F.col("p_partkey")))).alias("address"))


def provenance(spark, sf):
    made = C.provenance("made", F.col("p_partkey"), F.col("p_brand"), F.col("p_name"))
    return _parts(spark, sf).select("p_partkey", F.get_json_object(made, "$.dataset_id").alias("dataset_id"), F.get_json_object(made, "$.licence").alias("licence"), C.meta_equals(made, "dataset", "made").alias("named"))


def backoff(spark, sf):
    return X.jobs(spark, sf).groupBy(C.backoff_seconds(F.col("attempts") + 1).alias("seconds")).agg(F.count("*").alias("n"))


def file_names(spark, sf):
    return _parts(spark, sf).select("p_partkey", C.file_name(F.concat(F.lit("a/b\\"), "p_name", F.lit("\u0007.jpg. "), F.when(F.col("p_size") > 25, "/").otherwise(""))).alias("name"))


def unit_vectors(spark, sf):
    v = X.read(spark, sf, "embeddings").withColumn("v", C.unit(F.transform("embedding", lambda x: x * 3)))
    return v.select("vec_id", F.round(F.sqrt(C.dot(F.col("v"), F.col("v"))), 5).alias("length"), F.round(C.score(C.cosine_distance(F.col("v"), F.col("embedding"))), 5).alias("score"))


def made_vectors(spark, sf):
    """Vectors of a made embedder: equal texts have equal ones, all of length one."""
    docs = X.read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    found = docs.withColumn("e", E.embed(F.col("text"), 16))
    return found.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count_distinct("e.vector").alias("vectors"), F.round(F.max(F.sqrt(C.dot(F.col("e.vector"), F.col("e.vector")))), 5).alias("length"), F.bool_or("e.truncated").alias("truncated"))


QUERIES = {f.__name__: f for f in (split_tags, label_tags, tag_unions, merged_metadata, metadata_checks, bounded_reasons, addresses, provenance, backoff, file_names, unit_vectors, made_vectors)}

_RAW_DEPTH = "CASE WHEN p_size % 6 = 0 THEN 2 ELSE 1 + p_size % 6 END"
ORACLE_SQL = {
    "split_tags": "SELECT p_partkey, array_to_string(CASE WHEN string_split(p_name, ' ')[1] = lower(p_type) THEN string_split(p_name, ' ') ELSE list_append(string_split(p_name, ' '), lower(p_type)) END, ' ') AS tags FROM part",
    "label_tags": "SELECT p_partkey, CASE WHEN p_size <= 40 THEN replace(p_name, ' ', '-') || '-x' END AS tag FROM part",
    "tag_unions": "SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'run ' || p_name ELSE 'run red ' || p_name END AS tags FROM part",
    "merged_metadata": f"""SELECT id, CASE WHEN size_bytes > 2000 THEN json_extract_string(meta, '$.lot') ELSE '9' END AS lot, 'a' AS run, file_ext AS source_path,
        size_bytes > 2000 AND json_extract(meta, '$.lot')::VARCHAR = '"3"' AS text_three FROM {X.ASSETS}""",
    "metadata_checks": f"""SELECT p_partkey, problem, depth::INTEGER AS depth, problem IS NOT NULL AS refused FROM (SELECT p_partkey,
        CASE WHEN p_size > 45 THEN 'not JSON' WHEN p_size > 42 THEN 'not an object' WHEN p_size > 40 THEN 'too many bytes' WHEN p_size < 2 THEN NULL WHEN {_RAW_DEPTH} > 4 THEN 'too deep' END AS problem,
        CASE WHEN p_size > 45 THEN NULL WHEN p_size > 42 THEN 1 WHEN p_size > 40 THEN 2 WHEN p_size < 2 THEN NULL ELSE {_RAW_DEPTH} END AS depth FROM part)""",
    "bounded_reasons": """SELECT p_partkey, (CASE WHEN p_size > 30 THEN 2048 WHEN p_size > 10 THEN strlen('Broken: ' || p_name) ELSE 6 END)::INTEGER AS bytes,
        left(CASE WHEN p_size > 30 THEN 'Broken: abababababababab' WHEN p_size > 10 THEN 'Broken: ' || p_name ELSE 'Broken' END, 20) AS start, p_size > 30 AS cut FROM part""",
    "addresses": "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'https://x.org/' || p_name ELSE 'https://own/' || lpad(p_partkey::VARCHAR, 12, '0') || '.jpg' END AS address FROM part",
    "provenance": "SELECT p_partkey, p_partkey::VARCHAR AS dataset_id, p_brand AS licence, true AS named FROM part",
    "backoff": f"SELECT (10 * pow(2, attempts + 1))::BIGINT AS seconds, count(*) AS n FROM {X.JOBS} GROUP BY 1",
    "file_names": "SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_name || '.jpg' END AS name FROM part",
    "unit_vectors": "SELECT vec_id, 1.0::DOUBLE AS length, 1.0::DOUBLE AS score FROM embeddings",
    "made_vectors": "SELECT sha256(text) AS sha256, 1 AS vectors, 1.0::DOUBLE AS length, false AS truncated FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
