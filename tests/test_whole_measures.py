import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import measures as M
from orrery.plans import measures as P


def in_sql(folder, name, *tables):
    db = duckdb.connect()
    for table in tables:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return db.sql(P.ORACLE_SQL[name]).df()


def test_files_of_one_name_stand_by_key(spark, tmp_path):
    keys = [7, 123456, *range(1234560, 1234570)]
    parts = spark.createDataFrame([(k, None if k == 7 else f"part {k % 5}") for k in keys], "p_partkey long, p_name string")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert P.corpus_digest(spark, str(tmp_path)).first().digest == in_sql(tmp_path, "corpus_digest", "part").digest[0]
    files = spark.range(3000).select(F.col("id").cast("string").alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    assert len({M.corpus_digest(f).first().digest for f in (files, files.repartition(7), files.coalesce(1))}) == 1
    assert M.corpus_digest(files.limit(0)).first().digest is None


def odd_corpus(spark, folder):
    """Parts of few looks and pictures, of null ones, and repeated; vectors with copies, zeros, and null ones."""
    parts = [(i, f"l{i % 3}" if i % 11 else None, i % 4 if i % 13 else None) for i in range(60)] + [(5, "l0", 3), (5, "l1", 1), (8, "l2", 1), (None, "l0", 1)]
    vectors = [(i, None if i in (9, 20, 22) else [((i % 7) * (j + 1)) % 5 / 3 - 0.5 for j in range(6)], i % 2 + 3) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def same(spark, folder, name):
    mine, other = P.QUERIES[name](spark, str(folder)).toPandas(), in_sql(folder, name, "part", "embeddings")
    columns = sorted(other.columns)
    mine, other = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, other))
    pd.testing.assert_frame_equal(mine, other, check_dtype=False)


@pytest.mark.parametrize("chunk", [None, 24])
def test_preferences_of_odd_rows_whatever_the_chunks(spark, tmp_path, monkeypatch, chunk):
    odd_corpus(spark, tmp_path)
    if chunk:
        monkeypatch.setattr(M, "ANCHOR_VALUES", chunk)
        monkeypatch.setattr(M, "CHUNK_VALUES", chunk)
    same(spark, tmp_path, "preference")
    same(spark, tmp_path, "preference_overall")


def test_averages_of_odd_rows(spark, tmp_path):
    odd_corpus(spark, tmp_path)
    same(spark, tmp_path, "look_averages")


def test_all_pairs_of_odd_rows_whatever_the_blocks(spark, tmp_path, monkeypatch):
    odd_corpus(spark, tmp_path)
    same(spark, tmp_path, "similar_pairs")
    monkeypatch.setattr(M, "BLOCK", 7)
    same(spark, tmp_path, "similar_pairs")
    named = M.similarities(spark.createDataFrame([("b", [1.0]), ("a", [2.0]), ("c", [1.0, 2.0]), (None, [1.0])], "id string, vector array<double>"), side=2)
    assert sorted(map(tuple, named.collect())) == [("a", "b", 2.0), ("a", "c", None), ("b", "c", None)]
