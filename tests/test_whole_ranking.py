import random

from orrery.operators import ranking


def test_any_number_of_queries(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    whole, blocks = (sorted(map(tuple, ranking.nearest_to_each(vectors, vectors, 5, block_values=n).collect())) for n in (10_000, 70))
    assert len(whole) == 60 * 5 and whole == blocks
    assert ranking.nearest_to_each(vectors, vectors.limit(0), 5).count() == 0


def test_no_cap_on_the_query_set(spark, monkeypatch):
    for name in ("MOST_QUERY_VALUES", "BLOCK_VALUES"):
        monkeypatch.setattr(ranking, name, 16, raising=False)
    vectors = spark.range(30).selectExpr("id", "array(cast(id as double), 1D, 2D, 3D) AS vector")
    assert ranking.nearest_to_each(vectors, vectors, 3).count() == 90
