import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import embedders as E
from orrery.model import Narrowing, PageTooDeep
from orrery.operators import measures as M
from orrery.operators import search as S
from orrery.scratch import Scratch

JOBS = "id long, asset_id long, model string, status string, created_at timestamp"
RARE = Narrowing(tags_any=("rare",), meta={"dataset": "coco"})


def corpus(spark, rows=300, rare=100):
    planar = M.planar(spark, rows, 8, rare).cache()
    vectors = planar.select(F.col("id").alias("asset_id"), F.lit("m").alias("model"), "vector")
    assets = planar.select("id", "tags", "meta", F.lit("upload").alias("source"))
    return vectors, assets, spark.createDataFrame([], JOBS)


QUERY = [1.0] + [0.0] * 7


def test_rare_matches_are_found_however_far(spark):
    vectors, assets, jobs = corpus(spark)
    found = S.page(vectors, assets, jobs, QUERY, model="m", limit=5, narrowing=RARE)
    rows = found.items.collect()
    assert len(rows) == 3 and not found.has_more and not found.scan_limited
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_a_budget_is_told_and_a_full_page_proves_nothing(spark):
    vectors, assets, jobs = corpus(spark)
    ranks = [r.id for r in S.nearest(vectors, assets, QUERY, 300, model="m").collect()]
    rare = sorted(ranks.index(i) for i in (0, 100, 200))
    found = S.page(vectors, assets, jobs, QUERY, model="m", limit=2, narrowing=RARE, budget=rare[1] + 1)
    assert found.items.count() == 2 and not found.has_more and found.scan_limited
    assert not S.page(vectors, assets, jobs, QUERY, model="m", limit=2, narrowing=RARE, budget=300).scan_limited


def test_thresholds_never_refill(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.6, 0.8])]
    vectors = spark.createDataFrame(rows, "asset_id long, vector array<double>").withColumn("model", F.lit("m"))
    assets = spark.createDataFrame([(i, ["a"], "{}", "upload") for i in (1, 2, 3)], "id long, tags array<string>, meta string, source string")
    jobs = spark.createDataFrame([], JOBS)
    page = lambda **how: S.page(vectors, assets, jobs, [1.0, 0.0], model="m", **how)
    ids = lambda p: [r.id for r in p.items.collect()]
    assert ids(page(limit=2)) == [1, 2] and page(limit=2).has_more
    short = page(limit=2, min_score=0.8)
    assert ids(short) == [1] and not short.has_more
    assert ids(page(limit=3)) == [1, 2]  # the asset of vector 4 has vanished
    assert ids(page(limit=2, exclude=1)) == [2]
    with pytest.raises(PageTooDeep):
        page(limit=1000)


def test_plans_tell_where_the_narrowing_is_met(spark):
    vectors, assets, _ = corpus(spark)
    assert S.plan_of(S.nearest(vectors, assets, QUERY, 5, model="m", narrowing=RARE)) == "exact"
    assert S.plan_of(S.post_filtered(vectors, assets, QUERY, 5, model="m", narrowing=RARE, effort=20)) == "post-filter"


def test_the_index_reads_its_lists_only_and_reaches_its_recall(spark):
    stored = M.clustered(spark, 3000, 32).cache()
    queries = M.clustered(spark, 40, 32, first=1_000_000)
    index = S.ListIndex.build(stored, Scratch(spark, "index").path("lists"), S.list_counts(3000)[1])
    assert index.table.count() == 3000
    query = queries.first().vector
    assert "list" in S.lists_read(index.nearest(query, 10, probes=2))
    with pytest.raises(ValueError, match="truth"):
        S.guard_exact(index.nearest(query, 10, probes=2))
    from orrery.operators import ranking as R

    truth = R.nearest_to_each(stored, queries, 10)
    found = {p: M.mean_and_worst(M.recall(index.nearest_to_each(queries, 10, probes=p), truth)).first().mean for p in (1, 7, 55)}
    assert found[1] < found[7] and found[7] >= 0.9 and found[55] == 1


def test_list_counts_and_probes():
    assert S.list_counts(10_000) == (10, 100) and S.list_counts(10) == (1, 3)
    assert S.probe_steps(10) == [1, 2, 3, 5, 10] and S.probe_steps(1) == [1]


def test_the_made_corpus_is_the_same_in_any_split(spark):
    one = {r.id: r.vector for r in M.clustered(spark, 50, 8).coalesce(1).collect()}
    two = {r.id: r.vector for r in M.clustered(spark, 20, 8, first=30).collect()}
    assert all(one[i] == two[i] for i in two) and all(abs(math.sqrt(sum(x * x for x in v)) - 1) < 1e-6 for v in one.values())


def test_bounds():
    assert M.bound([0.2, 0.5]) == 0.75 and M.clears(0.76, [0.5]) and not M.clears(0.75, [0.5])
    with pytest.raises(ValueError):
        M.bound([])


def test_preferences_of_one_hot_models(spark):
    rows = [(look * 3 + picture, f"l{look}", picture) for look in range(3) for picture in range(3)]
    frame = spark.createDataFrame(rows, "id int, look string, picture int")
    hot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (c == i).cast("double"))
    same = F.array(F.lit(1.0), F.lit(0.0))
    for vector, expected in ((hot(F.substring("look", 2, 1).cast("int")), 1.0), (hot(F.col("picture")), 0.0), (same, 0.5)):
        found = M.overall(M.preference(frame.withColumn("vector", vector))).first()
        assert found.preference == expected and found.triples == 36
    assert M.overall(M.preference(frame.where("look = 'l0'").withColumn("vector", same))).first().preference is None


def test_made_embedders():
    made = E.MadeEmbedder(8)
    assert np.allclose(np.linalg.norm(made.embed_text(["a", "b"]), axis=1), 1) and (made.embed_text(["a"]) == made.embed_text(["a"])).all()
    assert made.embed_text([]).shape == (0, 8) and made.embed_images([b"x"]).shape == (1, 8)
    with pytest.raises(ValueError):
        E.MadeEmbedder(8, takes_text=False).embed_text(["a"])
    registry = E.register({"a": 8}, {"a": 8})
    assert registry.get("a") is registry.get("a")
    with pytest.raises(LookupError):
        registry.get("b")
    with pytest.raises(ValueError):
        E.register({"a": 8}, {"a": 9})


def test_a_registry_tries_again_after_a_failure():
    calls = []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not there yet")
        return "made"

    registry = E.Registry({"a": make})
    with pytest.raises(OSError):
        registry.get("a")
    assert registry.get("a") == "made" and registry.get("a") == "made" and len(calls) == 2


def test_units_refuse_a_zero_vector(spark):
    from orrery.functions import columns as C

    rows = spark.createDataFrame([([3.0, 4.0],), (None,)], "v array<double>").select(C.unit(F.col("v")).alias("u")).collect()
    assert [round(x, 6) for x in rows[0].u] == [0.6, 0.8] and rows[1].u is None
    with pytest.raises(Exception, match="no direction"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(C.unit(F.col("v"))).collect()
