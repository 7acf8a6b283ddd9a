import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import index as I
from orrery.operators import measures as M
from orrery.operators import ranking as R
from orrery.scratch import Scratch


def folder(spark, name="index"):
    return Scratch(spark, name).path("at")


@pytest.fixture(scope="module")
def stored(spark):
    return M.clustered(spark, 2000, 16).cache()


@pytest.fixture(scope="module")
def lists(spark, stored):
    return I.ListIndex.build(stored, folder(spark), 44)


def exact(vectors, query, limit, where=None):
    found = vectors if where is None else vectors.where(where)
    return [(r.id, round(r.distance, 9)) for r in R.nearest(found, query, limit).collect()]


def rounded(found):
    return [(i, round(d, 9)) for i, d in found]


def test_every_vector_is_in_one_list_and_files_are_few(spark, stored, lists):
    assert sorted(r.id for r in lists.table.select("id").collect()) == sorted(r.id for r in stored.select("id").collect())
    assert lists.lists.agg(F.sum("rows")).first()[0] == 2000
    files = lists.table.select("list", F.input_file_name().alias("f")).distinct().groupBy("list").count()
    assert files.agg(F.max("count")).first()[0] == 1
    assert len(lists.centres.coarse) == round(math.sqrt(44))


def test_a_walk_gives_the_exact_rows_and_reads_a_part(spark, stored, lists):
    query = list(map(float, M.clustered(spark, 1, 16, first=10_000).first().vector))
    found = lists.walk(query, 10, budget=2000)
    assert rounded(found.found) == exact(stored, query, 10) and not found.scan_limited
    assert found.read < 2000 and found.lists < lists.lists.count()
    narrowed = stored.where("id % 50 = 3")
    found = lists.walk(query, 10, budget=2000, narrowed=narrowed)
    assert rounded(found.found) == exact(narrowed, query, 10) and not found.scan_limited
    found = lists.walk(query, 10, budget=2000, narrowed=narrowed.limit(0))
    assert found.found == [] and found.read == 2000 and not found.scan_limited


def test_a_walk_scans_what_it_says(spark, stored, lists, monkeypatch):
    """The rows that come out of its scans, as Spark observes them."""
    seen, scan = [], R.nearest

    def observed(rows, *args, **how):
        seen.append(Observation())
        return scan(rows.observe(seen[-1], F.count(F.lit(1)).alias("rows")), *args, **how)

    monkeypatch.setattr(I.R, "nearest", observed)
    found = lists.walk([1.0] + [0.0] * 15, 5, budget=1500)
    assert found.read == sum(s.get["rows"] for s in seen) <= 1500 and len(seen) > 1


@pytest.mark.parametrize("budget", [0, 60, 300, 900])
def test_a_budget_is_kept_and_rows_stay_in_order(spark, stored, lists, budget):
    query = list(map(float, M.clustered(spark, 1, 16, first=10_001).first().vector))
    narrowed = stored.where("id % 100 = 7")
    found = lists.walk(query, 15, budget=budget, narrowed=narrowed)
    assert found.read <= budget and found.scan_limited
    truth = exact(narrowed, query, 15)
    assert rounded(found.found) == truth[: len(found.found)] and len(found.found) < 15


def test_an_index_of_nothing_and_odd_vectors(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    empty = I.ListIndex.build(none, folder(spark), 4)
    assert empty.nearest([1.0, 0.0], 3, probes=2).count() == 0
    assert empty.walk([1.0, 0.0], 3, budget=10) == I.Walk([], False, 0, 0)
    assert empty.nearest_to_each(none, 3, probes=2).count() == 0
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.6, 0.8]), ("e", [0.6, 0.8]), (None, [1.0, 0.1])]
    odd = spark.createDataFrame(rows, "id string, vector array<float>")
    built = I.ListIndex.build(odd, folder(spark), 3)
    assert built.table.count() == 5
    assert [i for i, _ in built.walk([1.0, 0.0], 4, budget=9).found][:1] == ["a"]
    assert [i for i, _ in built.walk([1.0, 0.0], 9, budget=9).found][-2:] == ["d", "e"]
    assert built.walk([0.0, 0.0], 4, budget=9).found == []


def test_copies_of_one_vector_do_not_break_the_lists(spark):
    draw = random.Random(5)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else [draw.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    built = I.ListIndex.build(vectors, folder(spark), 25)
    assert built.table.count() == 600
    assert rounded(built.walk([1.0, 0.2, 0.0], 20, budget=600).found) == exact(vectors, [1.0, 0.2, 0.0], 20)


def test_ids_that_are_strings(spark):
    vectors = M.clustered(spark, 300, 8).withColumn("id", F.concat(F.lit("é-"), F.col("id").cast("string"))).cache()
    queries = vectors.where("id like '%7'")
    truth = {(r.query_id, r.rank): r.id for r in R.nearest_to_each(vectors, queries, 4).collect()}
    names, unit = zip(*[(r.id, np.array(r.vector, float)) for r in vectors.collect()], strict=True)
    unit = R.unit_rows(unit)
    for n in (i for i, name in enumerate(names) if name.endswith("7")):
        near = sorted((round(float(1 - unit[n] @ unit[j]), 12), names[j]) for j in range(len(names)) if j != n)[:4]
        assert [truth[names[n], k + 1] for k in range(4)] == [name for _, name in near]
    blocks = R.nearest_to_each(vectors, queries, 4, block_values=40)
    assert {(r.query_id, r.rank): r.id for r in blocks.collect()} == truth
    built = I.ListIndex.build(vectors, folder(spark), 9)
    assert {(r.query_id, r.rank): r.id for r in built.nearest_to_each(queries, 4, probes=99).collect()} == truth


@pytest.fixture(scope="module")
def graph(spark, stored):
    return G.GraphIndex.build(stored, folder(spark, "graph"), 44)


def test_the_graph_holds_all_and_all_can_be_reached(spark, stored, graph):
    assert graph.nodes.count() == 2000 and graph.unreached().count() == 0
    assert sorted(r.id for r in graph.nodes.select("id").collect()) == sorted(r.id for r in stored.select("id").collect())
    degrees = [len(r.neighbours) for r in graph.nodes.collect()]
    assert max(degrees) <= 2 * I.NEIGHBOURS + 20 and min(degrees) > 0
    assert graph.heads.count() < 60


def test_the_graphs_recall_grows_with_the_effort(spark, stored, graph):
    queries = stored.where("id % 100 = 0")
    truth = R.nearest_to_each(stored, queries, 10).cache()
    recalls, scored = [], []
    for effort in (10, 40, 120):
        found = graph.nearest_to_each(queries, 10, effort=effort).cache()
        assert found.groupBy("query_id").count().where("count != 10").isEmpty()
        recalls.append(M.mean_and_worst(M.recall(found, truth)).first().mean)
        scored.append(found.agg(F.avg("scored")).first()[0])
    assert recalls[0] <= recalls[1] <= recalls[2] and recalls[1] >= 0.9 and recalls[2] >= 0.98
    assert scored == sorted(scored) and scored[1] < 1000


def test_a_search_writes_no_vectors_and_no_neighbours_of_nodes_it_leaves(spark, stored, graph, monkeypatch):
    written, write = {}, Scratch.table

    def table(self, df, name):
        written[name.split("-")[0]] = set(df.columns)
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    assert graph.nearest_to_each(stored.where("id % 500 = 0"), 5, effort=8).count() == 20
    assert written["beam"] == {"query_id", "id", "list", "distance", "done", "scored"} and written["wanted"] == {"query_id", "list", "id"}


def test_a_graph_over_copies_nulls_and_strings(spark):
    draw = random.Random(6)
    rows = [(f"n{i:03}", [1.0, 0.0, 0.0] if i % 3 else [draw.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    rows += [("zero", [0.0, 0.0, 0.0]), ("null", None), (None, [1.0, 1.0, 1.0])]
    made = G.GraphIndex.build(spark.createDataFrame(rows, "id string, vector array<double>"), folder(spark, "graph"), 17)
    assert made.nodes.count() == 300 and made.unreached().count() == 0
    assert max(len(r.neighbours) for r in made.nodes.collect()) < 80
    found = made.nearest([1.0, 0.01, 0.0], 5, effort=60).collect()
    assert all(abs(r.distance - found[0].distance) < 1e-9 for r in found) and len(found) == 5
    nothing = spark.createDataFrame([], "id long, vector array<float>")
    empty = G.GraphIndex.build(nothing, folder(spark, "graph"), 3)
    assert empty.nearest([1.0, 0.0], 3, effort=9).count() == 0 and empty.unreached().count() == 0


def test_arcs_of_one_block_make_a_tree():
    draw = np.random.default_rng(1)
    block = I.units(np.concatenate((draw.standard_normal((500, 6)), np.ones((100, 6)))))
    home = np.arange(600) % 4 > 0
    a, b, length, tree, head = G.block_arcs(block, home, 8, 32)
    assert home[head] and np.allclose(length, 1 - np.einsum("rd,rd->r", block[a], block[b]))
    parents = dict(zip(b[tree].tolist(), a[tree].tolist(), strict=True))
    assert set(parents) == set(np.flatnonzero(home).tolist()) - {head}
    for node in parents:
        seen = set()
        while node != head:
            assert node not in seen
            seen.add(node)
            node = parents[node]
    assert np.bincount(a[~tree]).max() <= 8 and np.bincount(a[tree]).max() < 40
