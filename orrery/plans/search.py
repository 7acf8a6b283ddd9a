"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.model import Narrowing
from orrery.operators import graph as G
from orrery.operators import measures as M
from orrery.operators import ranking as R
from orrery.operators import search as S
from orrery.plans import fixtures as X
from orrery.scratch import Scratch

RARE = Narrowing(tags_any=("hot", "plate"), meta={"lot": "3"})
_RARE = """SELECT id FROM {} WHERE list_has_any(tags, ['hot', 'plate']) AND json_extract(meta, '$.lot')::VARCHAR = '"3"'""".format(X.ASSETS)


def _args(spark, sf):
    return X.vectors(spark, sf), X.assets(spark, sf), X.query(spark, sf)


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 9))


def model_scan(spark, sf):
    stored = S.store_vectors(X.vectors(spark, sf), Scratch(spark, "vectors").path("by_model"))
    return S.of_model(stored, X.DINO).select("asset_id", F.size("vector").alias("width"))


def vector_lookup(spark, sf):
    return S.vector_of(X.vectors(spark, sf), 7, X.CLIP).select("asset_id", "model", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def narrowed_search(spark, sf):
    v, a, q = _args(spark, sf)
    return _rounded(S.nearest(v, a, q, 21, model=X.CLIP, narrowing=RARE))


def narrowed_all(spark, sf):
    v, a, q = _args(spark, sf)
    return _rounded(S.nearest(v, a, q, 21, model=X.CLIP, narrowing=Narrowing(tags_all=("red", "plate")), exclude=0))


def reachable(spark, sf):
    v, a, _ = _args(spark, sf)
    return S.reachable(v, a, model=X.DINO, narrowing=RARE, at_most=5)


def search_page(spark, sf):
    v, a, q = _args(spark, sf)
    found = S.page(v, a, X.jobs(spark, sf), q, model=X.CLIP, limit=10, offset=3, min_score=-0.5, narrowing=Narrowing(tags_any=("red", "hot")))
    statuses = F.concat_ws(",", F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.items.select("place", "id", F.round("score", 9).alias("score"), "source", statuses.alias("statuses"), F.lit(found.has_more).alias("has_more"), F.lit(found.scan_limited).alias("scan_limited"))


def search_envelope(spark, sf):
    v, a, q = _args(spark, sf)
    found = S.page(v, a, X.jobs(spark, sf), q, model=X.CLIP, limit=5, narrowing=RARE, exclude=0)
    whole = S.envelope(found, limit=5, offset=0, model=X.CLIP)
    parsed = F.from_json("page", "items array<struct<asset:struct<id:bigint,links:struct<file:string>>>>, `limit` int, has_more boolean, encoder string, scan_limited boolean")
    rows = whole.select(parsed.alias("p")).select(F.posexplode("p.items").alias("place", "item"), "p.limit", "p.has_more", "p.encoder", "p.scan_limited")
    return rows.select("place", F.col("item.asset.id").alias("id"), F.col("item.asset.links.file").alias("file"), F.col("limit").alias("asked"), "has_more", F.col("encoder").isNull().alias("no_encoder"), "scan_limited")


def budgeted_scan(spark, sf):
    v, a, q = _args(spark, sf)
    return _rounded(S.budgeted(v, a, q, 10, model=X.CLIP, narrowing=RARE, budget=150))


def post_filtered(spark, sf):
    v, a, q = _args(spark, sf)
    return _rounded(S.post_filtered(v, a, q, 21, model=X.CLIP, narrowing=RARE, effort=40))


def scan_limited(spark, sf):
    """Whether a budget cut the scan short, at each of several budgets."""
    v, a, q = _args(spark, sf)
    rows = []
    for budget in (40, 150, 100_000):
        found = S.page(v, a, X.jobs(spark, sf), q, model=X.CLIP, limit=10, narrowing=RARE, budget=budget)
        rows.append((budget, found.scan_limited, found.has_more))
    return spark.createDataFrame(rows, "budget int, scan_limited boolean, has_more boolean")


def enriched(spark, sf):
    """A page that names an asset that has vanished: the rest of it, in order."""
    v, a, q = _args(spark, sf)
    ranked = S.nearest(v, a, q, 8, model=X.CLIP).withColumn("place", F.row_number().over(S.Window.orderBy("distance", "id")))
    return S.enriched(ranked, a.where("source = 'folder'"), X.jobs(spark, sf)).select("place", "id", F.round("score", 9).alias("score"))


def list_index(spark, sf):
    """All lists probed: the index gives the exact answer."""
    vectors = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = S.ListIndex.build(vectors, Scratch(spark, "index").path("lists"), 8)
    return _rounded(index.nearest(X.query(spark, sf), 21, probes=8))


def list_index_recall(spark, sf):
    """Recall of the index at each number of probes; every row whose id is divisible by 100 is a query, against all rows."""
    vectors = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    lists = S.list_counts(vectors.count())[1]
    index = S.ListIndex.build(vectors, Scratch(spark, "index").path("lists"), lists)
    queries = vectors.where("id % 100 = 0")
    scratch = Scratch(spark, "recall")
    truth = scratch.table(S.guard_exact(R.nearest_to_each(vectors, queries, 10)).select("query_id", "id"), "truth")
    out = None
    for probes in [*S.probe_steps(lists), lists]:
        found = M.mean_and_worst(M.recall(index.nearest_to_each(queries, 10, probes=probes), truth))
        row = found.select(F.lit(probes).alias("probes"), F.round("mean", 9).alias("mean"), F.round("worst", 9).alias("worst"))
        out = row if out is None else out.unionAll(row)
    return out


def _index(spark, sf):
    vectors = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.ListIndex.build(vectors, Scratch(spark, "index").path("lists"), S.list_counts(vectors.count())[1])


def walked_scan(spark, sf):
    """The narrowed search by a walk of the index's lists that stops when its rows are certain."""
    _, a, q = _args(spark, sf)
    index = _index(spark, sf)
    found = index.walk(q, 21, budget=index.table.count(), narrowed=a.where(RARE.condition()))
    return _rounded(spark.createDataFrame(found.found, "id long, distance double"))


def walked_page(spark, sf):
    """A page by the index's walk under a budget that suffices."""
    v, a, q = _args(spark, sf)
    index = _index(spark, sf)
    found = S.page(v, a, X.jobs(spark, sf), q, model=X.CLIP, limit=10, narrowing=RARE, exclude=0, budget=index.table.count(), index=index)
    return found.items.select("place", "id", F.round("score", 9).alias("score"), F.lit(found.has_more).alias("has_more"), F.lit(found.scan_limited).alias("scan_limited"))


def _graph(spark, sf):
    vectors = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, G.GraphIndex.build(vectors, Scratch(spark, "graph").path("graph"), S.list_counts(vectors.count())[1])


def graph_index(spark, sf):
    """A beam as wide as the table: the graph gives the exact answer."""
    vectors, graph = _graph(spark, sf)
    return _rounded(graph.nearest(X.query(spark, sf), 21, effort=vectors.count()))


def graph_recall(spark, sf):
    """Recall of the graph at several efforts, and the distances computed; every row whose id is divisible by 100 is a query, against all rows."""
    vectors, graph = _graph(spark, sf)
    queries = vectors.where("id % 100 = 0")
    scratch = Scratch(spark, "recall")
    truth = scratch.table(S.guard_exact(R.nearest_to_each(vectors, queries, 10)).select("query_id", "id"), "truth")
    out = None
    for effort in (10, 40, 160):
        found = scratch.table(graph.nearest_to_each(queries, 10, effort=effort), f"effort-{effort}")
        row = M.mean_and_worst(M.recall(found, truth)).crossJoin(found.agg(F.avg("scored").alias("scored")))
        row = row.select(F.lit(effort).alias("effort"), F.round("mean", 9).alias("mean"), F.round("worst", 9).alias("worst"), F.round("scored", 3).alias("scored"))
        out = row if out is None else out.unionAll(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (walked_scan, walked_page, graph_index, graph_recall, model_scan, vector_lookup, narrowed_search, narrowed_all, reachable, search_page, search_envelope, budgeted_scan, post_filtered, scan_limited, enriched, list_index, list_index_recall)
}

_CLIP = X.ranked(X.CLIP)
_HOT = f"(SELECT r.id, r.d, a.source FROM {_CLIP} r JOIN {X.ASSETS} a ON a.id = r.id WHERE list_has_any(a.tags, ['red', 'hot']))"


def _budget(n: int) -> str:
    return f"(SELECT id, d FROM (SELECT * FROM {_CLIP} ORDER BY d, id LIMIT {n}) WHERE id IN ({_RARE}))"


ORACLE_SQL = {
    "walked_scan": f"SELECT id, round(d, 9) AS distance FROM {_CLIP} WHERE id IN ({_RARE}) ORDER BY d, id LIMIT 21",
    "walked_page": f"""WITH c AS (SELECT id, d, (row_number() OVER (ORDER BY d, id) - 1)::INTEGER AS place FROM {_CLIP} WHERE id <> 0 AND id IN ({_RARE}))
        SELECT place, id, round(1 - d, 9) AS score, (SELECT count(*) > 10 FROM c) AS has_more, false AS scan_limited FROM c WHERE place < 10""",
    "graph_index": f"SELECT id, round(d, 9) AS distance FROM {_CLIP} ORDER BY d, id LIMIT 21",
    "model_scan": f"SELECT asset_id, len(vector)::INTEGER AS width FROM {X.VECTORS} WHERE model = '{X.DINO}'",
    "vector_lookup": f"SELECT asset_id, model, round(vector[1]::DOUBLE, 6) AS first FROM {X.VECTORS} WHERE model = '{X.CLIP}' AND asset_id = 7",
    "narrowed_search": f"SELECT id, round(d, 9) AS distance FROM {_CLIP} WHERE id IN ({_RARE}) ORDER BY d, id LIMIT 21",
    "narrowed_all": f"SELECT r.id, round(d, 9) AS distance FROM {_CLIP} r JOIN {X.ASSETS} a ON a.id = r.id WHERE list_has_all(a.tags, ['red', 'plate']) AND r.id <> 0 ORDER BY d, r.id LIMIT 21",
    "reachable": f"SELECT least(5, count(*)) AS n FROM {X.VECTORS} WHERE model = '{X.DINO}' AND asset_id IN ({_RARE})",
    "search_page": f"""WITH c AS (SELECT *, (row_number() OVER (ORDER BY d, id) - 1)::INTEGER AS nth FROM {_HOT} ORDER BY d, id LIMIT 14),
        w AS (SELECT id, d, source, (nth - 3)::INTEGER AS place FROM c WHERE nth >= 3 AND d <= 1.5),
        s AS (SELECT asset_id, string_agg(model || '=' || status, ',' ORDER BY model) AS statuses FROM {X.LATEST} GROUP BY 1)
        SELECT place, id, round(1 - d, 9) AS score, source, coalesce(statuses, '') AS statuses, (SELECT count(*) > 10 FROM w) AS has_more, false AS scan_limited
        FROM w LEFT JOIN s ON s.asset_id = w.id WHERE place < 10""",
    "search_envelope": f"""WITH c AS (SELECT id, (row_number() OVER (ORDER BY d, id) - 1)::INTEGER AS place FROM {_CLIP} WHERE id <> 0 AND id IN ({_RARE}))
        SELECT place, id, '/assets/' || id || '/file' AS file, 5 AS asked, (SELECT count(*) > 5 FROM c) AS has_more, true AS no_encoder, false AS scan_limited FROM c WHERE place < 5""",
    "budgeted_scan": f"SELECT id, round(d, 9) AS distance FROM {_budget(150)} ORDER BY d, id LIMIT 10",
    "post_filtered": f"SELECT id, round(d, 9) AS distance FROM {_budget(40)} ORDER BY d, id LIMIT 21",
    "scan_limited": " UNION ALL ".join(
        f"SELECT {n} AS budget, reached < 11 AND reached < (SELECT count(*) FROM {X.VECTORS} WHERE model = '{X.CLIP}' AND asset_id IN ({_RARE})) AS scan_limited, reached > 10 AS has_more FROM (SELECT least(11, count(*)) AS reached FROM {_budget(n)})"
        for n in (40, 150, 100_000)
    ),
    "enriched": f"""SELECT place, r.id, round(1 - d, 9) AS score FROM (SELECT id, d, row_number() OVER (ORDER BY d, id)::INTEGER AS place FROM {_CLIP}) r
        JOIN {X.ASSETS} a ON a.id = r.id WHERE place <= 8 AND a.source = 'folder'""",
    "list_index": f"SELECT id, round(d, 9) AS distance FROM {_CLIP} ORDER BY d, id LIMIT 21",
}
