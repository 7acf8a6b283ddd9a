"""Queries of retrieval measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import measures as M
from orrery.operators import ranking as R
from orrery.plans import fixtures as X


def _vectors(spark, sf):
    return X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _tagged(spark, sf):
    """Assets whose only tag is a coarse price: some on few enough assets to be concepts."""
    return X.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("c"), F.floor(F.col("c_acctbal") / 40).cast("string"))).alias("tags"))


def _pages(spark, sf, low: int, high: int):
    """A page of each concept: its assets of the market segments in an alphabetic range."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"][low:high]
    c = X.read(spark, sf, "customer").where(F.col("c_mktsegment").isin(*names))
    return c.select(F.concat(F.lit("c"), F.floor(F.col("c_acctbal") / 40).cast("string")).alias("tag"), F.col("c_custkey").alias("id"))


def _labelled(spark, sf):
    """A corpus of looks and pictures: parts by type and by size, with the vector of the row of the same number."""
    p = X.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("look"), F.col("p_size").alias("picture"))
    return p.join(_vectors(spark, sf).select("id", "vector"), "id")


def recall_at_ten(spark, sf):
    """Recall of a ranking over most vectors against the one over all."""
    v = _vectors(spark, sf)
    queries = v.where("id % 100 = 0")
    truth = R.nearest_to_each(v, queries, 10)
    found = R.nearest_to_each(v.where("label <> 3"), queries, 10)
    return M.recall(found, truth).select("query_id", F.round("recall", 9).alias("recall"))


def recall_summary(spark, sf):
    return M.mean_and_worst(recall_at_ten(spark, sf)).select(F.round("mean", 9).alias("mean"), F.round("worst", 9).alias("worst"))


def nearest_rank(spark, sf):
    return X.read(spark, sf, "orders").groupBy("o_orderpriority").agg(M.nearest_rank(0.5, "o_totalprice").alias("p50"), M.nearest_rank(0.99, "o_totalprice").alias("p99"))


def eligible_concepts(spark, sf):
    return M.eligible(_tagged(spark, sf))


def concept_recalls(spark, sf):
    return M.concept_recall(_pages(spark, sf, 0, 3), _tagged(spark, sf)).select("tag", F.round("recall", 9).alias("recall"))


def page_agreement(spark, sf):
    return M.agreement(_pages(spark, sf, 0, 3), _pages(spark, sf, 2, 5)).select("tag", F.round("agreement", 9).alias("agreement"))


def measured_language(spark, sf):
    pages = _pages(spark, sf, 0, 3)
    return M.measured(M.concept_recall(pages, _tagged(spark, sf)), M.agreement(pages, _pages(spark, sf, 2, 5))).select(F.round("recall", 9).alias("recall"), "worst_concept", F.round("worst_recall", 9).alias("worst_recall"), F.round("agreement", 9).alias("agreement"))


def claims(spark, sf):
    recall = F.col("l_discount") * 10
    rows = X.read(spark, sf, "lineitem").select(recall.alias("recall"), (F.col("l_tax") * 12).alias("baseline"))
    return rows.groupBy(M.claimed(F.col("recall"), F.col("baseline")).alias("claimed"), M.usable(F.col("baseline")).alias("usable")).agg(F.count("*").alias("n"))


def similar_pairs(spark, sf):
    """All pairs of the vectors of one label, as matrix blocks."""
    return M.similarities(_vectors(spark, sf).where("label = 3").select("id", "vector"), side=20).select("a", "b", F.round("score", 9).alias("score"))


def preference(spark, sf):
    per = M.preference(_labelled(spark, sf))
    return per.select("look", "triples", F.round(F.col("wins") / F.col("triples"), 9).alias("preference"))


def preference_overall(spark, sf):
    return M.overall(M.preference(_labelled(spark, sf))).select("triples", F.round("preference", 9).alias("preference"))


def triple_counts(spark, sf):
    return M.count_triples(_labelled(spark, sf))


def look_averages(spark, sf):
    found = M.averages(_labelled(spark, sf))
    return found.select(F.round("same_look", 9).alias("same_look"), F.round("same_picture", 9).alias("same_picture"), "look_pairs", "picture_pairs")


def corpus_digest(spark, sf):
    """Keys of more than six digits are cut to them by SQL's lpad as well; files that so share a name stand by key, the order of the table."""
    files = X.read(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("name"), F.encode("p_name", "UTF-8").alias("content"), "p_partkey")
    return M.corpus_digest(files, ties=["p_partkey"])


QUERIES = {
    f.__name__: f
    for f in (
        recall_at_ten, recall_summary, nearest_rank, eligible_concepts, concept_recalls, page_agreement, measured_language, claims, similar_pairs, preference, preference_overall,
        triple_counts, look_averages, corpus_digest,
    )
}


def _top(where: str) -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND {where}
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({X.distance('e.embedding', 'q.embedding')}, 12), e.vec_id) <= 10"""


_RECALL = f"(SELECT t.query_id, round(count(f.id) / count(*), 9) AS recall FROM ({_top('true')}) t LEFT JOIN ({_top('e.label <> 3')}) f ON f.query_id = t.query_id AND f.id = t.id GROUP BY 1)"
_TAGGED = "(SELECT c_custkey AS id, 'c' || floor(c_acctbal / 40)::BIGINT AS tag, c_mktsegment AS seg FROM customer)"
_FIRST = f"(SELECT tag, id FROM {_TAGGED} WHERE seg IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))"
_SECOND = f"(SELECT tag, id FROM {_TAGGED} WHERE seg IN ('FURNITURE', 'HOUSEHOLD', 'MACHINERY'))"
_CONCEPT = f"(SELECT p.tag, p.hits / t.size AS recall FROM (SELECT tag, count(*) AS hits FROM {_FIRST} GROUP BY 1) p JOIN (SELECT tag, count(*) AS size FROM {_TAGGED} GROUP BY 1) t ON t.tag = p.tag)"
_AGREE = f"""(SELECT p.tag, coalesce(b.share, 0) AS agreement FROM (SELECT DISTINCT tag FROM {_FIRST}) p LEFT JOIN
    (SELECT s.tag, count(f.id) / count(*) AS share FROM {_SECOND} s LEFT JOIN {_FIRST} f ON f.tag = s.tag AND f.id = s.id GROUP BY 1) b ON b.tag = p.tag)"""
_LABELLED = "(SELECT p_partkey AS id, p_type AS look, p_size AS picture, embedding::DOUBLE[] AS v FROM part JOIN embeddings ON vec_id = p_partkey)"
_TRIPLES = f"""(SELECT a.look, list_dot_product(a.v, m.v) AS mate, list_dot_product(a.v, t.v) AS twin FROM {_LABELLED} a
    JOIN {_LABELLED} m ON m.look = a.look AND m.picture <> a.picture JOIN {_LABELLED} t ON t.picture = a.picture AND t.look <> a.look)"""
_WIN = "CASE WHEN mate > twin THEN 1.0 WHEN mate = twin THEN 0.5 ELSE 0 END"
_PAIRS = f"(SELECT list_dot_product(a.v, b.v) AS score, a.look = b.look AS look, a.picture = b.picture AS picture FROM {_LABELLED} a JOIN {_LABELLED} b ON a.id < b.id)"

ORACLE_SQL = {
    "recall_at_ten": f"SELECT query_id, recall FROM {_RECALL}",
    "recall_summary": f"SELECT round(avg(recall), 9) AS mean, round(min(recall), 9) AS worst FROM {_RECALL}",
    "nearest_rank": "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1",
    "eligible_concepts": f"SELECT tag, count(*) AS n FROM {_TAGGED} GROUP BY 1 HAVING count(*) BETWEEN 3 AND 10",
    "concept_recalls": f"SELECT tag, round(recall, 9) AS recall FROM {_CONCEPT}",
    "page_agreement": f"SELECT tag, round(agreement, 9) AS agreement FROM {_AGREE}",
    "measured_language": f"""SELECT round((SELECT avg(recall) FROM {_CONCEPT}), 9) AS recall, (SELECT tag FROM {_CONCEPT} ORDER BY recall, tag LIMIT 1) AS worst_concept,
        round((SELECT min(recall) FROM {_CONCEPT}), 9) AS worst_recall, round((SELECT avg(agreement) FROM {_AGREE}), 9) AS agreement""",
    "claims": "SELECT l_discount * 10 >= 0.5 AND l_discount * 10 >= 0.8 * (l_tax * 12) AS claimed, l_tax * 12 >= 0.5 AS usable, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "similar_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = 3 AND b.label = 3",
    "preference": f"SELECT look, count(*) AS triples, round(sum({_WIN}) / count(*), 9) AS preference FROM {_TRIPLES} GROUP BY 1",
    "preference_overall": f"SELECT count(*) AS triples, round(sum({_WIN}) / count(*), 9) AS preference FROM {_TRIPLES}",
    "triple_counts": f"""SELECT look, sum((SELECT count(*) FROM {_LABELLED} m WHERE m.look = a.look AND m.picture <> a.picture) * (SELECT count(*) FROM {_LABELLED} t WHERE t.picture = a.picture AND t.look <> a.look))::BIGINT AS triples
        FROM {_LABELLED} a GROUP BY 1""",
    "look_averages": f"""SELECT round(avg(score) FILTER (look AND NOT picture), 9) AS same_look, round(avg(score) FILTER (picture AND NOT look), 9) AS same_picture,
        count(*) FILTER (look AND NOT picture) AS look_pairs, count(*) FILTER (picture AND NOT look) AS picture_pairs FROM {_PAIRS}""",
    "corpus_digest": "SELECT left(sha256(string_agg(sha256(name || p_name), '' ORDER BY name)), 16) AS digest FROM (SELECT lpad(p_partkey::VARCHAR, 6, '0') AS name, p_name FROM part)",
}
