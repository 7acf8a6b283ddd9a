import itertools
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.llm import audit, queries

SF = "/root/testdata/sf0.01"
WORDS = r"[^\x20\x09-\x0D]+"


def test_op13_against_sql(spark):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine, other = queries.op13_audit(spark, SF).toPandas(), db.sql(queries.ORACLE_SQL["op13_audit"]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    mine, other = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, other))
    pd.testing.assert_frame_equal(mine, other)


def expected(docs, labels):
    """The measures by applying every order to every document."""
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    found, failed = Counter(), []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(WORDS, text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        failed.append((source or "", fails, doc_id))
    parts = {p for p, _, _ in failed}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in parts:
            for step in range(5):
                found[part, order, step + 1, "kept"] += 0
        for part, fails, doc_id in failed:
            gone = False
            for step, letter in enumerate(order, 1):
                here = letter in fails
                at = part, order, step
                found[*at, "removed"] += here and not gone
                found[*at, "redundant"] += here and gone
                found[*at, "unique_fails"] += fails == letter
                found[*at, "good_lost"] += here and not gone and doc_id in good
                found[*at, "toxic_lost"] += here and not gone and doc_id in toxic
                found["all", part, letter] += here and not gone
                gone = gone or here
                found[*at, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): (*(found[p, o, s, n] for n in names), found["all", p, o[s - 1]]) for p in parts for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6)}


def of(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


LONG = " ".join(f"w{i}" for i in range(40_000))
TEXTS = [None, "", "short", "short", "SHORT AND LOUD", LONG, LONG, LONG + " #", "same " * 300, "same " * 300, "$", "a b", "a  b", "é" * 50 + "X", " ".join(f"W{i}" for i in range(250)), "short"]
DOCS = [(None if i % 7 == 3 else i // 2, t, None if i % 3 == 2 else f"s{i % 2}") for i, t in enumerate(TEXTS)]
LABELS = [(0, 1, 0), (0, 0, 0), (1, None, 1), (3, 1, 1), (5, 0, None), (None, 1, 1), (99, 1, 1), (3, 1, 1)]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit("x").alias(n) for n in ("part", "mask", "digest", "least", "good", "docs", "step", "source.x")])
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("labelled", F.lit(1))


def test_odd_tables_against_every_order(spark):
    docs, labels = tables(spark)
    assert of(audit.audit(docs, labels)) == expected(DOCS, LABELS)
    assert of(audit.audit(docs)) == expected(DOCS, [])
    assert of(audit.audit(docs, labels.limit(0))) == expected(DOCS, [])
    assert audit.audit(docs.limit(0), labels).count() == 0


def test_other_filters_and_bounds(spark):
    docs, _ = tables(spark)
    found = audit.audit(docs, filters=lambda text: {"x": F.length(text) < 3, "y": text.startswith("s")}, repeats=None)
    assert {r.filter_order for r in found.collect()} == {"xy", "yx"}
    for filters in ({}, {c: F.lit(True) for c in "abcdefgh"}, {"long": F.lit(True)}):
        with pytest.raises(ValueError):
            audit.audit(docs, filters=lambda text, f=filters: f, repeats=None)


def test_parts_are_dealt_once_after_counting(spark):
    docs, labels = tables(spark)
    counted, letters = audit.cells(docs, labels)
    plan = audit.interactions(spark.createDataFrame([("p", 3, 1, 0, 0)], counted.schema), letters)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "RoundRobin" not in plan
