import random

from orrery.llm import simhash

DOCS = "doc_id long, text string"


def texts(count):
    draw = random.Random(4)
    return [" ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(count)]


def kept(spark, rows):
    found = simhash.one_of_each(spark.createDataFrame(rows, DOCS).coalesce(2))
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in found.collect())


def test_null_ids_keep_one_row_of_each_component(spark):
    a, b, c = texts(3)
    assert kept(spark, [(None, a), (None, b), (None, a), (None, c), (7, c)]) == sorted([(-1, a), (-1, b), (7, c)])


def test_repeated_ids_keep_one_row_of_each_component(spark):
    a, b, c = texts(3)
    assert kept(spark, [(1, a), (1, b), (1, a), (2, b), (1, c)]) == sorted([(1, a), (1, b), (1, c)])
