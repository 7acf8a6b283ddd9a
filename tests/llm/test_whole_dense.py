import os
import random

import numpy as np
import pytest

from orrery.llm import simhash
from orrery.llm.common import sifted
from orrery.scratch import Scratch

DOCS = "doc_id long, text string"


def dense(count=60, twins=12):
    """Texts of one original, two words replaced in each, so that most are just under 0.8 of one another; and twins of some."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    original, rows = [word() for _ in range(120)], []
    for n in range(count):
        words = list(original)
        for place in (5 + n, 118 - (n * 7) % 50):
            words[place] = word()
        rows.append(" ".join(words))
    return rows + [" ".join([word(), *text.split(" ")[1:]]) for text in rows[:twins]]


def linked(rows):
    sets = [simhash.shingle_set(text, 5) for text in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if simhash.likeness(sets[a], sets[b]) >= 0.8:
                old, new = parent[a], parent[b]
                parent = [min(old, new) if p in (old, new) else p for p in parent]
    return parent


@pytest.mark.parametrize("held", [simhash.HELD, 1000, 200])
def test_a_dense_group_is_compared_whole_and_no_pair_is_made(spark, tmp_path, held):
    rows = dense()
    table = spark.createDataFrame(list(enumerate(rows)), DOCS).coalesce(2)
    scratch = Scratch(spark, "dense", base=f"file://{tmp_path}")
    stays = sorted(r.doc_id for r in simhash.one_of_each(table, held=held, scratch=scratch).collect())
    assert stays == sorted(set(linked(rows)))
    if held == simhash.HELD:
        sizes = {name: spark.read.parquet(f"{tmp_path}/{name}").count() for name in os.listdir(tmp_path) if name not in ("groups", "linked")}
        assert max(sizes.values()) <= simhash.KEYS * len(rows), sizes


def test_linked_sets_against_all_pairs():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate((draw.choice(base, draw.integers(250, 400), replace=False), draw.integers(0, 1 << 62, 20)))) for _ in range(60)]
    sets += [np.zeros(1, np.int64), np.zeros(1, np.int64)]
    label = np.concatenate((np.arange(60) // 2, [40, 41]))
    for asked in (len(sets), 20):
        expected, found = np.arange(42), np.arange(42)
        for a in range(asked):
            for b in range(len(sets)):
                if simhash.likeness(sets[a], sets[b]) >= 0.8:
                    expected[expected == expected[label[b]]] = expected[label[a]]
        for a, b in simhash.linked_sets(sets, label, asked, 0.8):
            assert found[a] != found[b]
            found[found == found[b]] = found[a]
        assert [np.flatnonzero(found == f).min() for f in found] == [np.flatnonzero(expected == e).min() for e in expected]


def test_sifting_keeps_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(20_000).selectExpr("concat('0#', id) AS row", "id AS `a.b`")
    wanted = rows.where("`a.b` % 50 = 3").select("row")
    found = sifted(rows, "row", wanted)
    assert found.columns == rows.columns and found.join(wanted, "row").count() == 400 and found.count() < 4_000
    assert sifted(rows, "row", wanted.limit(0)).count() == 0
