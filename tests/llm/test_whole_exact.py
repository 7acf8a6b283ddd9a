from pyspark.sql import functions as F

from orrery.llm import exact
from orrery.scratch import Scratch

DOCS = "doc_id long, text string"


def seen(spark, rows, **settings):
    found, _ = exact.duplicates(spark.createDataFrame(rows, DOCS).coalesce(2), **settings)
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect())


def test_a_second_call_finds_the_digests_of_the_first(spark):
    state = Scratch(spark, "state").path("kept")
    assert seen(spark, [(1, "a"), (2, "b"), (3, "a")], state=state) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]
    assert seen(spark, [(0, "a"), (9, "b"), (5, None)], state=state) == [(0, 3, 3, False), (5, 5, 1, True), (9, 9, 2, True)]
    assert seen(spark, [(7, ""), (8, "c")], state=state) == [(7, 7, 2, True), (8, 8, 1, True)]


def test_bytes_are_compared_with_the_content_of_an_earlier_call(spark):
    state = Scratch(spark, "state").path("kept")
    weak = lambda text: F.length(text).cast("string")
    seen(spark, [(50, "one"), (51, "four")], state=state, digest=weak)
    assert seen(spark, [(1, "two"), (2, "one"), (3, "two")], state=state, digest=weak) == [(1, 3, 2, False), (2, 50, 2, False), (3, 3, 2, True)]


def test_batches_change_nothing(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None) for i in range(60)]
    assert seen(spark, rows, batches=1) == seen(spark, rows, batches=4)


def test_the_same_rows_given_again_change_nothing(spark):
    state = Scratch(spark, "state").path("kept")
    rows = [(1, "a"), (2, "b"), (3, "a")]
    once = seen(spark, rows, state=state)
    assert seen(spark, rows[::-1], state=state) == once == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]
    assert seen(spark, [(4, "a")], state=state, batch="x") == [(4, 4, 3, True)]
    assert seen(spark, [(4, "a")], state=state, batch="x") == [(4, 4, 3, True)]
    assert seen(spark, [], state=state) == []


def test_a_call_that_failed_half_way_counts_its_rows_once(spark, monkeypatch):
    state = Scratch(spark, "state").path("kept")
    rows = [(i, f"t{i % 3}") for i in range(12)]
    with monkeypatch.context() as patched:
        patched.setattr(exact, "_located", None)  # after the state has all rows
        try:
            seen(spark, rows, state=state)
        except TypeError:
            pass
        else:
            raise AssertionError("it should have failed")
    assert seen(spark, rows, state=state) == [(i, 9 + i % 3, 4, i > 8) for i in range(12)]


def test_collisions_across_calls(spark):
    """Each call's rows as if all rows so far had come together."""
    weak = lambda text: F.length(text).cast("string")
    state = Scratch(spark, "state").path("kept")
    calls = [[(1, "one"), (2, "two"), (3, "one"), (4, "four")], [(5, "two"), (6, "six"), (0, "one")], [(7, "five")], [(8, "one"), (9, "four")], [(10, "none"), (11, "none")]]
    so_far = []
    for rows in calls:
        so_far += rows
        for _ in range(2):
            found = seen(spark, rows, state=state, digest=weak)
            sizes = {t: [d for d, u in so_far if u == t] for _, t in rows}
            assert found == sorted((d, max(sizes[t]), len(sizes[t]), d == max(sizes[t])) for d, t in rows)
