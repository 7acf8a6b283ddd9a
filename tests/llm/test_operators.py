import random

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import counts, exact, language, mixing, pii, quartile, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ROW int"
ROWS = [(1, "a b c", "en", "s", 5, 0), (2, None, None, None, None, 1), (3, "a b c", "en", "s", 5, 2), (3, "a b c", "en", "s", 5, 3), (None, "", None, "t", 0, 4), (5, "x y", "en", "t", 3, 5)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).coalesce(2)


def test_exact_keeps_the_largest_id(spark):
    found, _ = exact.duplicates(docs(spark))
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in found.collect())
    assert rows == [(-1, 2, 2, False), (1, 3, 3, False), (2, 2, 2, True), (3, 3, 3, False), (3, 3, 3, True), (5, 5, 1, True)]
    assert exact.distinct_rows(docs(spark)).count() == 3


def test_exact_compares_bytes_when_digests_collide(spark):
    found, _ = exact.duplicates(docs(spark), digest=lambda text: F.lit("same"))
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size) for r in found.collect())
    assert rows == [(-1, 2, 2), (1, 3, 3), (2, 2, 2), (3, 3, 3), (3, 3, 3), (5, 5, 1)]


def test_exact_of_nothing(spark):
    assert exact.duplicates(docs(spark, []))[0].count() == 0


def test_mix_nears_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 4}", 0, 0) for i in range(2000)]
    found = mixing.mix(docs(spark, rows))[0].toPandas()
    by_target = found.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(by_target.taken - by_target.target) < 60).all()
    assert (found.taken <= 3 * found["size"]).all() and abs(found.taken.sum() - found["size"].sum()) < 60


def test_bit_sliced_comparison_is_exact():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 70, np.uint64)
    values = np.concatenate((base, base ^ np.uint64(7), base ^ np.uint64(15)))
    near = {(q, int(p)) for q, places in simhash.within(simhash.planes_of(values), values) for p in places if p < len(values)}
    assert near == {(a, b) for a in range(len(values)) for b in range(len(values)) if bin(int(values[a]) ^ int(values[b])).count("1") <= 3}


def test_piece_merging_counts_bytes_of_unknown_code_points():
    counter = counts.PieceCounter([("▁", -3.0), ("a", -4.0), ("b", -5.0), ("ab", -1.0), ("▁ab", -2.0)])
    assert [counter.count(t) for t in ("", "ab", "ab ab", "é", "aab")] == [0, 1, 2, 3, 3]


def test_url_parts_agree_with_python(spark):
    given = [None, "", "no scheme/x", "http://A.Example.ORG", "x://h/p?q#f", "x://h?q/p", "x://h/a\nb#c", "://É/É"]
    table = spark.createDataFrame([(u,) for u in given], "url string").select("url", *[c.alias(n) for c, n in zip(urls.parts(F.col("url")), ("host", "path"), strict=True)])
    assert all((r.host, r.path) == urls.split(r.url) for r in table.collect())


def test_equal_texts_are_alike_and_half_texts_less():
    a, b = "the quick brown fox " * 20, "zwölf Boxkämpfer jagen " * 20
    assert quartile.likeness(quartile.fingerprint(a), quartile.fingerprint(a)) == 1
    assert quartile.likeness(*map(quartile.fingerprint, (a, a[:300] + b[:100]))) >= quartile.likeness(*map(quartile.fingerprint, (a, b)))
    assert quartile.fingerprint(None) == quartile.fingerprint("")


def test_next_documents_by_descending_id(spark):
    found = {r.doc_id: r.near_next for r in quartile.with_edits(docs(spark)).collect()}
    assert len(found) == 5 and quartile.with_edits(docs(spark, [])).count() == 0


def test_base_spans():
    text = "a.b@c.de, 1.2.3.4 and 300.1.1.1; 4111 1111 1111 1111; +1 (743) 555-3824 x@y"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]


def test_gradients_of_the_network():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language.init(3).items()}
    windows, labels = draw.integers(0, 257, (4, 6)).astype(np.int16), np.array([0, 1, 2, 0])
    _, g = language.gradients(p, windows, labels)
    for name, at in (("u", (0, 1, 2)), ("n", (1, 2, 3)), ("w", (0, 1, 1)), ("x", (0, int(windows[0, 2]), 5))):
        change = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            change.append(language.gradients(q, windows, labels)[0])
        assert abs((change[0] - change[1]) / 2e-2 - g[name][at]) < 2e-3
