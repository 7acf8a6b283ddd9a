import random

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import pii


def added(texts, weights):
    graph, base = pii.Graph(), {}
    for i, text in enumerate(texts):
        base[i] = pii.base_spans(text)
        graph.add(i, text, base[i])
    return pii.added(graph, pii.beliefs(graph, weights)[0], base, texts)


def test_neighbours_are_linked_across_prose_and_documents_are_not():
    graph = pii.Graph()
    graph.add(0, "a1 with some prose between b2 c3", [])
    graph.add(1, "d4 and 212-555-0187 and later again (212) 555 0187", [])
    assert graph.chain == [(0, 1), (1, 2), (3, 4)] and graph.both == [(4, 5)] and graph.skip == []


def test_both_potentials_are_learnt():
    weights = pii.train(*pii.examples())
    assert np.abs(weights["chain"]).max() > 0.1 and np.abs(weights["skip"]).max() > 0.1


def prose(draw):
    return " ".join("".join(draw.choice("bcdfglmpuvy") for _ in range(draw.randint(3, 9))) for _ in range(draw.randint(6, 40)))


def scores(weights, docs=200, seed=991):
    """Recall of spoilt data and precision of added spans; other prose, other places and other numbers than those learnt from."""
    draw = random.Random(seed)
    hits = missed = false = 0
    for _ in range(docs):
        kind = draw.randrange(4)
        plain, spoilt, shared = pii.entity(draw, kind)
        ways = spoilt + shared
        put = [(plain, kind), *((v, kind) for v in draw.sample(ways, 2))] if draw.random() < 0.6 else [(draw.choice(spoilt), kind)] * 2
        put += [(pii.other(draw), pii.OTHER) for _ in range(4)]
        draw.shuffle(put)
        text, marks = "", []
        for value, k in put:
            text += prose(draw) + " "
            marks.append((len(text), len(text) + len(value), k))
            text += value + draw.choice(("; ", " ", ", "))
        base = pii.base_spans(text)
        more = added([text], weights).get(0, [])
        wanted = [(s, e, k) for s, e, k in marks if k < pii.OTHER and not any(a < e and s < b for _, a, b in base)]
        found = sum(any(k == kk and s < b and a < e for kk, a, b in more) for s, e, k in wanted)
        hits, missed = hits + found, missed + len(wanted) - found
        false += sum(not any(k == kk and s < b and a < e for s, e, k in marks) for kk, a, b in more)
    return hits / (hits + missed), hits / (hits + false)


def test_distant_repeats_of_spoilt_data_need_the_skip_links():
    weights = pii.train(*pii.examples())
    recall, precision = scores(weights)
    without, _ = scores({**weights, "skip": weights["skip"] * 0})
    assert recall >= 0.8 and precision >= 0.97 and recall > without + 0.1


def plain_ip(text):
    import re

    out = []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    return out


def test_ip_spans_equal_the_plain_pattern():
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice("0125..  x") for _ in range(draw.randint(0, 40)))
        assert [s for s in pii.base_spans(text) if s[0] == 1] == plain_ip(text)


def test_long_runs_take_linear_time_and_crash_nothing(spark):
    texts = ["0" * 5000 + ".1.1.1", "1" * 1_000_000, "1." * 200_000, "a@" * 100_000, "+1(" * 100_000, "@" * 200_000, None, "", "a b " * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sp.ans", F.lit(1)).withColumn("Base", F.lit(2))
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[0].base == "ip:0:5006" and found[6].base == found[7].base == found[6].spans == "" and found[0]["sp.ans"] == 1
    assert pii.find(docs.limit(0)).count() == 0


def test_recall_on_repeated_spoilt_data():
    weights = pii.train(*pii.examples())
    draw = random.Random(77)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    text = "The report names {0} and was read with care, then {0} came up, and at last {0} once more."
    phones = [text.format(f"{number(3)}-555-{number(4)}") for _ in range(100)]
    assert sum(k == 3 for spans in added(phones, weights).values() for k, _, _ in spans) >= 240
    for other in (lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: number(6), lambda: f"ab{number(2)}cd"):
        assert not added([text.format(other()) for _ in range(100)], weights)
