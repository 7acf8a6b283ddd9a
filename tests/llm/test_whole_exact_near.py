import random

import numpy as np
import pytest

from orrery.llm import simhash

DOCS = "doc_id long, text string"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def borderline(draw, families=12, each=16):
    """Families of texts of 150 words with 0 to 9 of them replaced, so that many pairs lie on either side of 0.8, and of chains."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(150)]
        for _ in range(each):
            changed = list(base)
            for at in draw.sample(range(150), draw.randint(0, 9)):
                changed[at] = word()
            rows.append(" ".join(changed))
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_no_texts_link_that_are_less_similar(spark, block):
    rows = borderline(random.Random(11))
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    # The brute force over all pairs: those that are similar, are candidates and so link.
    made = [simhash.wide_print(t, 5) for t in rows]
    bits = np.unpackbits(np.stack([np.frombuffer(f, np.uint8) for f, _ in made]), axis=1)
    radius, alike, candidates = simhash.radius_for(0.8), 0, 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                alike += 1
                if (bits[i] != bits[j]).sum() <= radius and set(made[i][1]) & set(made[j][1]):
                    candidates += 1
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    assert alike > 100 and candidates >= 0.97 * alike
    table = spark.createDataFrame(list(enumerate(rows)), DOCS).coalesce(2)
    stays = sorted(r.doc_id for r in simhash.one_of_each(table, block=block).collect())
    assert stays == sorted({root(i) for i in range(len(rows))})


def test_open_pairs_of_a_block():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2, 64 * simhash.WIDE).astype(np.uint8)
    rows = []
    for _ in range(70):
        changed = base.copy()
        changed[draw.choice(len(base), 6, replace=False)] ^= 1
        rows.append(np.packbits(changed, bitorder="little").view(np.uint64))
    rows = np.stack(rows)
    names = [r.tobytes() for r in rows]
    every = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert set(simhash._left_open(rows, None, [], 48, 100)) == every
    joined = [(names[0], n, True) for n in names[1:60]] + [(names[0], names[60], False)]
    left = simhash._left_open(rows, None, joined, 48, 100)
    first = set(names[:60])
    assert set(left) == {(a, b) for a, b in every if not (a in first and b in first)} - {(names[0], names[60])}
    assert all(sum(n in pair for pair in simhash._left_open(rows, None, joined, 48, 1)) >= 1 for n in names[60:])
    side = np.array([0] * 65 + [1] * 5)
    assert {(a, b) for a, b in every if a in names[:65] and b in names[65:]} == set(simhash._left_open(rows, side, [], 48, 100))
