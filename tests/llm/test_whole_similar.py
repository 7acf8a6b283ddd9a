import random

import numpy as np
import pytest

from orrery.llm import simhash

DOCS = "doc_id long, text string"


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def prints(draw, groups, each, flips):
    out = []
    for _ in range(groups):
        base = draw.integers(0, 2, 64 * simhash.WIDE).astype(np.uint8)
        for _ in range(each):
            changed = base.copy()
            changed[draw.choice(len(base), draw.integers(0, flips), replace=False)] ^= 1
            out.append(np.packbits(changed, bitorder="little").view(np.uint64))
    return np.unique(np.stack(out), axis=0)


def linked(rows, radius):
    bits = np.unpackbits(rows.view(np.uint8), axis=1)
    far = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    names = [r.tobytes() for r in rows]
    return names, [(names[i], names[j]) for i, j in zip(*np.nonzero(far <= radius), strict=True) if i < j]


def test_small_blocks_side_by_side_against_all_pairs():
    draw, radius = np.random.default_rng(1), simhash.radius_for(0.8)
    blocks = [prints(draw, groups, each, 40) for groups, each in ((1, 2), (2, 3), (5, 5), (3, 20), (30, 2), (1, 40))]
    edges = simhash._small_forests(blocks, radius)
    for rows in blocks:
        names, expected = linked(rows, radius)
        assert components(names, [e for e in edges if e[0] in names]) == components(names, expected)


@pytest.mark.parametrize(("groups", "each", "flips"), [(1, 300, 30), (40, 8, 40), (200, 1, 1), (3, 90, 60)])
def test_large_blocks_against_all_pairs(groups, each, flips):
    radius = simhash.radius_for(0.8)
    rows = prints(np.random.default_rng(groups), groups, each, flips)
    np.random.default_rng(0).shuffle(rows)
    names, expected = linked(rows, radius)
    assert components(names, simhash._large_forest(rows, len(rows), radius)) == components(names, expected)
    half = len(rows) // 2
    across = simhash._large_forest(rows, half, radius)
    first = set(names[:half])
    assert components(names, across) == components(names, [e for e in expected if e[0] in first or e[1] in first])


def corpus(draw, originals=30):
    """Texts of 120 words, copies with single words replaced, and others that share half with one."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, of = [], []
    for n in range(originals):
        words = [word() for _ in range(120)]
        rows.append(" ".join(words))
        of.append(n)
        for _ in range(draw.randint(0, 3)):
            changed = list(words)
            changed[draw.randrange(120)] = word()
            rows.append(" ".join(changed))
            of.append(n)
        rows.append(" ".join(words[:60] + [word() for _ in range(60)]))
        of.append(1000 + n)
    return rows, of


@pytest.mark.parametrize("block", [4096, 2])
def test_near_copies_are_caught_and_other_texts_left_alone(spark, block):
    rows, of = corpus(random.Random(3))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], DOCS + ", `ROOT.fp` string").coalesce(3)
    stays = sorted(r.doc_id for r in simhash.one_of_each(table, block=block).collect())
    assert stays == sorted({n: i for i, n in reversed(list(enumerate(of)))}.values())


def test_empty_and_null_texts_are_one_component(spark):
    rows = [(4, None), (3, ""), (9, " \n "), (7, "one two"), (8, "one  two"), (None, "one three")]
    stays = simhash.one_of_each(spark.createDataFrame(rows, DOCS).coalesce(1))
    assert sorted(r.doc_id or 0 for r in stays.collect()) == [0, 3, 7] and stays.columns == ["doc_id", "text"]
    assert simhash.one_of_each(stays.limit(0)).count() == 0


def test_recall_by_similarity():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    radius, hits, n = simhash.radius_for(0.8), {0.8: 0, 0.55: 0}, 60
    for target in hits:
        for _ in range(n):
            words = [word() for _ in range(200)]
            shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            changed, own = list(words), shingles(words)
            while True:
                trial = list(changed)
                trial[draw.randrange(200)] = word()
                both = shingles(trial)
                if len(own & both) / len(own | both) < target:
                    break
                changed = trial
            (a, keys), (b, others) = (simhash.wide_print(" ".join(w), 5) for w in (words, changed))
            apart = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            hits[target] += bool(set(keys) & set(others)) and apart <= radius
    assert hits[0.8] >= 0.85 * n and hits[0.55] <= 0.1 * n


def test_keys_grow_with_the_table():
    assert [simhash.bands_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]
