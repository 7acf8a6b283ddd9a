import itertools
import random

from orrery.llm import lines

DOCS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def like(a, b):
    return a == b or (max(len(a), len(b)) >= lines.CHARACTERS_AN_EDIT and distance(a, b) <= 1)


def removed(spark, texts):
    gone, all_, _ = lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(2))
    return {(r.doc_id, r.line) for r in all_.join(gone, ["row", "line"]).collect()}


def expected(texts):
    flat = [(i, n, lines.normal(line)) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    return {(b[0], b[1]) for a, b in itertools.combinations(flat, 2) if b[2] and like(a[2], b[2])}


def test_short_lines_of_all_lengths_against_brute_force(spark):
    draw = random.Random(1)
    texts = ["\n".join("".join(draw.choice("ab ") for _ in range(draw.randint(0, 9))) for _ in range(5)) for _ in range(12)] + [None, "", "\n", " \t "]
    assert removed(spark, texts) == expected(texts)


def test_edited_lines_against_brute_force(spark):
    draw = random.Random(2)
    base = ["".join(draw.choice("abcdé ñ漢") for _ in range(n)) for n in (5, 8, 13, 30, 64, 200)]

    def edit(line):
        at, how = draw.randrange(len(line) + 1), draw.randrange(3)
        return line[:at] + (draw.choice("xyzä") if how else "") + line[at + (how < 2) :]

    texts = ["\n".join(edit(edit(b)) if draw.random() < 0.3 else edit(b) for b in draw.sample(base, 4)) for _ in range(25)]
    found = expected(texts)
    assert len(found) > 20 and removed(spark, texts) == found


def test_each_distinct_line_sends_few_variants():
    for n in (1, 3, 4, 50, 5_000):
        assert len(list(lines.blocks("x" * n))) <= 2 * lines.BLOCKS
    found = dict((role, hashes) for hashes, role in lines.variants("abcdefgh" * 500, {k if k < 1 << 63 else k - (1 << 64) for k, *_ in lines.blocks("abcdefgh" * 500)}))
    assert max(map(len, found.values())) <= 4000 / lines.BLOCKS + 1


def test_per_document(spark):
    rows = [(1, "same line here\nother line"), (2, "same line here"), (2, "same  line  hers\n\nnew one"), (None, "same line here"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    found = sorted(((r.doc_id or 0), r.n_lines, r.n_removed, r.kept_lines) for r in lines.per_document(docs).collect())
    assert found == [(0, 1, 1, []), (1, 2, 0, [0, 1]), (2, 1, 1, []), (2, 3, 1, [1, 2]), (5, 0, 0, []), (6, 1, 0, [0])]
    assert lines.per_document(docs.limit(0)).count() == 0
