"""Every operator and stage on tables with nulls in all columns, empty and very long texts, ties, repeats and clashing names, and on empty ones."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, counts, exact, language, lines, mixing, pii, quartile, simhash

LONG = "the river ran 1.2.3.4 through a+b@c.de " * 30_000
TEXTS = [None, "", " \n\t", "one line of text here", "one line of text here", "one  line of text here", "one line of text hers", "zwei Zeilen\nund noch eine", "a", "😀 漢字", LONG, LONG]
#: Names that operators add or use inside, in any case, and names with dots and quotes.
CLASHES = ["n.tokens", "Score", "lang_pred", "fp", "ROOT", "row", "line", "text.x", "_row_locator", "n_bytes", "Spans", "whole", "k0", "doc_id.x", "ids", "decoded", "_times", "key", "place"]


def table(spark, texts=TEXTS):
    rows = [(None if i % 5 == 4 else i // 2, t, None if i % 3 == 2 else "ende"[:2] if i % 2 else "de", None if i % 4 == 3 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    return made.select("*", *[F.lit(f"kept {n}").alias(n) for n in CLASHES])


def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


ADDED = {
    "bpe": (lambda d: bpe.encode(d, ranks(), public_tokenizers.PATTERN, digests=True), {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}),
    "counts": (lambda d: counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")), {"n_bytes", "n_tokens", "over_limit"}),
    "pii": (pii.find, {"base", "spans"}),
    "fingerprints": (quartile.fingerprints, {"fingerprint"}),
    "language": (language.identify, {"lang_pred", "score"}),
}
PER_ROW = {
    "mixing": lambda d: mixing.mix(d)[0],
    "simhash": lambda d: simhash.near_duplicates(d)[0],
    "similar": lambda d: simhash.similar(d)[0],
    "quartile": quartile.with_edits,
    "lines": lines.per_document,
    "exact": lambda d: exact.duplicates(d)[0],
}
ROWS = {"exact": exact.distinct_rows, "similar": simhash.one_of_each, "mixing": mixing.taken_rows}


@pytest.mark.parametrize("name", sorted(ADDED))
def test_operators_that_add_columns(spark, name):
    docs = table(spark)
    run, names = ADDED[name]
    found = run(docs)
    assert set(found.columns) - set(docs.columns) <= names
    rows = found.collect()
    assert len(rows) == len(TEXTS)
    for column in CLASHES:
        if column.lower() not in names:
            assert all(r[column] == f"kept {column}" for r in rows)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_operators_with_a_row_per_document(spark, name):
    docs = table(spark)
    assert PER_ROW[name](docs).count() == len(TEXTS)
    assert PER_ROW[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ROWS))
def test_operators_that_choose_rows(spark, name):
    docs = table(spark)
    found = ROWS[name](docs)
    assert found.columns == docs.columns
    assert all(r[c] == f"kept {c}" for r in found.collect() for c in CLASHES)
    assert ROWS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    docs = table(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, "")
    if name != "bpe":
        assert found.columns == docs.columns
        assert all(r[c] == f"kept {c}" for r in found.collect() for c in CLASHES)
    else:
        assert found.count() == len(TEXTS)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_ids_of_other_types(spark):
    rows = [("b", "x y z"), (None, "x y"), ("a", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert {r.doc_id for r in quartile.with_edits(docs).collect()} == {"a", "b", None}
    for run in PER_ROW.values():
        assert run(docs).count() == 3
