import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from orrery.llm import pieces, queries

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", " a", "a ", "a  b", "▁", "▁▁a", "a▁b", "a ▁ b", "\n", "\n\n a\n", "<s> </s> <unk>", "<0x0A>", "é", "é", "漢字 漢", "🙂🙂", "\x00x\x01", "123 45.6", "(a) ## --- ****", "İstanbul ǅ ﬁ", "x" * 5000, "a\tb\r\nc", "‍ ‍", "word " * 3000, "—–" * 40]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def parts():
    model = pieces.read_model(MODEL)
    return pieces.Encoder(pieces.Segmenter(model), {}), pieces.Decoder(model)


def hexed(data):
    return hashlib.sha256(data).hexdigest()


def test_op12_against_the_library(spark, library):
    found = {r.doc_id: r for r in queries.op12_pieces(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode(text)
        expected = len(ids), hexed(",".join(map(str, ids)).encode()), hexed(library.decode(ids).encode())
        assert (found[doc_id].n_tokens, found[doc_id].ids_sha256, found[doc_id].decoded_sha256) == expected


def test_odd_texts_against_the_library(library, parts):
    encoder, decoder = parts
    draw = random.Random(9)
    marks = ["a", "the", " ", "  ", "▁", "\n", ".", "'s", "é", "漢", "🙂", "1", "__", "—", "ß", "\x00", "\t", "und", "A", "https://", "­"]
    texts = [t or "" for t in ODD] + ["".join(draw.choice(marks) for _ in range(draw.randint(0, 40))) for _ in range(600)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text), text
        assert decoder.decode(ids).decode() == library.decode(ids), text


def test_any_ids_decode_as_the_library_does(library, parts):
    draw = random.Random(3)
    for _ in range(800):
        ids = [draw.choice((draw.randrange(32000), draw.randrange(1, 300))) for _ in range(draw.randint(0, 12))]
        assert parts[1].decode(ids).decode() == library.decode(ids), ids


def test_each_repeated_chunk_is_in_the_table_once_and_right(spark, library):
    model = pieces.read_model(MODEL)
    docs = spark.createDataFrame([("the cat the dog",), ("the the cat, and so on\n",), (None,)], "text string")
    counted = {r.chunk: r.n for r in pieces.distinct_chunks(docs, model).collect()}
    assert counted["▁the"] == 4 and counted["▁cat"] == 2 and counted["▁dog"] == 1 and sum(counted.values()) == 12
    table = pieces.looked_up(pieces.chunk_table(docs, model), len(model.surfaces))
    assert set(table) == {"▁the", "▁cat"}
    assert list(table["▁the"]) == library.encode("the")


@pytest.mark.parametrize("most", [0, 200, 1 << 20])
def test_ids_do_not_depend_on_the_tables_bound(spark, library, most):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string").withColumns({n: F.lit("x") for n in ("n.tokens", "whole", "k0", "chunk", "N_TOKENS")})
    found = pieces.encode(docs, MODEL, most=most)
    assert {"n.tokens", "whole", "k0", "chunk"} <= set(found.columns)
    for row in found.collect():
        assert row.ids == library.encode((ODD * 2)[row.doc_id] or "")
        assert row.n_tokens == len(row.ids) and row.whole == "x"
    back = {r.doc_id: r.decoded for r in pieces.decode(found, MODEL).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t in enumerate(ODD))
    assert pieces.encode(docs.limit(0), MODEL, digests=True).count() == 0


def test_null_ids_decode_to_null(spark):
    rows = pieces.decode(spark.createDataFrame([(1, None), (2, [])], "a int, ids array<int>"), MODEL).collect()
    assert {r.a: r.decoded for r in rows} == {1: None, 2: ""}


def test_a_model_whose_pieces_cross_markers_gives_one_chunk():
    assert pieces.Segmenter._pattern({("a", pieces.SPACE)}) == ".+"
    assert pieces.Segmenter._pattern({("a", "!")}) != pieces.Segmenter._pattern({("a", "b")})
