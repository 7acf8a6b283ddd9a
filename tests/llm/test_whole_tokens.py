import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from orrery.llm import bpe, counts, queries

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})


def hexed(data):
    return hashlib.sha256(data).hexdigest()


def test_op1_against_the_library(spark, library):
    found = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (found[doc_id].n_tokens, found[doc_id].ids_sha256) == (len(ids), hexed(" ".join(map(str, ids)).encode()))
        assert found[doc_id].decoded_sha256 == hexed(text.encode())


def test_ids_of_odd_texts_against_the_library(library):
    mine = bpe.ByteBpe(bpe.vocabulary(RANKS), public_tokenizers.PATTERN)
    assert mine.cut is bpe.CUT
    draw = random.Random(4)
    marks = ["<|endoftext|>", " ", "  ", "\n", "\r\n\r\n", " ", " ", "漢字", "é", "é", "🙂", "'s", "123456", "!!!", "\x00", "ab" * 50, "A", "ß", "‍"]
    for _ in range(400):
        text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))
        assert mine.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 300_000, " " * 300_000, "word " * 100_000, "\n" * 50_000 + "x", "aé漢!" * 70_000):
        assert mine.encode(text) == library.encode_ordinary(text) and mine.decode(mine.encode(text)) == text.encode()
    assert max(map(len, (*mine.memo, *mine.memo.old))) <= bpe.REMEMBERED


def test_patterns_that_cross_the_cuts_are_not_cut():
    over = r"[^\s]+\n?|\s+"
    mine = bpe.ByteBpe(bpe.vocabulary(RANKS), over)
    assert mine.cut is not bpe.CUT
    text = "ab\n cd " * 60_000
    assert mine.encode(text) == [i for t in regex.findall(over, text) for i in mine._pre_token(t)]


def test_the_hash_is_perfect_and_minimal():
    tokens = bpe.read_ranks(RANKS)
    found = bpe.PerfectHash(tokens)
    assert sorted(found.slots) == list(range(len(tokens)))
    assert all(found.get(t) == i for i, t in enumerate(tokens)) and found.get(b"\xff\xfe not there") == -1
    assert bpe.PerfectHash([]).get(b"a") == -1


def test_decoding(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    whole = bpe.decode(bpe.encode(rows, RANKS, public_tokenizers.PATTERN), RANKS)
    assert {r.doc_id: bytes(r.decoded) for r in whole.collect()} == {1: b"a b", 2: b"", 3: b""}
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing, RANKS).first().decoded is None


def test_op5_against_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in queries.op5_counts(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        n = len(model.encode(text))
        assert (found[doc_id].n_bytes, found[doc_id].n_tokens, found[doc_id].over_limit) == (len(text.encode()), n, n > 4096)


def test_counts_of_odd_texts_against_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mine = counts.PieceCounter(counts.read_pieces(path))
    draw = random.Random(6)
    marks = ["<s>", "</s>", "<unk>", " ", "   ", "\n", "\t", "▁", "漢字", "é", "é", "🙂", "123", "!!", " ", "xyz", "The", "<0x41>", "​"]
    for _ in range(400):
        text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))
        assert mine.count(text) == len(model.encode(text)), repr(text)
    for text in ("a" * 20_000, " " * 20_000, "ab " * 20_000, "\n" * 5_000):
        assert mine.count(text) == len(model.encode(text))


def test_a_worker_that_holds_an_encoder_reads_no_vocabulary_again():
    found = bpe.vocabulary(RANKS)
    mine = bpe.encoder(found.key, lambda: found, public_tokenizers.PATTERN)

    def never():
        raise AssertionError("read again")

    assert bpe.encoder(found.key, never, public_tokenizers.PATTERN) is mine
