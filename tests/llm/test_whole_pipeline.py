import hashlib

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import tiktoken

from orrery.llm import bpe, language
from orrery.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_each_stage_against_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, given = Scratch(spark, "pipeline-test"), docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = scratch.table(stage(spark, given, SF), name)
        kept[name] = (given.collect(), found.collect())
        given = found
    before, after = kept["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    before, after = kept["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = kept["simhash_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    ids = sorted(sets)
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :]}
    stays = {r.doc_id for r in after}
    near = {b for (a, b), s in like.items() if s >= 0.8}
    far = {i for i in ids if all(s < 0.55 for pair, s in like.items() if i in pair)}
    assert len(near & stays) <= 0.1 * len(near) and far <= stays
    before, after = kept["mixing"]
    sizes = {r.doc_id: len((r.text or "").split()) for r in before}
    taken = [r.doc_id for r in after]
    assert set(taken) <= sizes.keys() and max(map(taken.count, taken)) <= 3
    assert 0 <= sum(sizes.values()) - sum(sizes[i] for i in taken) <= max(sizes.values())
    before, after = kept["bpe"]
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    for r in after:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_agrees_with_its_stages_and_itself(spark):
    one, two = (sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert one == two and len(one) > 100
    assert language.NONE not in {r.source for r in corpus_pipeline.run(spark, SF).select("source").collect()}


def test_batches_to_python_are_small_unless_the_session_has_its_own_bound(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def most(session, setting):
        if setting:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", setting)
        docs = session.range(3000).repartition(1).selectExpr("id AS doc_id", "'a' AS source", "'en' AS lang", "repeat('word ', 2000) AS text")
        corpus_pipeline.encoding_stage(session, docs, SF)
        return max(r.n for r in docs.mapInArrow(sizes, "n long").collect())

    assert most(spark.newSession(), "") < 6 << 20
    assert 6 << 20 < most(spark.newSession(), "16m") < 20 << 20
