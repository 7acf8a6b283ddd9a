"""Thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, counts, exact, language, lines, mixing, pieces, pii, quartile, repair, simhash, urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = mixing.mix(_documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, rules=RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_documents(spark, sf_dir))


def op7_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile.with_edits(_documents(spark, sf_dir))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.per_document(_documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language.identify(docs, keep=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = exact.duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair.summaries(rows, dropped="dropped").drop("made")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit.audit(_documents(spark, sf_dir), labels)


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_mixing, op3_simhash, op4_urls, op5_counts, op6_pii, op7_quartile, op8_lines, op9_language, op10_exact, op11_repair, op12_pieces, op13_audit)
}

ORACLE_SQL = {
    "op10_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
        checks AS (
            SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
                   regexp_matches(t, '[#$%&*|]') AS d,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
            FROM words),
        marked AS (
            SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
            FROM checks),
        fails AS (
            SELECT part, good, toxic, ([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                    CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END]).list_filter(lambda x: x IS NOT NULL) AS failed, count(*) AS n
            FROM marked GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
        placed AS (
            SELECT f.*, filter_order, step, list_contains(failed, filter_order[step]) AS here,
                   len(list_filter(failed, lambda x: instr(filter_order, x) < step)) > 0 AS gone
            FROM fails f, steps),
        found AS (
            SELECT part, filter_order, step,
                   coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (here AND len(failed) = 1), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (here AND NOT gone AND good), 0)::BIGINT AS good_lost,
                   coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
            FROM placed GROUP BY ALL)
        SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM found""",
}
