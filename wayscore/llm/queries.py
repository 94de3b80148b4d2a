"""The training-data operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.llm import html, minhash, mixing, outliers, packing, quality, repair, rollup, scoring, secret_spans, trie, urls, vectors
from wayscore.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digested(packing.pack(_table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.counterparts(urls.seed_labels(pages, held_out=False)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts every document, deletes those labelled as poor, revises the rest to a newer tokenizer; each batch is sent twice."""
    docs = _table(spark, sf_dir, "documents")
    poor = _table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    counts = written(rollup.all_counts(docs), "counts")  # texts are read once for all batches
    first, second = rollup.of_version(counts, "words-1"), rollup.of_version(counts, "words-2")
    ledger = rollup.fresh_ledger(spark, "op8")
    spanish = F.col("lang") == "es"
    batches = {
        "0-insert": rollup.signed(first, 1),
        "1-delete": rollup.signed(first.join(poor, "doc_id", "left_semi"), -1),
        "2-revise": rollup.revised(*(x.join(poor, "doc_id", "left_anti").where(~F.coalesce(spanish, F.lit(False))) for x in (first, second))),
    }
    for name, deltas in batches.items():
        ledger.commit(name, deltas)
        ledger.commit(name, deltas)
    return ledger.totals()


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults are put in by the hash of conversation and turn, then repaired."""
    turns = repair.damaged(_table(spark, sf_dir, "conversations"))
    return repair.repair_report(turns, F.col("gone"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.digested(secret_spans.secret_spans(_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with turns of the first one in twenty."""
    return trie.prefix_trie(*trie.regrafted(written(trie.numbered(_table(spark, sf_dir, "conversations")), "numbered")))


OPS = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_mixing, op3_embedding_dedup, op4_packing, op5_lm_scoring, op6_quality_rules, op7_url_filter, op8_token_counts, op9_html_text, op10_quality_classifier, op11_conversation_repair, op12_secret_scan, op13_prefix_trie)
}


def queries() -> dict:
    import corpus_pipeline

    return {**OPS, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    words2 = r"[\p{L}\p{M}]+|[0-9]+|[^\p{L}\p{M}0-9\s]"
    rows = """
        WITH poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
        counted AS (
            SELECT source, lang, d.doc_id, strlen(coalesce(text, '')) AS bytes,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words1,
                   len(regexp_extract_all(coalesce(text, ''), '%s')) AS words2
            FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM poor))
        SELECT source, lang, CASE WHEN lang = 'es' THEN 'words-1' ELSE 'words-2' END AS tokenizer,
               count(*)::BIGINT AS docs, sum(CASE WHEN lang = 'es' THEN words1 ELSE words2 END)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes
        FROM counted GROUP BY ALL""" % words2
    return {"op8_token_counts": rows}
