"""The registered queries of this subpackage and, where one exists, the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftledger.llm import ctw, decontam, html, jaccard, langid, merkle, mixing, negatives, pii, quality, substrings, urls, warc
from shiftledger.llm.common import table


def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")
    return pii.sanitise(docs.select("doc_id", "text")).select("doc_id", *names)


def op2_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_url_filters(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", *quality.RULES, "n_removed", "kept")


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op9_warc(spark, sf_dir):
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    about = F.col("metadata.fields")
    return found.select(
        about["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        about["refers-to-page"].cast("long").alias("refers_to"),
    )


def op10_lm_scoring(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("id") % 100 == 0)


def op12_merkle_manifest(spark, sf_dir):
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"))).drop("source", "steps")


def op13_substring_dedup(spark, sf_dir):
    return substrings.digest(substrings.remove(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}
