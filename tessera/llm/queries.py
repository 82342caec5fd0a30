"""The registered queries: thin, over whole tables, with the digest columns of their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, exact_topk, fill_middle, fingerprints, language_id, license_scan, packing, prefix_trie, simhash, suffix_dedup, token_counts, url_filter
from tessera.llm.common import table

TOKEN_LIMIT = 4096
#: Explicit URL rules: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page's url ends in the number of the document that it shows, whose labels are the page's
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    verdict = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow")
    labelled = shown.join(labels.select("doc_id", verdict.alias("verdict")), "doc_id").select("url", "verdict")
    return url_filter.filter_urls(pages, URL_RULES, labelled).drop("mined")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rollups(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edits(table(spark, sf_dir, "documents").select("doc_id", "text"), with_texts=False)
    shown = [fingerprints.to_hex(c).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("row.doc_id", "n_chars", "edited_sha256", *shown, "near_edited", "near_next")


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_license_scan, op3_decontaminate, op4_language_id, op5_exact_topk, op6_packing, op7_url_filter, op8_chat_format, op9_simhash, op10_suffix_dedup, op11_fill_middle, op12_prefix_trie, op13_fingerprints)
}
ORACLES: dict[str, str] = {"op8_chat_format": chat_format.RENDER_SQL, "op5_exact_topk": exact_topk.TOP_K_SQL, "op11_fill_middle": fill_middle.FILL_SQL, "op12_prefix_trie": prefix_trie.TRIE_SQL}
