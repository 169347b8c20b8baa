"""The registered queries of this subpackage: thin digests of each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolytics.llm import html, license, linededup, mixing, packing, setsketch, simhash, topk, toxicity, urlfilter
from annolytics.llm.tables import table


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to weights 1, 2, 3 by source, three epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by the trees."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages).select("page_id", "host", "path", "rule", "verdict", "margin")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text, of the text with its last third edited, and of the next document."""
    return simhash.compared(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("next_id")


def tokenizer_path() -> str:
    """The public tokenizer of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 2048 tokens at most."""
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of documents on sets of 4-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.near_duplicates(docs, k=4).drop("links")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without later near-duplicate lines: counts of lines, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_gone", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by its nearest labelled examples outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that the paragraphs of every document name."""
    found = license.documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_found", F.array_join("families", ",").alias("families"), "license", "probability")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": topk.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
}
