"""The operators of this folder, each applied to its whole table, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    decontamination, embedding_whitening, html_extraction, ngram_jaccard, preferences, pseudonyms,
    quality_classifier, quality_rules, secret_scan, source_mixing, spelling_variants, token_counts, url_filters,
)
from threadloom.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
#: The key of the catalogue's pseudonyms. A real run passes its own secret.
PSEUDONYM_KEY = "catalogue"

URL_RULES = [url_filters.Rule(*r) for r in (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its class and its number of links."""
    return ngram_jaccard.jaccard_join(documents(spark, sf)).select("doc_id", "class_id", "n_links", "set_size")


def op2(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf).select("doc_id", "text"), vocabulary_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3(spark: SparkSession, sf: str) -> DataFrame:
    mixed, _ = source_mixing.mix(documents(spark, sf), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    found = decontamination.contamination(docs, documents(spark, sf, "benchmark"))
    return found.select("doc_id", *decontamination.report(found))


def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    judged = quality_rules.quality_rules(docs, [c for c in docs.columns if c in ("doc_id", "lang", "source")])
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op6(spark: SparkSession, sf: str) -> DataFrame:
    return html_extraction.extracted(documents(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op7(spark: SparkSession, sf: str) -> DataFrame:
    scanned = secret_scan.secret_scan(documents(spark, sf).select("doc_id", "text"))
    return scanned.select("doc_id", *secret_scan.report(scanned))


def op8(spark: SparkSession, sf: str) -> DataFrame:
    out = pseudonyms.pseudonymised(documents(spark, sf).select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", *(f"n_{k}" for k in pseudonyms.COUNTED))


def op9(spark: SparkSession, sf: str) -> DataFrame:
    parts = preferences.preference_parts(preferences.neighbours(documents(spark, sf, "conversations")))
    spans = F.transform("loss_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    return parts.withColumn("loss_spans", F.array_join(spans, ","))


def op10(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.classified(documents(spark, sf), documents(spark, sf, "labels"))


def op11(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf))


def op12(spark: SparkSession, sf: str) -> DataFrame:
    made = embedding_whitening.whitened(documents(spark, sf, "embeddings").select("vec_id", "embedding"))
    whole = F.col("deviation").try_cast("long")
    return made.drop("embedding").withColumn("deviation", whole).select("vec_id", *embedding_whitening.RESULTS)


def op13(spark: SparkSession, sf: str) -> DataFrame:
    pages = url_filters.judged(documents(spark, sf, "pages"), URL_RULES)
    return pages.select("page_id", *url_filters.RESULTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1,
    "op2_token_counts": op2,
    "op3_source_mixing": op3,
    "op4_decontamination": op4,
    "op5_quality_rules": op5,
    "op6_html_extraction": op6,
    "op7_secret_scan": op7,
    "op8_pseudonyms": op8,
    "op9_preferences": op9,
    "op10_quality_classifier": op10,
    "op11_spelling_variants": op11,
    "op12_embedding_whitening": op12,
    "op13_url_filters": op13,
}
