"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunkdedup, filteraudit, htmlblocks, licenses, lmscore, neardup, oracles, quality, resampling, suffixdedup, urlfilter
from .common import table
from .decontamination import contamination
from .sharding import shard_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS, SHARD_SEED = 8, 7
# The rules that op12 judges by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_sharding", oracles.sharding(SHARDS, SHARD_SEED))
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards 0..7 by the permutation of their numbers in order of doc_id; law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shard_rows(rows, SHARDS, ["doc_id", "size", "text_crc32"], SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")


@register("op2_decontamination", oracles.decontamination())
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of ten words of the benchmark items."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the classifier on every document; not SQL: tested against brute force and held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@register("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; not SQL: tested against the tokenizer library and by round trip."""
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


@register("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 85 % of their five-word shingles; not SQL at this size: tested against brute force."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), 85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks that an earlier one has; not SQL: tested against a sequential version."""
    return chunkdedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; not SQL at this size: tested against brute force."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", F.pmod(
        F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(5)).alias("fold"))
    out = lmscore.log_scores(docs)
    return out.withColumnRenamed("row_id", "doc_id")


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 200-byte strings; not SQL at this size: tested against brute force."""
    return suffixdedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "kept")


@register("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; not SQL: tested against the known layout and on made-up ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlblocks.extract(pages, htmlblocks.train(pages)).select("page_id", "url", "text", "n_chars")


@register("op6_license_scan", oracles.license_scan())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices among all documents."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "canonical_sha256", "license_id", "notices", "n_notices")


@register("op11_filter_audit", oracles.filter_audit())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters under all their orders, over all documents, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filteraudit.audit(docs, table(spark, sf_dir, "labels"))


@register("op12_url_filters", oracles.url_filters(URL_RULES))
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of ``URL_RULES`` on the URL of every page; pages that no rule fits are allowed."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@register("op13_resampling", oracles.resampling())
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn towards the benchmark's words and word pairs."""
    out = resampling.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
