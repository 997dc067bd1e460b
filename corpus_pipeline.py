"""The corpus pipeline: documents to token ids, in five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars). Each works on all that the one before kept, on whole texts. Stages that call
counts or joins over the corpus count what they are given, not the first table.

Nulls and ties: a document without text fails the quality rules; of near-copies the least doc_id stays, null
last (of rows with that same doc_id the least text digest, of equal rows one); documents that are no near-copies all
stay, also under one doc_id or none; an empty table goes through as an empty table; columns that
``documents`` has besides the five are carried along as they are up to the last stage, also such as have the name of
a column that a stage makes for itself.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, chunkdedup, neardup, quality
from vigil.llm.common import bitmap, maybe_in, table, written
from vigil.llm.decontamination import contamination

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
NEAR = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = "carried"


def carrying(stage):
    """``stage`` on the five columns of ``documents``; all others, whatever their names, go along in one struct."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in COLUMNS]
        if not extra:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias(CARRIED))
        place = {c: F.col(CARRIED)[f"c{i}"].alias(c) for i, c in enumerate(extra)}
        return stage(spark, packed, sf_dir).select(*[place.get(c, c) for c in docs.columns])
    return run


@carrying
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


@carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, which share ``NEAR`` % of their shingles."""
    found = written(neardup.near_duplicates(docs, NEAR), "near").where("n_shingles > 0")
    # a root is a component; doc_ids are not, as rows may share one or have none
    first = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
             .select(F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")))
    rows = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    mark = F.when(F.col("first_key").isNull(), "gone").when(F.col("n") > 1, "again")
    marks = written(rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")), "left")
                    .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), mark.alias("__mark")).where("__mark is not null"), "marks")
    keyed = docs.withColumn("__text_key", F.md5(F.coalesce("text", F.lit("")))).withColumn("__both", F.xxhash64("doc_id", "__text_key"))
    known = maybe_in(keyed, "__both", bitmap(marks.select(F.xxhash64("__id", "__key").alias("__both")), "__both"), keep=True)
    left = known.where("__maybe").join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    # texts that surely have no mark, which are most, stay where they are
    out = left.where("__mark is null").unionByName(known.where("not __maybe"), allowMissingColumns=True)
    if not marks.where("__mark = 'again'").isEmpty():  # rows met twice, of which one stays
        out = out.unionByName(left.where("__mark = 'again'").dropDuplicates(["doc_id", "__text_key"]))
    return out.select(*docs.columns)


@carrying
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that an earlier document has; n_chars is that of the new text."""
    out = chunkdedup.deduplicate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


@carrying
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids and n_tokens of every document; the decoded ids give the text again."""
    out = bpe.encode_documents(docs.select(*COLUMNS), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    return (out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
