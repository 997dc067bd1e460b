"""Per-package report (M20, A12, F16) and the JSON sink form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import predicates as P
from ..functions import vocab
from . import ranking as R

KEY = "package_id"


def _top_list(counts: DataFrame, k: int, alias: str, where=None, key: str = KEY) -> DataFrame:
    c = counts if where is None else counts.where(where)
    top = R.top_k_names(c, k, key)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "cnt"))),
                                            lambda x: F.struct(x["name"].alias("name"), x["cnt"].alias("cnt"))).alias(alias))


def build_report(scores: DataFrame, counts: DataFrame, api_counts: DataFrame, import_counts: DataFrame,
                 metadata_map: DataFrame, facts: DataFrame, snippets: DataFrame, key: str = KEY,
                 attention: DataFrame | None = None, encoders: str = "hashed") -> DataFrame:
    """One report row per package.

    ``scores(package_id, probability, prediction, reasons)``; ``counts`` from A12.
    Lists are bounded (top 15 / 20, first 10 errors, first 5 snippets) and built
    with windowed top-k before ``collect_list``. With ``attention`` (fused mode) the report
    also has ``mode``, ``encoders``, ``feature_matrix_shape`` and ``channel_attention``.
    """
    errs = R.first_n_per_group(facts.where(F.col("kind") == "error").select(key, "path", "seq", "value"), 10,
                               ["path", "seq"], key)
    errs = errs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "value"))),
                                             lambda x: x["value"]).alias("analysis_errors"))
    snips = R.first_n_per_group(snippets.select(key, "path", "snippet_seq", "text"), 5, ["path", "snippet_seq"], key)
    snips = snips.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "text"))), lambda x: x["text"]).alias("snippets"))
    rep = (scores.join(counts, key, "left")
                 .join(metadata_map, key, "left")
                 .join(_top_list(import_counts, 15, "top_imports"), key, "left")
                 .join(_top_list(import_counts, 20, "top_sensitive_imports", P.is_sensitive_import("name")), key, "left")
                 .join(_top_list(api_counts, 20, "top_sensitive_apis", P.is_sensitive_call("name")), key, "left")
                 .join(errs, key, "left").join(snips, key, "left"))
    fused = []
    if attention is not None:
        rep = rep.join(attention.select(key, F.col("attention").alias("_att")), key, "left")
        third = F.array(*[F.lit(1.0 / 3.0)] * len(vocab.VIEW_ORDER))
        weights = F.coalesce("_att", third)
        fused = [F.lit("fused").alias("mode"), F.lit(encoders).alias("encoders"),
                 F.array(F.lit(len(vocab.VIEW_ORDER)), F.lit(vocab.EMBED_DIM)).alias("feature_matrix_shape"),
                 F.create_map(*[x for i, v in enumerate(vocab.VIEW_ORDER) for x in (F.lit(v), N.round_prob(weights[i], 4))]).alias("channel_attention")]
    empty_list = F.array().cast("array<struct<name:string,cnt:bigint>>")
    return rep.select(
        F.col(key).alias("input"), "prediction",
        N.round_prob("probability", 4).alias("malicious_probability"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        "counts",
        F.coalesce("top_imports", empty_list).alias("top_imports"),
        F.coalesce("top_sensitive_imports", empty_list).alias("top_sensitive_imports"),
        F.coalesce("top_sensitive_apis", empty_list).alias("top_sensitive_apis"),
        "reasons",
        F.coalesce("analysis_errors", F.array().cast("array<string>")).alias("analysis_errors"),
        F.coalesce("snippets", F.array().cast("array<string>")).alias("snippets"), *fused)


def report_json(reports: DataFrame) -> DataFrame:
    """F16: one JSON document per package."""
    return reports.select("input", F.to_json(F.struct(*reports.columns)).alias("report"))


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines reports, one file per task (nothing passes through the driver)."""
    reports.write.mode(mode).json(path)
