"""Aggregations over ``code_facts``.

All aggregates are algebraic, so Spark runs them as partial (map-side) plus
final hash aggregation: a package holding a third of all facts is collapsed
inside every map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

KEY = "package_id"


def count_names(facts: DataFrame, kind: str, key: str = KEY) -> DataFrame:
    """A1: multiset of names of one fact kind per package.

    ``(package_id, name, cnt, first)`` where ``first = min(struct(path, seq))``
    keeps the first-occurrence order needed for ``Counter``-style tie-breaks.
    """
    return (facts.where(F.col("kind") == kind)
                 .groupBy(key, "name")
                 .agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("path", "seq")).alias("first")))


def edge_weights(facts: DataFrame, key: str = KEY) -> DataFrame:
    """A2: weighted call-graph edges ``(package_id, src, dst, weight)``.

    Calls give ``scope -> callee``; definitions give ``parent scope -> path:function``.
    """
    return (facts.where(F.col("kind").isin("call", "func"))
                 .groupBy(key, F.col("caller").alias("src"), F.col("name").alias("dst"))
                 .agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("path", "seq")).alias("first")))


def package_scalars(facts: DataFrame, key: str = KEY) -> DataFrame:
    """A4 + A5 + A7 in one pass over the facts.

    Files, parse errors, analysis errors, control-block totals, max nesting and
    the three string counters (high-entropy, URL-like, long).
    """
    kind = F.col("kind")
    is_str = kind == "string"
    # a snippet stands beside its call: without these rows, whose texts are most of the bytes, no package is missing
    return facts.where(kind.isNull() | (kind != "snippet")).groupBy(key).agg(
        F.count_if(kind == "file").alias("python_files"),
        F.count_if((kind == "file") & F.col("value").isNotNull()).alias("parse_errors"),
        F.count_if(kind == "error").alias("analysis_errors"),
        F.count_if(kind == "block").alias("cfg_nodes"),
        F.coalesce(F.sum(F.when(kind == "block", F.col("branch_edges"))), F.lit(0)).cast("bigint").alias("cfg_edges"),
        F.coalesce(F.max(F.when(kind == "block", F.col("nesting"))), F.lit(0)).cast("int").alias("max_nesting"),
        F.count_if(P.is_high_entropy_string(F.when(is_str, F.col("value")))).alias("high_entropy_strings"),
        F.count_if(is_str & P.is_url_string("value")).alias("url_strings"),
        F.count_if(is_str & P.is_long_string("value")).alias("long_strings"),
    )


def name_totals(api_counts: DataFrame, import_counts: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct and total APIs, sensitive APIs and sensitive imports per package.

    Inputs are A1 outputs, so the sensitivity tests run once per distinct name
    per package, never per call.
    """
    sens_api = P.is_sensitive_call("name")
    apis = api_counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("api_unique"),
        F.sum("cnt").cast("bigint").alias("api_total"),
        F.count_if(sens_api).alias("sensitive_api_unique"),
        F.coalesce(F.sum(F.when(sens_api, F.col("cnt"))), F.lit(0)).cast("bigint").alias("sensitive_api_total"))
    sens_imp = P.is_sensitive_import("name")
    imps = import_counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("import_unique"),
        F.sum("cnt").cast("bigint").alias("import_total"),
        F.count_if(sens_imp).alias("sensitive_import_unique"),
        F.coalesce(F.sum(F.when(sens_imp, F.col("cnt"))), F.lit(0)).cast("bigint").alias("sensitive_import_total"))
    return apis.join(imps, key, "full_outer")


COUNT_FIELDS = ("python_files", "parse_errors", "analysis_errors", "unique_api_calls", "call_graph_edges",
                "cfg_nodes", "cfg_edges", "snippets")


def evidence_counts(packages: DataFrame, scalars: DataFrame, totals: DataFrame, graph: DataFrame,
                    snippet_counts: DataFrame, key: str = KEY) -> DataFrame:
    """The eight report counts as one struct column ``counts``, zeros for packages without sources."""
    j = (packages.select(key).distinct().join(scalars, key, "left").join(totals.select(key, "api_unique"), key, "left")
                .join(graph.select(key, "graph_edges"), key, "left")
                .join(snippet_counts.select(key, "snippet_count"), key, "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select(key, F.struct(
        z("python_files").alias("python_files"), z("parse_errors").alias("parse_errors"),
        z("analysis_errors").alias("analysis_errors"), z("api_unique").alias("unique_api_calls"),
        z("graph_edges").alias("call_graph_edges"), z("cfg_nodes").alias("cfg_nodes"),
        z("cfg_edges").alias("cfg_edges"), z("snippet_count").alias("snippets")).alias("counts"))
