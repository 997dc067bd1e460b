"""End-to-end scoring of a package corpus.

``package_files -> source_units -> code_facts (one Python stage, stored by kind)
-> features -> rules | logistic | fused scores -> reports``. Everything after
extraction is grouped / windowed / joined by ``package_id`` in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import counts as C
from ..operators import features as FE
from ..operators import joins as J
from ..operators import metadata as MD
from ..operators import report as RP
from ..operators import scoring as SC
from ..operators import training as TR
from ..operators import views as V
from ..operators.extract import extract_facts, fact_snippets, stored_facts
from ..session import checkpoint
from ..sources import files as S


def analyze_corpus(package_files: DataFrame, hash: str = "md5", external_edges: DataFrame | None = None,
                   block_counts: DataFrame | None = None, limits: dict | None = None) -> dict:
    """Facts, metadata and features of every package in ``package_files``.

    ``limits`` (all off by default) may set ``max_files``, ``max_bytes``, ``max_headers``, ``max_snippets``,
    ``top_words``, ``top_apis`` and ``top_imports``; files left out by them are ``error`` facts.
    """
    lim = dict(limits or {})
    facts = stored_facts(extract_facts(S.source_units(package_files, lim.get("max_files"), lim.get("max_bytes"))))
    meta = checkpoint(MD.coalesce_metadata(MD.extract_metadata(MD.metadata_candidates(
        package_files, max_headers=lim.get("max_headers"), max_files=lim.get("max_files"), max_bytes=lim.get("max_bytes")))))
    packages = checkpoint(package_files.select("package_id").distinct())
    edges, extra = None, None
    if external_edges is not None:
        edges, extra = J.merge_external_edges(C.edge_weights(facts).select("package_id", "src", "dst", "weight"),
                                              external_edges)
    out = FE.build_features(facts, meta, packages, snippets=fact_snippets(facts, lim.get("max_snippets")), hash=hash,
                            extra_api_counts=extra, edges=edges, block_counts=block_counts,
                            **{k: lim.get(k) for k in ("top_words", "top_apis", "top_imports")})
    out.update({"facts": facts, "metadata": meta, "packages": packages})
    return out


def score_corpus(package_files: DataFrame, mode: str = "rules", model: DataFrame | None = None,
                 hash: str = "md5", threshold: float = vocab.VERDICT_THRESHOLD,
                 external_edges: DataFrame | None = None, user_vectors: DataFrame | None = None,
                 block_counts: DataFrame | None = None, limits: dict | None = None,
                 model_hash: str | None = None) -> dict:
    """Score every package. ``mode`` is ``rules``, ``logistic`` (needs ``model``,
    a ``(feature, weight)`` table with a ``__bias__`` row) or ``fused``.

    Returns the analysis dict plus ``scores`` and ``reports``.
    """
    a = analyze_corpus(package_files, hash, external_edges, block_counts, limits)
    named = a["named"]
    if mode == "rules":
        scores = SC.heuristic_score(named, threshold=threshold)
    elif mode == "logistic":
        if model is None:
            raise ValueError("logistic mode needs a model")
        if model_hash is not None and model_hash != hash:
            raise ValueError(f"the model's buckets are by {model_hash}, the features by {hash}")
        weights, bias_df = TR.split_model(model)
        bias = bias_df.first()["bias"] if bias_df.count() else 0.0
        ls = SC.logistic_score(a["long"], weights, bias, packages=a["packages"], threshold=threshold)
        scores = ls.select("package_id", "probability", "prediction", F.array().cast("array<string>").alias("reasons"))
    elif mode == "fused":
        views = V.view_matrix(a["metadata"], a["snippets"], a["edges"], hash=hash)
        if user_vectors is not None:
            views = J.override_vectors(views, user_vectors).drop("overridden")
        views = checkpoint(views)
        att = SC.channel_attention(views)
        a["attention"] = att
        scores = SC.fused_score(named, att, threshold=threshold).select(
            "package_id", "probability", "prediction", "reasons", "attention")
        a["views"] = views
    else:
        raise ValueError(f"unknown mode {mode!r}")
    counts = C.evidence_counts(a["packages"], a["scalars"], a["totals"], a["graph"],
                               a["snippet_stats"].select("package_id", F.col("snippet_n").alias("snippet_count")))
    reports = RP.build_report(scores, counts, a["api_counts"], a["import_counts"], MD.metadata_map(a["metadata"]),
                              a["facts"], a["snippets"], attention=a.get("attention"))
    a.update({"scores": scores, "reports": reports})
    return a
