"""Scoring (M9, M11, M17, M18, P7) as column arithmetic and bounded joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import predicates as P
from ..functions import vocab
from .joins import broadcast_if_small

KEY = "package_id"


def heuristic_score(named: DataFrame, key: str = KEY, rules=vocab.HEURISTIC_RULES,
                    bias: float = vocab.HEURISTIC_BIAS, threshold: float = vocab.VERDICT_THRESHOLD) -> DataFrame:
    """M9 + P7: sum of weight x feature over rules whose feature is > 0, minus 2.2,
    through the sigmoid; reasons in rule order. Pure projection, no shuffle."""
    score = F.lit(0.0)
    reasons = []
    for feat, weight, reason in rules:
        v = F.coalesce(F.col(feat).cast("double"), F.lit(0.0))
        score = score + F.when(v > 0, v * F.lit(weight)).otherwise(F.lit(0.0))
        reasons.append(F.when(v > 0, F.lit(reason)))
    prob = N.sigmoid(score + F.lit(bias))
    return named.select(
        key, score.alias("rule_score"), prob.alias("probability"),
        P.verdict(prob, threshold).alias("prediction"),
        F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def logistic_score(features_long: DataFrame, weights: DataFrame, bias: float, key: str = KEY,
                   packages: DataFrame | None = None, threshold: float = vocab.VERDICT_THRESHOLD) -> DataFrame:
    """M11 (+J4): ``sigmoid(bias + sum(w * x))`` over the model vocabulary.

    ``weights(feature, weight)`` is bounded by the vocabulary; its size is
    checked before broadcast. Packages with no vocabulary feature score
    ``sigmoid(bias)`` when ``packages`` is given.
    """
    w = broadcast_if_small(weights.select("feature", "weight"))
    dots = features_long.join(w, "feature").groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("_dot"))
    if packages is not None:
        dots = packages.select(key).distinct().join(dots, key, "left")
    z = F.lit(float(bias)) + F.coalesce("_dot", F.lit(0.0))
    prob = N.sigmoid(z)
    return dots.select(key, z.alias("logit"), prob.alias("probability"), P.verdict(prob, threshold).alias("prediction"))


def channel_attention(views: DataFrame, key: str = KEY, order=vocab.VIEW_ORDER) -> DataFrame:
    """energy = L2 norm of each view vector; softmax over the three views.

    ``views(package_id, view, vector)`` -> ``(package_id, e_metadata, e_code, e_graph,
    attention ARRAY<DOUBLE>)``. One row per package after a grouped pivot on a fixed list.
    """
    e = views.select(key, "view", N.l2_norm("vector").alias("energy"))
    p = e.groupBy(key).agg(*[F.max(F.when(F.col("view") == v, F.col("energy"))).alias(f"e_{v}") for v in order])
    cols = [F.coalesce(F.col(f"e_{v}"), F.lit(0.0)) for v in order]
    return p.select(key, *[c.alias(f"e_{v}") for c, v in zip(cols, order)], N.softmax3(*cols).alias("attention"))


def fused_score(named: DataFrame, attention: DataFrame, key: str = KEY, threshold: float = vocab.VERDICT_THRESHOLD) -> DataFrame:
    """0.40 x rule probability + attention-weighted sigmoid view signals, clamped to [0, 1].

    Adds the attention sentence to the rule reasons.
    """
    base = heuristic_score(named, key)
    j = base.join(named, key).join(attention.select(key, "attention"), key, "left")
    att = F.coalesce(F.col("attention"), F.array(*[F.lit(1.0 / 3.0)] * 3))
    fused = F.lit(vocab.FUSED_BASE_WEIGHT) * F.col("probability")
    for i, (_view, w, slope, feats) in enumerate(vocab.FUSED_VIEW_TERMS):
        signal = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in feats[1:]), F.coalesce(F.col(feats[0]), F.lit(0.0)))
        fused = fused + F.lit(w) * att[i] * N.sigmoid(F.lit(slope) * signal)
    fused = F.least(F.greatest(fused, F.lit(0.0)), F.lit(1.0))
    note = F.format_string("channel attention weights metadata/code/graph = %.2f/%.2f/%.2f", att[0], att[1], att[2])
    return j.select(key, F.col("probability").alias("rule_probability"), fused.alias("probability"),
                    P.verdict(fused, threshold).alias("prediction"), att.alias("attention"),
                    F.concat(F.col("reasons"), F.array(note)).alias("reasons"))
