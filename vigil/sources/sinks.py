"""Sinks: JSON reports (S8) and the logistic model file.

The model file is one JSON object ``{version, vocabulary, weights, bias,
threshold}`` with the vocabulary sorted; it is written and read by Spark
(the row is bounded by the vocabulary size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators.report import write_reports  # noqa: F401  (S8)
from ..operators.training import BIAS


def save_model(weights: DataFrame, path: str, threshold: float = vocab.VERDICT_THRESHOLD,
               mode: str = "overwrite", hash: str = "md5") -> None:
    """``(feature, weight)`` with a ``__bias__`` row -> one JSON model document, with the ``hash`` of its bucket names."""
    row = weights.agg(
        F.array_sort(F.collect_list(F.when(F.col("feature") != BIAS, F.struct("feature", "weight")))).alias("fw"),
        F.max(F.when(F.col("feature") == BIAS, F.col("weight"))).alias("bias"))
    doc = row.select(F.lit(vocab.MODEL_VERSION).alias("version"),
                     F.transform("fw", lambda x: x["feature"]).alias("vocabulary"),
                     F.transform("fw", lambda x: x["weight"]).alias("weights"),
                     F.coalesce("bias", F.lit(0.0)).alias("bias"),
                     F.lit(float(threshold)).alias("threshold"), F.lit(hash).alias("hash"))
    doc.coalesce(1).write.mode(mode).json(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Model file -> (``(feature, weight)`` incl. ``__bias__`` row, one-row ``(bias, threshold, hash)``).

    A missing threshold defaults to 0.5, a missing hash to ``blake2b``, that of the original models.
    """
    m = spark.read.json(path)
    if "hash" not in m.columns:
        m = m.withColumn("hash", F.lit("blake2b"))
    if "threshold" not in m.columns:
        m = m.withColumn("threshold", F.lit(vocab.VERDICT_THRESHOLD))
    fw = m.select(F.explode(F.arrays_zip(F.col("vocabulary").alias("feature"),
                                         F.col("weights").alias("weight"))).alias("z")) \
          .select(F.col("z.feature").alias("feature"), F.col("z.weight").cast("double").alias("weight"))
    bias = m.select(F.lit(BIAS).alias("feature"), F.col("bias").cast("double").alias("weight"))
    return fw.unionByName(bias), m.select(F.col("bias").cast("double").alias("bias"),
                                          F.col("threshold").cast("double").alias("threshold"), "hash")


def save_view_classifier(model, path: str, hash: str = "md5") -> None:
    """The trained network, and beside it its seed, its layers and the ``hash`` of its vectors' dimensions."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path.rstrip('/')}/network")
    about = [(int(model.getSeed()), [int(n) for n in model.getLayers()], hash, vocab.MODEL_VERSION)]
    spark.createDataFrame(about, "seed long, layers array<int>, hash string, version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/about")


def load_view_classifier(spark: SparkSession, path: str, hash: str = "md5"):
    """(the network, a dict of its seed, layers, hash and version). Another hash than ``hash`` is refused."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    about = spark.read.json(f"{path.rstrip('/')}/about").first().asDict()
    if about["hash"] != hash:
        raise ValueError(f"the model's dimensions are by {about['hash']}, the views by {hash}")
    return MultilayerPerceptronClassificationModel.load(f"{path.rstrip('/')}/network"), about
