"""Training (S7, U2, A11, M10, M19).

``logistic_train`` fits the logistic model either with ``pyspark.ml`` (L-BFGS,
same model family and L2 penalty, different optimiser than per-sample SGD) or
with distributed full-batch gradient descent written as DataFrame joins and
aggregations. The model is a ``(feature, weight)`` table (bounded by the
vocabulary: 40 named + 6 x 128 hashed keys) plus a bias.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import vocab
from ..session import checkpoint, ensure_checkpoint_dir, saved
from .features import vectorise, vocabulary
from .joins import DEFAULT_BROADCAST_BYTES

KEY = "package_id"
BIAS = "__bias__"


def label_packages(benign: DataFrame, malicious: DataFrame, key: str = KEY) -> DataFrame:
    """S7 + U2: tag two package sets 0 / 1; both labels must be present."""
    u = (benign.select(key).distinct().withColumn("label", F.lit(0))
         .unionByName(malicious.select(key).distinct().withColumn("label", F.lit(1))))
    n = u.agg(F.count_distinct("label").alias("n")).first()["n"]
    if n != 2:
        raise ValueError("training needs both benign and malicious packages")
    return u


#: Vocabularies up to so many features have their weights and gradients as numpy arrays (8 MB each).
LOCAL_FEATURES = 1 << 20


def gradient_descent(features_long: DataFrame, labels: DataFrame, epochs: int = vocab.LOGISTIC_EPOCHS,
                     lr: float = vocab.LOGISTIC_LR, l2: float = vocab.LOGISTIC_L2, key: str = KEY,
                     local_features: int = LOCAL_FEATURES) -> DataFrame:
    """M10 (full-batch variant): ``w -= lr * (mean(err * x) + l2 * w)``, bias unregularised. Starts from zero weights.

    The labelled packages are stored once as sparse vectors. An epoch is one map over them - Arrow batches as CSR
    blocks, one gradient for each task - and a sum by feature, which the driver gets: as many numbers as there are
    features. Nothing is joined, and a lost executor costs its tasks of one epoch. Vocabularies beyond
    ``local_features`` are trained by joins with a table of weights. Returns ``(feature, weight)`` with the bias as
    feature ``__bias__``.
    """
    spark = features_long.sparkSession
    lab = labels.select(key, F.col("label").cast("double").alias("y"))
    x = features_long.select(key, "feature", F.col("value").cast("double").alias("value")).where(F.col("value") != 0)
    x = saved(x.join(lab.select(key), key, "left_semi"), "features")
    voc = saved(vocabulary(x), "vocabulary")
    size = voc.count()
    if size > local_features:
        return _descent_by_joins(x.withColumnRenamed("value", "x"), lab, epochs, lr, l2, key)
    rows = lab.join(vectorise(x, voc, size, key), key, "left")
    rows = saved(rows.select("y", F.coalesce("features.indices", F.array().cast("array<int>")).alias("indices"),
                             F.coalesce("features.values", F.array().cast("array<double>")).alias("values")), "labelled")
    n, w, bias = max(rows.count(), 1), np.zeros(size), 0.0
    for _ in range(epochs):
        total = np.zeros(size + 1)
        for r in _gradient(rows, w, bias).collect():
            total[r["idx"]] = r["g"]
        w -= lr * (total[:size] / n + l2 * w)
        bias -= lr * total[size] / n
    names = {r["idx"]: r["feature"] for r in voc.collect()}
    return spark.createDataFrame([(names[i], float(v)) for i, v in enumerate(w)] + [(BIAS, float(bias))], "feature string, weight double")


def _gradient(rows: DataFrame, w: np.ndarray, bias: float) -> DataFrame:
    """``(idx, g)``: the sum of ``err * x`` for each feature that has one, and at ``len(w)`` that of ``err``."""
    def run(batches):
        total = np.zeros(len(w) + 1)
        for batch in batches:
            indices, values = batch.column("indices"), batch.column("values")
            at, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(indices.offsets.to_numpy()))
            z = np.bincount(row, value * w[at], batch.num_rows) + bias
            p = np.where(z < -50, 0.0, np.where(z > 50, 1.0, 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))))
            err = p - batch.column("y").to_numpy()
            total[:-1] += np.bincount(at, value * err[row], len(w))
            total[-1] += err.sum()
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], names=["idx", "g"])

    return rows.mapInArrow(run, "idx long, g double").groupBy("idx").agg(F.sum("g").alias("g"))


def _descent_by_joins(x: DataFrame, lab: DataFrame, epochs: int, lr: float, l2: float, key: str) -> DataFrame:
    """Every epoch is one join of the sparse features with the weights, a per-package sum, and a per-feature sum of
    ``err * x``; the new weights are checkpointed, so the plan stays that of one epoch."""
    x = checkpoint(x.unionByName(lab.select(key, F.lit(BIAS).alias("feature"), F.lit(1.0).alias("x"))).repartition(key))
    n = float(lab.count())
    w = x.select("feature").distinct().withColumn("weight", F.lit(0.0))
    w = checkpoint(w)
    small = w.agg(F.sum(F.length("feature") + 40).alias("b")).first()["b"] <= DEFAULT_BROADCAST_BYTES  # the keys never change
    for _ in range(epochs):
        wb = F.broadcast(w) if small else w
        dots = x.join(wb, "feature").groupBy(key).agg(F.sum(F.col("x") * F.col("weight")).alias("z"))
        err = lab.join(dots, key, "left").select(key, (N.sigmoid(F.coalesce("z", F.lit(0.0))) - F.col("y")).alias("err"))
        grad = x.join(err, key).groupBy("feature").agg((F.sum(F.col("err") * F.col("x")) / F.lit(n)).alias("g"))
        reg = F.when(F.col("feature") == BIAS, F.lit(0.0)).otherwise(F.lit(l2) * F.col("weight"))
        w = checkpoint(w.join(grad, "feature", "left").select(
            "feature", (F.col("weight") - F.lit(lr) * (F.coalesce("g", F.lit(0.0)) + reg)).alias("weight")))
    return w


def sparse_rows(rows: DataFrame, size: int) -> DataFrame:
    """``(label, features)`` for ``pyspark.ml`` from rows ``(label, indices, values)``: sparse vectors of ``size``.

    They are written and read in libsvm's text form, which Spark parses straight into sparse vectors, so no array is ever dense.
    """
    spark = rows.sparkSession
    cells = F.zip_with("indices", "values", lambda i, v: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/libsvm-{uuid.uuid4().hex}"
    rows.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(cells, " ")).alias("value")).write.text(path)
    return spark.read.format("libsvm").option("numFeatures", str(max(size, 1))).option("vectorType", "sparse").load(path)


def lbfgs_train(features_long: DataFrame, labels: DataFrame, epochs: int = vocab.LOGISTIC_EPOCHS,
                l2: float = vocab.LOGISTIC_L2, key: str = KEY) -> DataFrame:
    """M10 with ``pyspark.ml.classification.LogisticRegression`` on sparse vectors."""
    from pyspark.ml.classification import LogisticRegression

    lab = labels.select(key, F.col("label").cast("double").alias("label"))
    feats = saved(features_long.select(key, "feature", "value").join(lab.select(key), key, "left_semi"), "features")
    voc = saved(vocabulary(feats), "vocabulary")
    size = voc.count()
    rows = lab.join(vectorise(feats, voc, size, key), key, "left").select(
        "label", F.coalesce("features.indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("features.values", F.array().cast("array<double>")).alias("values"))
    model = LogisticRegression(maxIter=epochs, regParam=l2, elasticNetParam=0.0, standardization=False,
                               featuresCol="features", labelCol="label").fit(sparse_rows(rows, size))
    spark = features_long.sparkSession
    coef = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.coefficients.toArray())],
                                 "idx int, weight double")
    w = voc.join(coef, "idx").select("feature", "weight")
    return w.unionByName(spark.createDataFrame([(BIAS, float(model.intercept))], "feature string, weight double"))


def logistic_train(features_long: DataFrame, labels: DataFrame, method: str = "lbfgs", **kw) -> DataFrame:
    """``method="lbfgs"`` (pyspark.ml) or ``"gd"`` (DataFrame gradient descent)."""
    if method == "gd":
        return gradient_descent(features_long, labels, **kw)
    return lbfgs_train(features_long, labels, **kw)


def split_model(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(feature, weight)`` incl. bias row -> (weights without bias, one-row bias frame)."""
    return (weights.where(F.col("feature") != BIAS),
            weights.where(F.col("feature") == BIAS).select(F.col("weight").alias("bias")))


def view_rows(views: DataFrame, attention: DataFrame, packages: DataFrame, key: str = KEY) -> DataFrame:
    """``packages`` (any columns) with ``features``: the attention-weighted 3 x 768 view matrix, flattened.

    One join brings the three views of a package together; a missing view is zeros, a missing attention a third each.
    """
    from pyspark.ml.functions import array_to_vector

    zero = F.array_repeat(F.lit(0.0), vocab.EMBED_DIM)
    wide = views.groupBy(key).agg(*[
        F.max(F.when(F.col("view") == v, F.col("vector"))).alias(f"_v{i}") for i, v in enumerate(vocab.VIEW_ORDER)])
    j = packages.join(wide, key, "left").join(attention.select(key, F.col("attention").alias("_att")), key, "left")
    att = F.coalesce("_att", F.array(*[F.lit(1.0 / 3.0)] * 3))

    def scaled(k):
        weight = att[k]
        return F.transform(F.coalesce(f"_v{k}", zero), lambda x: x * weight)

    return j.select(*packages.columns, array_to_vector(F.concat(*[scaled(k) for k in range(3)])).alias("features"))


def train_view_classifier(views: DataFrame, attention: DataFrame, labels: DataFrame, key: str = KEY,
                          hidden: int = 16, max_iter: int = vocab.LOGISTIC_EPOCHS, seed: int = 7):
    """M19 (re-aimed): ``MultilayerPerceptronClassifier`` on the flattened, attention-weighted 3 x 768 view matrix of
    the labelled packages. Returns ``(model, scored DataFrame)``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    lab = labels.select(key, F.col("label").cast("double").alias("label"))
    data = view_rows(views, attention, lab, key)
    mlp = MultilayerPerceptronClassifier(layers=[len(vocab.VIEW_ORDER) * vocab.EMBED_DIM, hidden, 2], maxIter=max_iter, seed=seed)
    model = mlp.fit(data)
    return model, score_views(model, data, key)


def score_views(model, rows: DataFrame, key: str = KEY) -> DataFrame:
    """``rows`` of :func:`view_rows` with ``prediction`` and ``probability`` in place of the matrix."""
    from pyspark.ml.functions import vector_to_array

    keep = [c for c in rows.columns if c != "features"]
    return model.transform(rows).select(*keep, "prediction", vector_to_array("probability")[1].alias("probability"))
