"""Training on sparse vectors, the stored view classifier, line frames in long files, external block counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import features as FE
from vigil.operators import joins as J
from vigil.operators import ranking as R
from vigil.operators import training as TR


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(120):
        y = i % 2
        labels.append((f"p{i}", y))
        for f in rng.sample(range(12), 0 if i == 7 else rng.randrange(1, 9)):
            rows.append((f"p{i}", f"f{f:02d}", rng.random() + (0.8 if y and f < 4 else 0.0)))
    rows += [("p0", "f99", 0.0), ("unlabelled", "f50", 3.0)]
    return rows, labels, spark.createDataFrame(rows, "package_id string, feature string, value double"), spark.createDataFrame(labels, "package_id string, label int")


def numpy_descent(rows, labels, epochs, lr, l2):
    own = {p for p, _ in labels}
    names = sorted({f for p, f, v in rows if p in own and v})
    x = np.zeros((len(labels), len(names)))
    at = {p: i for i, (p, _) in enumerate(labels)}
    for p, f, v in rows:
        if p in own and v:
            x[at[p], names.index(f)] = v
    y, w, b = np.array([l for _, l in labels], float), np.zeros(len(names)), 0.0
    for _ in range(epochs):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - lr * (x.T @ err / len(y) + l2 * w), b - lr * err.mean()
    return dict(zip(names, w)) | {TR.BIAS: b}


@pytest.mark.parametrize("epochs, local", [(80, 1 << 20), (4, 0)])
def test_gradient_descent_is_that_of_numpy(labelled, epochs, local):
    rows, labels, x, lab = labelled
    got = {r["feature"]: r["weight"] for r in TR.gradient_descent(x, lab, epochs=epochs, lr=0.5, l2=0.01, local_features=local).collect()}
    want = numpy_descent(rows, labels, epochs, 0.5, 0.01)
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_no_features_at_all(spark, labelled):
    _, _, x, lab = labelled
    (r,) = TR.gradient_descent(x.limit(0), lab, epochs=3).collect()
    assert r["feature"] == TR.BIAS


def test_sparse_vectors_and_lbfgs(labelled):
    rows, labels, x, lab = labelled
    own = x.join(lab.select("package_id"), "package_id", "left_semi")
    voc = FE.vocabulary(own)
    size = voc.count()
    vectors = FE.vectorise(own, voc, size).select("package_id", "features", FE.dense_vector("features").alias("dense")).collect()
    names = [r["feature"] for r in voc.orderBy("idx").collect()]
    for r in vectors:
        want = {f: v for p, f, v in rows if p == r["package_id"] and v}
        assert r["features"]["size"] == size and dict(zip([names[i] for i in r["features"]["indices"]], r["features"]["values"])) == want
        assert r["dense"] == [want.get(f, 0.0) for f in names]
    model = TR.lbfgs_train(x, lab, epochs=100, l2=0.001)
    w = {r["feature"]: r["weight"] for r in model.collect()}
    scores = {p: w[TR.BIAS] for p, _ in labels}
    for p, f, v in rows:
        if p in scores:
            scores[p] += w.get(f, 0.0) * v
    assert sum((scores[p] > 0) == bool(y) for p, y in labels) >= 90


def test_view_classifier_is_stored_and_scores_what_it_has_not_seen(spark, tmp_path):
    from vigil.operators import scoring as SC
    from vigil.operators import views as V
    from vigil.sources import sinks as SK

    rng = random.Random(2)
    kinds = (["socket exec base64", "evil", "os"], ["json parse test", "nice", "re"])
    rows = [(f"p{i}", kinds[i % 2], [rng.choice("abcdefgh") for _ in range(6)]) for i in range(80)]
    meta = spark.createDataFrame([(p, "summary", f"{k[1]} {' '.join(n[:2])}") for p, k, n in rows], "package_id string, field string, value string")
    code = spark.createDataFrame([(p, f"{k[0]} {' '.join(n)}") for p, k, n in rows], "package_id string, text string")
    edges = spark.createDataFrame([(p, "<module>", f"{k[2]}.{n[0]}", 1) for p, k, n in rows], "package_id string, src string, dst string, weight long")
    views = V.view_matrix(meta, code, edges)
    assert {r["view"] for r in views.select("view").distinct().collect()} == {"metadata", "code", "graph"}
    attention = SC.channel_attention(views)
    labels = spark.createDataFrame([(p, 1 - i % 2) for i, (p, _, _) in enumerate(rows[:50])], "package_id string, label int")
    model, scored = TR.train_view_classifier(views, attention, labels, max_iter=40)
    SK.save_view_classifier(model, str(tmp_path))
    stored, about = SK.load_view_classifier(spark, str(tmp_path))
    assert about["seed"] == 7 and about["layers"] == [3 * 768, 16, 2]
    rest = spark.createDataFrame([(p, 1 - i % 2) for i, (p, _, _) in enumerate(rows)][50:], "package_id string, truth int")
    got = TR.score_views(stored, TR.view_rows(views, attention, rest)).collect()
    assert sum(r["prediction"] == r["truth"] for r in got) >= 27
    again = {r["package_id"]: r["probability"] for r in TR.score_views(stored, TR.view_rows(views, attention, labels)).collect()}
    assert all(abs(again[r["package_id"]] - r["probability"]) < 1e-9 for r in scored.collect())
    with pytest.raises(ValueError):
        SK.load_view_classifier(spark, str(tmp_path), hash="blake2b")


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_line_frames_by_ranges(spark, step):
    files = {"a": 25, "b": 1, "c": 9}
    df = spark.createDataFrame([(f, i + 1, f"{f}{i + 1}") for f, n in files.items() for i in range(n)], "path string, ln int, line string")
    got = {(r["path"], r["ln"]): (r["context"], r["context_lines"]) for r in R.line_context(df, 4, ["path"], step=step).collect()}
    assert len(got) == 35
    for (f, ln), (context, n) in got.items():
        want = [f"{f}{i}" for i in range(max(1, ln - 4), min(files[f], ln + 4) + 1)]
        assert context == "\n".join(want) and n == len(want)


def test_one_file_of_a_million_lines_is_many_tasks(spark):
    n = 1_000_000
    lines = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").alias("ln"), F.col("id").cast("string").alias("line"))
    out = R.line_context(lines, 2, ["path"])
    (r,) = out.withColumn("part", F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("context_lines").alias("k"), F.countDistinct("part").alias("parts")).collect()
    assert (r["n"], r["k"]) == (n, 5 * n - 6) and r["parts"] > 1
    (one,) = out.where("ln = 5000").collect()
    assert one["context"] == "4998\n4999\n5000\n5001\n5002"


def test_block_markers(spark):
    ext = spark.createDataFrame([("p", 4, 6), ("p", 1, None), ("q", 0, None), ("r", None, 2)], "package_id string, blocks int, links int")
    got = {r["package_id"]: r["marker"] for r in J.block_totals(ext).collect()}
    assert got == {"p": "SCALPEL_CFG_BLOCKS=5;SCALPEL_CFG_EDGES=6", "q": None, "r": "SCALPEL_CFG_BLOCKS=0;SCALPEL_CFG_EDGES=2"}
