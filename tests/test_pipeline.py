import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from vigil.plans.corpus import score_corpus
from vigil.sources.files import scan_archives, scan_files

from .demo import write_demo


def test_demo_scores_rules_and_fused(spark):
    root = tempfile.mkdtemp(prefix="vigil-demo-")
    write_demo(root)
    pf = scan_files(spark, root)
    rules = {r["package_id"]: r for r in score_corpus(pf, mode="rules")["scores"].collect()}
    assert round(rules["evil_cache"]["probability"], 6) == 0.580194
    assert rules["evil_cache"]["prediction"] == "malicious"
    assert rules["evil_cache"]["reasons"] == [
        "uses sensitive APIs", "imports Bandit-blacklisted security-sensitive modules",
        "suspicious words appear near sensitive API code", "metadata fields are missing or weak"]
    assert round(rules["clean_math"]["probability"], 6) == 0.099750
    assert rules["clean_math"]["reasons"] == []
    fused = score_corpus(pf, mode="fused")
    fs = {r["package_id"]: r for r in fused["scores"].collect()}
    assert round(fs["evil_cache"]["probability"], 6) == 0.376093
    assert fs["evil_cache"]["prediction"] == "benign"
    assert round(fs["clean_math"]["probability"], 6) == 0.133242
    assert [round(x, 6) for x in fs["clean_math"]["attention"]] == [0.422319, 0.155362, 0.422319]
    named = {r["package_id"]: r for r in fused["named"].collect()}
    assert round(named["evil_cache"]["meta_missing_ratio"], 6) == round(4 / 7, 6)
    assert round(named["evil_cache"]["snippet_entropy"], 6) == 0.637387
    assert round(named["evil_cache"]["snippet_suspicious_words"], 6) == 0.36
    assert round(named["evil_cache"]["meta_entropy"], 6) == 0.489459
    rep = {r["input"]: r for r in fused["reports"].collect()}
    c = rep["evil_cache"]["counts"]
    assert (c["python_files"], c["unique_api_calls"], c["call_graph_edges"], c["snippets"]) == (2, 5, 6, 3)
    assert rep["evil_cache"]["metadata"]["name"] == "seccache"


def test_graph_stats_demo(spark):
    root = tempfile.mkdtemp(prefix="vigil-demo-")
    write_demo(root)
    a = score_corpus(scan_files(spark, root))
    g = {r["package_id"]: r for r in a["graph"].collect()}
    e = g["evil_cache"]
    assert (e["graph_nodes"], e["graph_edges"], e["max_indegree"], e["max_outdegree"]) == (7, 6, 1, 5)
    assert abs(e["graph_density"] - 6 / 42) < 1e-12 and abs(e["avg_degree"] - 12 / 7) < 1e-12
    c = g["clean_math"]
    assert (c["graph_nodes"], c["graph_edges"], c["graph_density"]) == (5, 4, 0.2)


def test_scan_archives_zip(spark):
    root = tempfile.mkdtemp(prefix="vigil-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("pkg/a.py", "import os\n")
        zf.writestr("pkg/PKG-INFO", "Name: z\n")
    with open(os.path.join(root, "z.whl"), "wb") as fh:
        fh.write(buf.getvalue())
    with open(os.path.join(root, "lone.py"), "w") as fh:
        fh.write("eval('1')\n")
    with open(os.path.join(root, "notes.txt"), "w") as fh:
        fh.write("x")
    df = scan_archives(spark, root)
    rows = sorted((r["package_id"], r["path"], r["error"]) for r in df.collect())
    assert ("z.whl", "pkg/a.py", None) in rows and ("z.whl", "pkg/PKG-INFO", None) in rows
    assert ("lone.py", "lone.py", None) in rows
    assert any(r[0] == "notes.txt" and r[2] for r in rows)


def test_metadata_priority(spark):
    from vigil.operators import metadata as MD
    rows = [("p", "PKG-INFO", "name", "hdr", 1, 0), ("p", "setup.cfg", "name", "cfg", 2, 0),
            ("p", "setup.cfg", "license", "", 2, 1), ("p", "pyproject.toml", "license", "MIT", 3, 0),
            ("p", "setup.py", "author-email", "a@b", 4, 0)]
    df = spark.createDataFrame(rows, MD.META_SCHEMA)
    got = {r["field"]: r["value"] for r in MD.coalesce_metadata(df).collect()}
    assert got == {"name": "hdr", "license": "", "author-email": "a@b"}
    texts = [("p", "setup.py", "setup.py", 'my_setup(author_email="a@b", license=1)'), ("p", "setup.cfg", "setup.cfg", "[metadata]\nlicense =\n"),
             ("p", "a/PKG-INFO", "header", "NAME: x  y\nname: z\nLicense:\n\nThe\n body"), ("q", "setup.py", "setup.py", "setup(name='\\ud800'")]
    files = spark.createDataFrame(texts, "package_id string, path string, kind string, text string")
    got = {(r["path"], r["field"]): r["value"] for r in MD.extract_metadata(files).collect()}
    assert got == {("setup.py", "author-email"): "a@b", ("setup.cfg", "license"): "", ("a/PKG-INFO", "name"): "x y",
                   ("a/PKG-INFO", "description"): "The body"}


def test_pagerank_matches_power_iteration(spark):
    import numpy as np
    from vigil.operators.graph import pagerank
    edges = [("g", "a", "b", 2), ("g", "b", "c", 1), ("g", "c", "a", 1), ("g", "a", "c", 1), ("g", "c", "d", 3)]
    df = spark.createDataFrame(edges, "package_id string, src string, dst string, weight long")
    got = {r["node"]: r["pagerank"] for r in pagerank(df).collect()}
    nodes = ["a", "b", "c", "d"]
    idx = {n: i for i, n in enumerate(nodes)}
    W = np.zeros((4, 4))
    for _, s, d, w in edges:
        W[idx[s], idx[d]] += w
    out = W.sum(axis=1)
    x = np.full(4, 0.25)
    for _ in range(100):
        last = x
        dang = x[out == 0].sum()
        P = np.divide(W, out[:, None], out=np.zeros_like(W), where=out[:, None] > 0)
        x = 0.85 * (x @ P + dang / 4) + 0.15 / 4
        if np.abs(x - last).sum() < 4 * 1e-6:
            break
    for n in nodes:
        assert abs(got[n] - x[idx[n]]) < 1e-12


def test_gradient_descent_one_step(spark):
    from vigil.operators.training import gradient_descent
    feats = spark.createDataFrame([("p1", "f", 1.0), ("p2", "f", 0.5), ("p2", "g", 2.0)],
                                  "package_id string, feature string, value double")
    labels = spark.createDataFrame([("p1", 1), ("p2", 0)], "package_id string, label int")
    w = {r["feature"]: r["weight"] for r in gradient_descent(feats, labels, epochs=1).collect()}
    # err = 0.5 - y: p1 -0.5, p2 +0.5
    assert abs(w["f"] - (-0.08 * ((-0.5 * 1.0) + (0.5 * 0.5)) / 2)) < 1e-12
    assert abs(w["g"] - (-0.08 * (0.5 * 2.0) / 2)) < 1e-12
    assert abs(w["__bias__"] - 0.0) < 1e-12
