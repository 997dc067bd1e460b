import tempfile

from pyspark.sql import functions as F

from vigil.operators import metadata as MD


def test_header_and_pyproject(spark):
    hdr = "Metadata-Version: 2.1\nname: x  y\nLicense: UNKNOWN\n\nThe body\n  text\n"
    files = spark.createDataFrame([("p", "PKG-INFO", "header", hdr)], "package_id string, path string, kind string, text string")
    rows = MD.extract_metadata(files).orderBy("ord").collect()
    assert [(r["field"], r["value"]) for r in rows] == [("name", "x y"), ("license", "UNKNOWN"), ("description", "The body text")]
    units = spark.createDataFrame([("p", "pyproject.toml", '[project]\nname = "demo "\nlicense = {text = "MIT"}\n'
                                                           '[tool.x]\ndescription = \'d\'\n')],
                                  "package_id string, path string, text string")
    got = {r["field"]: r["value"] for r in MD.pyproject_fields(units).collect()}
    assert got == {"name": "demo", "description": "d"}


def test_cap_files_big_package(spark):
    from vigil.sources.files import cap_files
    rows = [("big", f"f{i:03d}.py") for i in range(30)] + [("small", "a.py")]
    df = spark.createDataFrame(rows, "package_id string, path string")
    got = cap_files(df, limit=10).collect()
    big = sorted(r["path"] for r in got if r["package_id"] == "big")
    assert big == [f"f{i:03d}.py" for i in range(10)]
    assert [r["path"] for r in got if r["package_id"] == "small"] == ["a.py"]


def test_prefix_semi_join(spark):
    from vigil.operators.joins import prefix_semi_join
    from vigil.sources.dictionaries import load_dictionary
    df = spark.createDataFrame([("p", "xml.dom.minidom.x"), ("p", "xml"), ("p", "Crypto.Cipher"), ("p", "json")],
                               "package_id string, name string")
    kept = sorted(r["name"] for r in prefix_semi_join(df, load_dictionary(spark, "blacklist_imports")).collect())
    assert kept == ["Crypto.Cipher", "xml.dom.minidom.x"]


def test_model_round_trip(spark):
    from vigil.sources.sinks import load_model, save_model
    w = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("__bias__", -0.5)], "feature string, weight double")
    path = tempfile.mkdtemp(prefix="vigil-model-") + "/m"
    save_model(w, path)
    fw, meta = load_model(spark, path)
    assert sorted((r["feature"], r["weight"]) for r in fw.collect()) == [("__bias__", -0.5), ("a", 1.0), ("b", 2.0)]
    m = meta.first()
    assert (m["bias"], m["threshold"], m["hash"]) == (-0.5, 0.5, "md5")


def test_report_json(spark, tmp_path):
    from vigil.operators.report import report_json
    df = spark.createDataFrame([("p", "benign", 0.1)], "input string, prediction string, malicious_probability double")
    j = report_json(df).first()["report"]
    assert '"prediction":"benign"' in j
