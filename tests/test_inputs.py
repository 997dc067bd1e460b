"""Input that is broken, unreadable, large or oddly named: errors are rows, and nothing is lost silently."""

import io
import os
import zipfile

import pytest

from vigil.operators.extract import extract_facts, fact_snippets
from vigil.plans.corpus import score_corpus
from vigil.session import ensure_checkpoint_dir
from vigil.sources import files as S

SNIPPET = "import os\n" + "x = 1\n" * 30 + "os.system('ls')\n" + "y = 2\f\n" * 30


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_hostile_literals_and_snippets(spark):
    rows = [("p", "a.py", "x = '\\ud800'\nos.system('\\udfff')\n", None), ("p", "b.py", SNIPPET, None), ("q", "c.py", None, "unreadable"), ("q", "d.py", None, None)]
    facts = extract_facts(spark.createDataFrame(rows, "package_id string, path string, text string, error string")).collect()
    by = lambda k: [r for r in facts if r["kind"] == k]
    assert [r["value"] for r in by("string") if r["path"] == "a.py"] == ["?", "?"]
    assert {r["value"] for r in by("error")} == {"c.py: unreadable", "d.py: no content"} and len(by("file")) == 2
    (snip,) = [r["value"] for r in by("snippet") if r["path"] == "b.py"]
    lines = SNIPPET.splitlines()
    assert snip == "\n".join(["# b.py:32", *lines[13:50]])


def test_snippet_cap_is_off_by_default(spark):
    text = "import os\n" + "os.system('a')\n" * 100
    facts = extract_facts(spark.createDataFrame([("p", "a.py", text), ("p", "b.py", text)], "package_id string, path string, text string"))
    assert fact_snippets(facts).count() == 200
    capped = fact_snippets(facts, 80).collect()
    assert len(capped) == 80 and {r["path"] for r in capped} == {"a.py"}


def test_folders_lists_and_lone_files(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    write(one, "pkg/__init__.py", "import os\n")
    write(one, "pkg/deep/er/x.py", "eval('1')\n")
    write(one, "pkg/.git/hidden.py", "no")
    write(one, "lone.py", "import socket\n")
    write(one, "notes.txt", "x")
    write(two, "other/y.py", "z" * 5000)
    os.makedirs(two / "empty")
    listing = S.scan_files(spark, [str(one), str(two)])
    got = {(r["package_id"], r["path"]) for r in listing.collect()}
    assert got == {("pkg", "__init__.py"), ("pkg", "deep/er/x.py"), ("./lone.py", "lone.py"), ("other", "y.py"), ("empty", None)}
    units = {r["path"]: r for r in S.source_units(listing, max_bytes=4000).collect()}
    assert units["y.py"]["text"] is None and units["y.py"]["error"] == "larger than 4000 bytes"
    assert units["lone.py"]["text"] == "import socket\n" and units[""]["error"] == "no files"
    assert {r["path"]: r["text"] for r in S.source_units(listing).collect()}["y.py"] == "z" * 5000
    os.remove(one / "pkg/deep/er/x.py")
    gone = {r["path"]: r for r in S.source_units(listing).collect()}["deep/er/x.py"]
    assert gone["text"] is None and gone["error"]


def test_file_limit_reports_what_it_leaves_out(spark, tmp_path):
    for i in range(5):
        write(tmp_path, f"pkg/f{i}.py", "import os\n")
    units = S.source_units(S.scan_files(spark, str(tmp_path)), max_files=3).collect()
    assert sorted(r["path"] for r in units if r["error"]) == ["f3.py", "f4.py"]
    assert all(r["error"] == "beyond the first 3 files" for r in units if r["error"])


def test_archives_keep_apart_and_report(spark, tmp_path):
    write(tmp_path, "a.zip", zipped({"m.py": "import os\n"}))
    write(tmp_path, "a.whl", zipped({"m.py": "eval('2')\n"}))
    write(tmp_path, "_h.zip", zipped({"k.py": "import re\n"}))
    write(tmp_path, "notes.txt", "text")
    write(tmp_path, "broken.zip", zipped({"x.py": "a" * 500})[:-30])
    out = score_corpus(S.scan_archives(spark, str(tmp_path)))
    reports = {r["input"]: r for r in out["reports"].collect()}
    assert set(reports) == {"a.zip", "a.whl", "_h.zip", "notes.txt", "broken.zip"}
    assert reports["a.whl"]["counts"]["unique_api_calls"] == 1 and reports["a.zip"]["counts"]["unique_api_calls"] == 0
    for bad in ("notes.txt", "broken.zip"):
        assert reports[bad]["counts"]["python_files"] == 0 and reports[bad]["analysis_errors"]


def test_fused_report_keys(spark):
    files = spark.createDataFrame([("p", "a.py", 10, bytearray(b"eval('x')\n"), None)], "package_id string, path string, size bigint, content binary, error string")
    (r,) = score_corpus(files, mode="fused")["reports"].collect()
    assert r["mode"] == "fused" and r["feature_matrix_shape"] == [3, 768] and set(r["channel_attention"]) == {"metadata", "code", "graph"}
    blocks = spark.createDataFrame([("p", 4, 6), ("p", 1, None)], "package_id string, blocks int, links int")
    (n,) = score_corpus(files, block_counts=blocks)["scalars"].collect()
    assert (n["cfg_nodes"], n["cfg_edges"]) == (5, 6)


def test_checkpoint_folder_is_needed_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_long_text_entropy(spark):
    from vigil.functions import text as T
    df = spark.createDataFrame([("aab日" * 50,), ("",), (None,)], "s string")
    rows = df.select(T.text_entropy("s").alias("a"), T.shannon_entropy("s").alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-9 for r in rows)
