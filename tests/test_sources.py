"""Scans at size: name ranges, archives read by member, and input that lies about itself."""

import contextlib
import io
import json
import os
import tarfile
import tracemalloc
import types
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from vigil.sources import files as S
from vigil.sources import listing
from vigil.sources.listing import name_ranges


def test_name_ranges_are_even_and_bounded():
    names = [f"p{i:06d}" for i in range(100_000)]
    cuts = name_ranges(iter(names))
    assert 250 <= len(cuts) <= 316 and cuts == sorted(set(cuts))
    sizes = [b - a for a, b in zip([0, *[int(c[1:]) for c in cuts]], [*[int(c[1:]) for c in cuts], 100_000])]
    assert sum(sizes) == 100_000 and max(sizes) < 1500
    assert name_ranges(iter([])) == [] and name_ranges(iter(["a"]), 8) == [] and name_ranges(iter("abcd"), 2) == ["c"]


def test_many_packages_are_listed_by_many_tasks(spark, tmp_path):
    for i in range(900):
        os.makedirs(tmp_path / f"pkg{i}" / "sub")
        (tmp_path / f"pkg{i}" / "__init__.py").write_text("x = 1\n")
        (tmp_path / f"pkg{i}" / "sub" / "m.py").write_text("y = 2\n")
    assert S.read_listing(spark, [str(tmp_path)], "packages").rdd.getNumPartitions() >= 25
    listing = S.scan_files(spark, str(tmp_path))
    got = {(r["package_id"], r["path"], r["size"]) for r in listing.collect()}
    assert got == {(f"pkg{i}", p, 6) for i in range(900) for p in ("__init__.py", "sub/m.py")} and listing.count() == 1800


def test_missing_root_is_an_error_row(spark, tmp_path):
    (row,) = S.scan_files(spark, str(tmp_path / "none")).collect()
    assert row["path"] is None and row["error"]


def test_files_beyond_a_row_are_errors(spark, tmp_path, monkeypatch):
    os.makedirs(tmp_path / "p")
    (tmp_path / "p" / "large.py").write_text("x = 1\n" * 500)
    monkeypatch.setattr(S, "ROW_BYTES", 1000)
    (unit,) = S.source_units(S.scan_files(spark, str(tmp_path))).collect()
    assert unit["text"] is None and unit["error"] == "larger than 1000 bytes"


def _tar(mode, members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_of_every_kind(spark, tmp_path):
    members = [(f"d/m{i}.py", f"print({i})\n".encode() * (i + 1)) for i in range(40)] + [("d/m3.py", b"again = 1\n"), ("d/empty.py", b"")]
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz"), ("c.tar.bz2", "w:bz2"), ("d.tar.xz", "w:xz")):
        (tmp_path / name).write_bytes(_tar(mode, members))
    for name, method in (("e.zip", zipfile.ZIP_STORED), ("f.whl", zipfile.ZIP_DEFLATED), ("g.zip", zipfile.ZIP_LZMA)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            for path, data in members:
                z.writestr(zipfile.ZipInfo(path), data, method)
    (tmp_path / "lone.py").write_text("z = 1\n")
    (tmp_path / "empty.zip").write_bytes(b"")
    rows = S.scan_archives(spark, str(tmp_path)).collect()
    want = sorted((path, data) for path, data in members)
    for name in ("a.tar", "b.tar.gz", "c.tar.bz2", "d.tar.xz", "e.zip", "f.whl", "g.zip"):
        own = [r for r in rows if r["package_id"] == name]
        assert sorted((r["path"], bytes(r["content"])) for r in own) == want, name
        assert all(r["error"] is None and r["size"] == len(r["content"]) for r in own)
    assert [bytes(r["content"]) for r in rows if r["package_id"] == "lone.py"] == [b"z = 1\n"]


def test_archives_that_lie(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.py", b"\0" * (3 << 20))
        z.writestr("good.py", b"ok = 1\n")
    data = bytearray((tmp_path / "bomb.zip").read_bytes())
    at = data.rfind(b"PK\x01\x02", 0, data.rfind(b"good.py"))
    first = data.find(b"PK\x01\x02")
    assert first < at
    data[first + 24:first + 28] = (50).to_bytes(4, "little")  # 50 bytes declared, 3 MB inside
    (tmp_path / "liar.zip").write_bytes(data)
    whole = _tar("w", [("a.py", b"a = 1\n"), ("b.py", b"b" * 5000)])
    (tmp_path / "cut.tar").write_bytes(whole[:2600])
    (tmp_path / "cut.tar.gz").write_bytes(_tar("w:gz", [("a.py", os.urandom(9000)), ("b.py", os.urandom(90000))])[:40000])
    rows = {(r["package_id"], r["path"]): r for r in S.scan_archives(spark, str(tmp_path), max_bytes=1 << 20).collect()}
    assert rows["bomb.zip", "bomb.py"]["error"] == f"larger than {1 << 20} bytes" and rows["bomb.zip", "bomb.py"]["content"] is None
    assert rows["liar.zip", "bomb.py"]["content"] is None and rows["liar.zip", "bomb.py"]["error"]
    for name in ("bomb.zip", "liar.zip"):
        assert bytes(rows[name, "good.py"]["content"]) == b"ok = 1\n"
    assert bytes(rows["cut.tar", "a.py"]["content"]) == b"a = 1\n"
    assert any(k[0] == "cut.tar" and r["error"] for k, r in rows.items())
    assert rows["cut.tar.gz", "a.py"]["error"] is None and rows["cut.tar.gz", None]["error"]


def test_a_large_archive_takes_little_memory(tmp_path):
    body = os.urandom(1 << 20)
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for i in range(300):
            z.writestr(f"m{i}.py", body)
    size = (tmp_path / "large.zip").stat().st_size
    listing = pd.DataFrame({"path": ["large.zip"], "size": [size], "root": [str(tmp_path)]})
    tracemalloc.start()
    n = 0
    for members in S._directories(iter([listing])):
        for out in S._read_members(iter([members]), S.ROW_BYTES):
            n += sum(len(x) == 1 << 20 for x in out["content"].to_numpy())
            del out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and peak < 100 << 20


def test_facts_are_read_by_kind(spark):
    from vigil.operators import counts as C
    from vigil.operators.extract import extract_facts, stored_facts

    units = spark.createDataFrame([("p", "a.py", "import os\nos.system('x')\n")], "package_id string, path string, text string")
    facts = stored_facts(extract_facts(units))
    plan = C.count_names(facts, "call")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "value" not in plan.split("ReadSchema")[1].split(">")[0]
    assert [(r["name"], r["cnt"]) for r in C.count_names(facts, "call").collect()] == [("os.system", 1)]


def test_pagerank_by_blocks_and_by_joins(spark):
    import random

    from vigil.operators.graph import pagerank

    rng = random.Random(3)
    rows = [(f"p{i % 7}", f"n{rng.randrange(12)}", f"n{rng.randrange(15)}", rng.randrange(1, 4)) for i in range(300)]
    rows += [("loop", "a", "a", 2), ("pair", "x", "y", 1), ("pair", "y", "x", 5)]
    df = spark.createDataFrame(rows, "package_id string, src string, dst string, weight long")
    for kw, limit in (({"tol": 0.01}, 30), ({"max_iter": 2, "tol": None}, 0)):
        whole = {(r[0], r[1]): tuple(r)[2:] for r in pagerank(df, **kw).collect()}
        joined = pagerank(df, local_edges=limit, **kw).collect()
        assert len(joined) == len(whole)
        for r in joined:
            rank, iterations, converged = whole[r[0], r[1]]
            assert abs(r["pagerank"] - rank) < 1e-12 and (r["iterations"], r["converged"]) == (iterations, converged)
    assert pagerank(df.limit(0)).count() == 0


def test_listing_grows_with_the_names_alone(tmp_path, monkeypatch):
    names = [f"p{i:06d}" for i in range(100_000)]
    assert len(name_ranges(iter(names), 12, 64)) == 63  # each range reads all names again
    for i in range(400):
        (tmp_path / f"a{i:03d}.zip").write_bytes(b"")
    monkeypatch.setattr(listing, "RANGES", 8)
    reader = listing._Reader({"roots": json.dumps([str(tmp_path)]), "what": "files", "least": "1"})
    ranges = reader.partitions()
    assert len(ranges) == 8 and sorted(r[1] for p in ranges for r in reader.read(p)) == [f"a{i:03d}.zip" for i in range(400)]
    some = [name for name, _, _ in listing.entries(listing.fs_and_base(str(tmp_path))[0], str(tmp_path), ranges[0].holds)]
    assert 0 < len(some) < 100 and all(ranges[0].holds(name) for name in some)


def test_a_read_asks_for_what_is_listed(tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    for name, body in (("a.py", b"x = 1\n"), ("b.py", b"y" * 50), ("empty.py", b"")):
        (tmp_path / "p" / name).write_bytes(body)
    asked = []

    class Asked:
        def __init__(self, fs):
            self.fs = fs

        @contextlib.contextmanager
        def open_input_file(self, name):
            with self.fs.open_input_file(name) as fh:
                yield types.SimpleNamespace(read=lambda n: asked.append(n) or fh.read(n))

    fs, base = listing.fs_and_base(str(tmp_path))
    monkeypatch.setattr(S, "fs_and_base", lambda root: (Asked(fs), base))
    rows = [("p", "a.py", 6, "r", None), ("p", "b.py", 20, "r", None), ("p", "empty.py", 0, "r", None), ("p", "gone.py", 3, "r", None),
            ("p", "a.py", None, "r", None), ("p", "large.py", 101, "r", None), ("p", None, None, "r", "no files")]
    schema = pa.schema([("package_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("root", pa.string()), ("error", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
    got = [r for b in S._read_batches(iter([batch]), 100, ["package_id", "path", "size"]) for r in b.to_pylist()]
    assert [r["content"] for r in got] == [b"x = 1\n", b"y" * 50, b"", None, b"x = 1\n", None, None]  # b.py has grown, the sixth is too large
    assert [r["error"] is None for r in got] == [True, True, True, False, True, False, False]
    assert got[5]["error"] == "larger than 100 bytes" and got[6]["error"] == "no files"
    assert asked[:2] == [7, 21] and max(asked[0], asked[3]) <= 7


def test_files_of_a_folder_are_read_together(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH_FILES", 100)
    rows = [(f"p{i}", f"{d}m{j:02d}.py", 6) for i in range(20) for d in ("", "sub/") for j in range(10)] + [("large", f"m{j:04d}.py", 6) for j in range(1000)] + [(None, None, None)]
    files = spark.createDataFrame(rows, "package_id string, path string, size long").repartition(7)
    dealt = S._dealt(files, 8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(map(str, ((r["package_id"], r["path"], r["size"]) for r in dealt))) == sorted(map(str, rows))
    at = {}
    for r in dealt:
        if r["path"]:
            at.setdefault((r["package_id"], r["path"].rpartition("/")[0]), set()).add(r["task"])
    assert all((len(tasks) > 3) == (package == "large") and (package == "large" or len(tasks) == 1) for (package, _), tasks in at.items())
    assert len({t for tasks in at.values() for t in tasks}) == 8
    for t in range(8):
        own = [(r["package_id"], r["path"]) for r in dealt if r["task"] == t and r["path"]]
        assert own == sorted(own)


def test_the_corpus_of_events_takes_the_disk_of_a_wave(spark, tmp_path, monkeypatch):
    """Packages are written in waves; when the next one is written the files of the last are empty, and none is left in the end."""
    import glob

    from vigil.plans import catalog, fixtures
    from vigil.session import ensure_checkpoint_dir

    rows = [(i, i % 40, ("view", "error", "click")[i % 3], f'{{"k": {i}}}') for i in range(600)]
    rows += [(600 + i, None, "view", None) for i in range(3)] + [(603, 7, "click", "it's")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    top = f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/corpus-files-*"
    before, waves, write = set(glob.glob(top)), [], fixtures.write_files

    def watched(df, root):
        waves.append([f for g in set(glob.glob(top)) - before for f in glob.glob(f"{g}/*/*") if os.path.getsize(f)])
        write(df, root)

    def result(name):
        out = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        return sorted(map(tuple, out), key=repr)

    once = result("rt_capped_files")
    monkeypatch.setattr(fixtures, "write_files", watched)
    monkeypatch.setattr(fixtures, "WAVE_BYTES", 200_000)
    calls = result("rt_calls")
    assert any(r[0] is not None for r in calls)
    # a null user_id is a folder named None
    assert result("rt_scan_files") == sorted(((("None" if r[0] is None else r[0]), *r[1:]) for r in calls), key=repr)
    assert len(waves) > 2 and not any(waves)
    assert result("rt_capped_files") == once and not set(glob.glob(top)) - before


def test_waves_are_whole_packages(spark, monkeypatch):
    from vigil.plans import fixtures

    events = spark.createDataFrame([(i, i % 50 or None, "view", None) for i in range(500)], "event_id long, user_id long, event_type string, props string")
    assert [w.count() for w in fixtures.event_waves(events)] == [500]
    monkeypatch.setattr(fixtures, "WAVE_BYTES", 100_000)
    users = [{r["user_id"] for r in w.select("user_id").collect()} for w in fixtures.event_waves(events)]
    assert len(users) > 2 and sum(map(len, users)) == 50 == len(set().union(*users))
    assert [w.count() for w in fixtures.event_waves(events.limit(0))] == [0]
