"""Round-trip source corpus derived from the driver's ``events`` table.

Each ``(user_id, event_type, event_id div CHUNK)`` becomes one Python file of
package ``u<user_id>``; each event becomes a 4-line function. Because the text
is a pure function of the table, plain SQL on ``events`` predicts every fact
the extractor must find, which is how extraction is value-checked.

File layout (``p`` = 0-based position of the event in its file, by event_id)::

    line 1   import <event_type>.core
    line 2   import xml.dom.minidom        (error)
             from subprocess import Popen  (purchase)
             from json import loads        (others)
    4p+3     def f<event_id>():
    4p+4         s = '<props>'
    4p+5         [if <id> % 2: | try: ]<api>(<id>)     # id%3 = 0 | 1 | 2 (bare)
    4p+6         except Exception: pass   (id%3 = 1)   else   pass

``api`` by ``id % 5``: os.system, <type>.run, subprocess.Popen, requests.post,
<type>.evaluate. A file holding an event with ``id % 97 = 0`` drops that call's
closing parenthesis and therefore fails to parse as a whole.

Every file collects at most ``CHUNK`` events (ids are bucketed by range), so no
group is unbounded.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import os
import shutil
import tarfile
import zipfile

import pandas as pd
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.listing import fs_and_base, names

CHUNK = 20000
#: Bytes of disk that the files of a wave of packages take, and that any file or folder takes at least: a block.
WAVE_BYTES, FILE_BYTES = 1 << 30, 4096
#: Bytes of an event's lines besides its ``props``, about.
EVENT_BYTES = 128


def _api(event_id, event_type):
    m = event_id % 5
    return (F.when(m == 0, F.lit("os.system"))
             .when(m == 1, F.concat(event_type, F.lit(".run")))
             .when(m == 2, F.lit("subprocess.Popen"))
             .when(m == 3, F.lit("requests.post"))
             .otherwise(F.concat(event_type, F.lit(".evaluate"))))


def event_blocks(events: DataFrame) -> DataFrame:
    """One 4-line source block per event with its file coordinates."""
    e = events.select("event_id", "user_id", "event_type", "props")
    eid, et = F.col("event_id"), F.col("event_type")
    sid = eid.cast("string")
    call = F.concat(_api(eid, et), F.lit("("), sid, F.when(eid % 97 == 0, F.lit("")).otherwise(F.lit(")")))
    props = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("props"), F.lit("")), r"\\", r"\\\\"), "'", "\\\\'")
    line3 = (F.when(eid % 3 == 0, F.concat(F.lit("    if "), sid, F.lit(" % 2: "), call))
              .when(eid % 3 == 1, F.concat(F.lit("    try: "), call))
              .otherwise(F.concat(F.lit("    "), call)))
    line4 = F.when(eid % 3 == 1, F.lit("    except Exception: pass")).otherwise(F.lit("    pass"))
    block = F.concat_ws("\n", F.concat(F.lit("def f"), sid, F.lit("():")),
                        F.concat(F.lit("    s = '"), props, F.lit("'")), line3, line4)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("package_id"),
        F.concat(et, F.lit("_"), F.floor(eid / CHUNK).cast("bigint").cast("string"), F.lit(".py")).alias("path"),
        et.alias("event_type"), eid.alias("event_id"), block.alias("block"))


def _header(event_type):
    second = (F.when(event_type == "error", F.lit("import xml.dom.minidom"))
               .when(event_type == "purchase", F.lit("from subprocess import Popen"))
               .otherwise(F.lit("from json import loads")))
    return F.concat(F.lit("import "), event_type, F.lit(".core\n"), second, F.lit("\n"))


def event_source_units(events: DataFrame) -> DataFrame:
    """``source_units(package_id, path, text)`` generated from ``events``."""
    blocks = event_blocks(events)
    files = blocks.groupBy("package_id", "path", "event_type").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "block"))).alias("_b"))
    return files.select(
        "package_id", "path",
        F.concat(_header(F.col("event_type")),
                 F.array_join(F.transform("_b", lambda x: x["block"]), "\n"), F.lit("\n")).alias("text"))


def event_package_files(events: DataFrame) -> DataFrame:
    """Same corpus as ``package_files`` rows (UTF-8 content), for the file-level operators."""
    units = event_source_units(events)
    content = F.encode("text", "UTF-8")
    return units.select("package_id", "path", F.octet_length("text").cast("bigint").alias("size"),
                        content.alias("content"), F.lit(None).cast("string").alias("error"))


def event_waves(events: DataFrame) -> list[DataFrame]:
    """``events`` by whole packages, in parts whose files take about ``WAVE_BYTES`` of disk (or those of one package, if that is more)."""
    file = F.xxhash64("user_id", "event_type", F.floor(F.col("event_id") / CHUNK))
    total = events.agg((F.approx_count_distinct(file) + F.approx_count_distinct(F.xxhash64("user_id"))).alias("files"),
                       F.sum(F.coalesce(F.octet_length("props"), F.lit(0)) + EVENT_BYTES).alias("bytes")).first()
    n = -(-(total["files"] * FILE_BYTES + (total["bytes"] or 0)) // WAVE_BYTES)
    if n < 2:
        return [events]
    wave = F.pmod(F.xxhash64("user_id"), F.lit(n))
    return [events.where(wave == r["wave"]) for r in events.select(wave.alias("wave")).distinct().sort("wave").collect()]


def _placed(df: DataFrame, root: str, write) -> None:
    """Give the rows of each package, all in one task and in path order, to ``write(fs, base, rows)``; force it."""
    def run(batches):
        fs, base = fs_and_base(root)
        fs.create_dir(base, recursive=True)

        def rows():
            for batch in batches:
                yield from zip(batch["package_id"], batch["path"], batch["content"])

        n = 0
        for package, own in itertools.groupby(rows(), key=lambda r: r[0]):
            n += write(fs, base, package, own)
        yield pd.DataFrame({"files": [n]})

    files = df.select("package_id", "path", "content").repartition("package_id").sortWithinPartitions("package_id", "path")
    files.mapInPandas(run, "files long").agg(F.sum("files")).collect()


def write_files(df: DataFrame, root: str) -> None:
    """Write ``package_files`` rows as files ``root/<package>/<path>``; a task that runs again writes the same."""
    def write(fs, base, package, rows):
        n, made, local = 0, set(), isinstance(fs, LocalFileSystem)
        for _, path, content in rows:
            name = f"{base}/{package}/{path}"
            folder = name.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            if local:  # a fourth of the time that a stream of the file system takes for a small file
                with open(name, "wb", buffering=0) as out:
                    out.write(content)
            else:
                with fs.open_output_stream(name) as out:
                    out.write(content)
            n += 1
        return n

    _placed(df, root, write)


def _by_package(spark: SparkSession, root: str, do) -> None:
    """``do(fs, folder)`` with the folders of the packages below ``root``, by tasks."""
    fs, base = fs_and_base(root)
    try:
        packages = list(names(fs, base))
    except FileNotFoundError:  # nothing has been written
        return

    def run(own):
        fs, base = fs_and_base(root)
        for package in own:
            try:
                do(fs, f"{base}/{package}")
            except FileNotFoundError:  # an earlier try of this task did it
                pass

    sc = spark.sparkContext
    sc.parallelize(packages, max(1, min(len(packages), 4 * sc.defaultParallelism))).foreachPartition(run)


def empty_files(spark: SparkSession, root: str) -> None:
    """Give back the disk that the files of :func:`write_files` take.

    Local files are cut to nothing and their names stay, as ext4 without a journal makes no new files of the nodes of
    removed ones for minutes, and goes over all of these each time (30 times the time for a file); elsewhere they go.
    """
    def do(fs, folder):
        if not isinstance(fs, LocalFileSystem):
            fs.delete_dir_contents(folder)
            return
        for entry in os.scandir(folder):
            do(fs, entry.path) if entry.is_dir(follow_symlinks=False) else os.truncate(entry.path, 0)

    _by_package(spark, root, do)


def remove_files(spark: SparkSession, root: str) -> None:
    """Remove the folder that :func:`write_files` has written, its packages by tasks."""
    _by_package(spark, root, lambda fs, folder: shutil.rmtree(folder) if isinstance(fs, LocalFileSystem) else fs.delete_dir(folder))
    fs, base = fs_and_base(root)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(base)


def write_archives(df: DataFrame, root: str) -> None:
    """Write each package ``u<n>`` as one archive: a zip for even n, else a tar. Rows go straight to the file."""
    def write(fs, base, package, rows):
        n, even = 0, int(package[1:]) % 2 == 0
        with fs.open_output_stream(f"{base}/{package}{'.zip' if even else '.tar'}") as out:
            archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if even else tarfile.open(fileobj=out, mode="w|")
            with archive:
                for _, path, content in rows:
                    if even:
                        archive.writestr(path, content)
                    else:
                        info = tarfile.TarInfo(path)
                        info.size = len(content)
                        archive.addfile(info, io.BytesIO(content))
                    n += 1
        return n

    _placed(df, root, write)


# SQL (DuckDB) that predicts the per-event facts of the generated corpus.
ORACLE_EVENT_FACTS = """
  ev AS (
    SELECT 'u' || CAST(user_id AS VARCHAR) AS package_id,
           event_type || '_' || CAST(CAST(FLOOR(event_id / 20000) AS BIGINT) AS VARCHAR) || '.py' AS path,
           event_id, event_type, props,
           CASE event_id % 5 WHEN 0 THEN 'os.system' WHEN 1 THEN event_type || '.run'
                WHEN 2 THEN 'subprocess.Popen' WHEN 3 THEN 'requests.post'
                ELSE event_type || '.evaluate' END AS api
    FROM events),
  files AS (
    SELECT package_id, path, event_type, bool_or(event_id % 97 = 0) AS broken
    FROM ev GROUP BY package_id, path, event_type),
  okev AS (
    SELECT ev.*, 4 * (row_number() OVER (PARTITION BY ev.package_id, ev.path ORDER BY event_id) - 1) + 5 AS lineno
    FROM ev JOIN files USING (package_id, path) WHERE NOT files.broken)
"""

# Lines of the parseable generated files and the snippets around sensitive calls
# (append after ORACLE_EVENT_FACTS; needs a {sensitive} predicate on ``api``).
ORACLE_EVENT_SNIPPETS = """,
  lines AS (
    SELECT package_id, path, 1 AS ln, 'import ' || event_type || '.core' AS line FROM files WHERE NOT broken
    UNION ALL
    SELECT package_id, path, 2, CASE event_type WHEN 'error' THEN 'import xml.dom.minidom'
                                   WHEN 'purchase' THEN 'from subprocess import Popen'
                                   ELSE 'from json import loads' END FROM files WHERE NOT broken
    UNION ALL SELECT package_id, path, lineno - 2, 'def f' || CAST(event_id AS VARCHAR) || '():' FROM okev
    UNION ALL SELECT package_id, path, lineno - 1, '    s = ''' || props || '''' FROM okev
    UNION ALL
    SELECT package_id, path, lineno,
           CASE event_id % 3 WHEN 0 THEN '    if ' || CAST(event_id AS VARCHAR) || ' % 2: '
                             WHEN 1 THEN '    try: ' ELSE '    ' END
           || api || '(' || CAST(event_id AS VARCHAR) || ')' FROM okev
    UNION ALL
    SELECT package_id, path, lineno + 1,
           CASE WHEN event_id % 3 = 1 THEN '    except Exception: pass' ELSE '    pass' END FROM okev),
  scalls AS (
    SELECT package_id, path, lineno,
           row_number() OVER (PARTITION BY package_id ORDER BY path, lineno) AS snippet_seq
    FROM okev WHERE {sensitive}),
  snips AS (
    SELECT package_id, snippet_seq, path, lineno,
           '# ' || path || ':' || CAST(lineno AS VARCHAR) || chr(10) || body AS text
    FROM (SELECT s.package_id, s.snippet_seq, s.path, s.lineno,
                 string_agg(l.line, chr(10) ORDER BY l.ln) AS body
          FROM scalls s JOIN lines l ON l.package_id = s.package_id AND l.path = s.path
               AND l.ln BETWEEN s.lineno - {radius} AND s.lineno + {radius}
          GROUP BY 1, 2, 3, 4))
"""
