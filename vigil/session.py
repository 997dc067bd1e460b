"""Session helpers: sensible defaults and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Source files can be up to 2 MB each: keep Arrow batches small for the extraction UDF.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "vigil", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_library(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must name a folder that all executors
    share; without it this raises. A private folder is made only for ``local``
    masters (tests), whose tasks run on this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def ship_library(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    A worker started without the package on its path could not import the functions it runs.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vigil_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-lib-"), "vigil_library.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.join("vigil", os.path.relpath(whole, root)))
    sc.addPyFile(path)
    sc._vigil_shipped = True


#: Open files of a task that writes a folder for each value, and the bytes that each of them holds.
WRITERS, BLOCK_BYTES = 32, 16 << 20
#: The setting of the rows that Python is given at a time.
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, by: str | None = None, path: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder, in a folder for each value of ``by``, and read it back.

    Like ``checkpoint()`` it cuts lineage and survives executor loss; but readers take only the columns, and with ``by``
    only the folders, that they ask for. A table made piece by piece has a ``path`` (:func:`saved_path`): ``df`` is added to
    what is there, and all of it is read. With ``batch_rows`` Python is given that many rows at a time at most, where rows are large.
    """
    path = path or saved_path(df.sparkSession, name)
    conf, held = df.sparkSession.conf, {}
    if by is not None:  # a writer for each value, of which there are few: no task sorts, nor holds, all of its rows
        held["spark.sql.maxConcurrentOutputFileWriters"] = WRITERS
    if batch_rows is not None:
        own = int(conf.get(RECORDS))
        held[RECORDS] = min(own, batch_rows) if own > 0 else batch_rows
    before = {name: conf.get(name, None) for name in held}
    for name, value in held.items():
        conf.set(name, str(value))
    try:
        if by is None:
            df.write.mode("append").parquet(path)
        else:
            df.write.mode("append").option("parquet.block.size", str(BLOCK_BYTES)).partitionBy(by).parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
