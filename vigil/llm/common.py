"""Helpers shared by the training-data operators: tables, written intermediate results, hashing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a task hands to Python at a time while an intermediate table is written.
BATCH_ROWS = 1024


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and by column, so a
    lost executor costs no recomputation of what stands before. Meanwhile batches of
    rows for Python are small: an executor and its workers hold several copies of each.
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    own = int(before)
    conf.set(rows, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(rows, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that no column of ``df`` begins with."""
    own = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in own):
        name += "_"
    return name


def partitions_for(spark: SparkSession, total: int, each: int) -> int:
    """Number of partitions: the session's, or more where ``total / each`` asks for them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // each), 1)


def ascii_lower(text):
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def extended(df: DataFrame, columns: dict[str, str]) -> StructType:
    """The schema of ``df`` with more columns; ``df`` itself keeps its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items())).fields])


def groups(batches, key: str):
    """From Arrow batches sorted by ``key``: (value, table) for each run of equal values."""
    import pyarrow as pa

    held, value = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        values = column.to_pylist()
        lo = 0
        while lo < len(values):
            hi = lo + 1
            while hi < len(values) and values[hi] == values[lo]:
                hi += 1
            if held and values[lo] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = values[lo]
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield value, pa.Table.from_batches(held)


BITMAP_BITS = 27
_ROW_BITS = 15  # a row of the bitmap holds 2 ** 15 bits, as bitmap_construct_agg makes them


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the low bits of ``key`` (long): at most 4096 rows of 4 KB, whatever the number of keys."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))
    return (keys.groupBy(F.shiftright(bit, _ROW_BITS).cast("int").alias("__row"))
            .agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("__bits")))


def maybe_in(df: DataFrame, key: str, bits: DataFrame, keep: bool = False) -> DataFrame:
    """The rows whose ``key`` may be in the bitmap: all that are, and by chance some that are not.

    With ``keep`` all rows, and ``__maybe``. Broadcasts the bitmap, whose size is fixed (16 MB).
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))
    rows = df.withColumn("__bit", bit).withColumn("__row", F.shiftright("__bit", _ROW_BITS).cast("int"))
    there = rows.join(F.broadcast(bits), "__row", "left" if keep else "inner")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__bit & {(1 << _ROW_BITS) - 1}) >> 3 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit & 7 as int))")) != 0, F.lit(False))
    if keep:
        return there.withColumn("__maybe", hit).drop("__bit", "__row", "__bits")
    return there.where(hit).drop("__bit", "__row", "__bits")
