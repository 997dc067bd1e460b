"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers 0..N-1 in a fixed order. An alternating Feistel network
over Z_a x Z_b (a * b >= N, both near sqrt(N)) permutes them; a result of N or
more is permuted again until it falls below N (cycle walking), which keeps the
map a bijection on 0..N-1. Position p lies in shard ``p % shards`` at slot
``p // shards``. Anyone who knows (seed, N) can compute the place of any row
number, and the row number of any place (:func:`row_at`).

Everything is native Spark: the numbers come from a range-partitioned sort cut by
``checkpoint()`` and from the counts of its partitions, never from one task.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

ROUNDS = 6
#: Cycle-walking steps built into the expression. At most sqrt(N) + 1 of a * b numbers lie outside 0..N-1,
#: so a walk of this length has probability below 64 ** -64 for large N and can't occur for N <= 4096.
WALK = 64


def network(n: int) -> tuple[int, int]:
    """The two moduli of the network for ``n`` rows."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _round_value(seed: int, i, half) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted(number: Column, n: int, seed: int) -> Column:
    """The position of row ``number`` (0..n-1) under the permutation of ``seed``."""
    a, b = network(n)

    def once(x):
        def step(y, i):
            left, right = F.floor(y / F.lit(b)).cast("bigint"), y % F.lit(b)
            return (F.when(i % 2 == 0, F.pmod(left + _round_value(seed, i, right), F.lit(a)) * F.lit(b) + right)
                    .otherwise(left * F.lit(b) + F.pmod(right + _round_value(seed, i, left), F.lit(b))).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("bigint"), step)

    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number),
                         lambda y, _: F.when(y < F.lit(n), y).otherwise(once(y)))
    return F.when(inside < F.lit(n), inside).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint"))


def row_at(position: int, n: int, seed: int) -> int:
    """The row number that stands at ``position``: the inverse of :func:`permuted`, for one place."""
    a, b = network(n)
    value = lambda i, half: int(hashlib.md5(f"{seed}:{i}:{half}".encode()).hexdigest()[:15], 16)
    while True:
        left, right = divmod(position, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - value(i, right)) % a
            else:
                right = (right - value(i, left)) % b
        position = left * b + right
        if position < n:
            return position


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` 0..N-1 in the order of the columns ``order`` (nulls first), and N.

    Rows equal in all of ``order`` are spread by a salt, so a third of all rows may
    be alike; such rows take each other's numbers. The offsets table has one row
    per partition.
    """
    keys = [F.col(f"`{c}`") for c in order]
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fixed = checkpoint(salted.repartitionByRange(parts, *keys, "__salt").sortWithinPartitions(*keys, "__salt")
                       .drop("__salt"))
    placed = (fixed.withColumn("__id", F.monotonically_increasing_id())
              .withColumn("__part", F.shiftright("__id", 33))
              .withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, n = [], 0
    for part, rows in counts:
        offsets.append((part, n))
        n += rows
    start = df.sparkSession.createDataFrame(offsets, "__part bigint, __start bigint")
    out = (placed.join(F.broadcast(start), "__part")
           .withColumn("row_number", F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start"))
    return out, n


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 7) -> DataFrame:
    """``df`` with ``row_number``, ``position``, ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Counts of the shards are at most one apart. The result depends on the rows, ``order``, ``shards``
    and ``seed`` only, not on files or partitions. Nulls in ``order`` come first; rows equal in all of
    ``order`` are interchangeable; an empty table gives an empty result; input columns with the names
    of output columns are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    made = ("row_number", "position", "shard", "slot")
    clash = [c for c in df.columns if c in made and c not in order]
    rows, n = numbered(df.drop(*clash), order)
    return (rows.withColumn("position", permuted(F.col("row_number"), n, seed))
            .withColumn("shard", (F.col("position") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("position") / shards).cast("bigint")))
