"""Windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "package_id"


def top_k_per_group(df: DataFrame, k: int | None, order: list[Column], key: str | list[str] = KEY,
                    rank_col: str = "rank") -> DataFrame:
    """Generic per-group top-k with a total order (ties must be broken by ``order``).

    ``row_number() <= k`` lets Spark insert a partial ``WindowGroupLimit`` below
    the shuffle, so a hot group contributes at most ``k`` rows per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= k) if k is not None else out


def top_k_names(counts: DataFrame, k: int | None, key: str = KEY, rank_col: str = "rank") -> DataFrame:
    """Per package, names by count desc, ties by first occurrence (``first``)."""
    return top_k_per_group(counts, k, [F.col("cnt").desc(), F.col("first").asc()], key, rank_col)


def first_n_per_group(df: DataFrame, n: int, order: list[str | Column], key: str = KEY,
                      seq_col: str = "item_seq") -> DataFrame:
    """The first ``n`` items per package in a given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(seq_col, F.row_number().over(w)).where(F.col(seq_col) <= n)


#: Lines of a file that one window partition answers for.
RANGE = 1000


def line_context(lines: DataFrame, radius: int, key: list[str], order: str = "ln", line: str = "line",
                 out: str = "context", step: int = RANGE) -> DataFrame:
    """The ``radius`` lines before and after each line, as a frame window; ``<out>_lines`` counts the lines of the frame.

    ``order`` numbers the lines of a file 1, 2, 3 ... A file is cut into ranges of ``step`` lines, each a window partition of
    its own that also gets the ``radius`` lines on either side, so a long file is many tasks' work.
    """
    at = F.col(order).cast("bigint") - 1
    own = F.floor(at / step)
    to = F.sequence(F.greatest(F.floor((at - radius) / step), F.lit(0).cast("bigint")), F.floor((at + radius) / step))
    dealt = lines.withColumn("_range", F.explode(to))
    w = Window.partitionBy(*key, "_range").orderBy(order).rowsBetween(-radius, radius)
    framed = dealt.withColumn(out, F.array_join(F.collect_list(line).over(w), "\n")).withColumn(f"{out}_lines", F.count(F.lit(1)).over(w))
    return framed.where(F.col("_range") == own).drop("_range")
