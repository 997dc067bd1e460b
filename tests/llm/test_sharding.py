"""Sharding: a bijection, gapless slots, counts at most one apart, reproducible on any layout."""

import pytest
from pyspark.sql import functions as F

from vigil.llm.sharding import row_at, shard_rows

SCHEMA = "doc_id bigint, text string, shard string"


def placed(df, shards=3, seed=5):
    rows = shard_rows(df, shards, ["doc_id", "text"], seed).collect()
    return {(r["doc_id"], r["text"], r["row_number"]): (r["shard"], r["slot"], r["position"]) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 256, 1000])
def test_bijection_and_inverse(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("shard"))
    got = placed(df)
    assert sorted(p for _, _, p in got.values()) == list(range(n))
    for (_, _, row), (shard, slot, position) in got.items():
        assert (shard, slot) == (position % 3, position // 3)
        assert row_at(position, n, 5) == row
    counts = [sum(s == k for s, _, _ in got.values()) for k in range(3)]
    assert max(counts) - min(counts) <= 1


def test_nulls_repeats_and_layout(spark):
    rows = [(None, None, "a"), (None, "x", "b"), (3, "", "c"), (3, "", "c"), (3, "", "c"), (1, "long " * 9999, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    first, again = placed(df), placed(df.repartition(5))
    assert first == again and len(first) == len(rows)
    numbers = {k[2]: k[0] for k in first}
    assert [numbers[i] for i in range(6)] == [None, None, 1, 3, 3, 3]


def test_bad_shard_count(spark):
    with pytest.raises(ValueError):
        shard_rows(spark.range(2), 0, ["id"])
