"""Scores against the formula computed with plain dictionaries."""

import collections
import math
import random
import re

import numpy as np
import pytest

from vigil.llm import lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    def counts(keep):
        uni, ctx, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for _, text, fold in rows:
            if keep(fold):
                t = tokens(text)
                uni.update(t)
                ctx.update(["<s>"] + t[:-1])
                pair.update(zip(["<s>"] + t[:-1], t))
        return uni, ctx, pair, sum(uni.values()), len(uni)

    def ratio(m, h, w):
        uni, ctx, pair, n, v = m
        return pair[h, w] / ctx[h] / ((uni[w] + 0.5) / (n + 0.5 * (v + 1))) if ctx[h] else None

    some, every = counts(lambda f: f in (0, 2, 3)), counts(lambda f: f != 1)
    seen = collections.defaultdict(list)
    for _, text, fold in rows:
        if fold == 4:
            t = tokens(text)
            for h, w in zip(["<s>"] + t[:-1], t):
                r = ratio(some, h, w)
                if r is not None:
                    seen[int(math.log2(some[1][h]))].append(r)
    weights = collections.defaultdict(float)
    for b, rs in seen.items():
        r, x = np.array(rs), 0.5
        for _ in range(lmscore.ROUNDS):
            x = (np.sum(x * r / (x * r + 1 - x)) + 0.5) / (len(r) + 1)
        weights[b] = x
    out = []
    uni, ctx, _, n, v = every
    for k, text, fold in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for h, w in zip(["<s>"] + t[:-1], t):
            p = math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))
            r = ratio(every, h, w)
            x = weights[int(math.log2(ctx[h]))] if r is not None else 0
            base, score = base + p, score + p + math.log10(x * (r or 0) + 1 - x)
        out.append((k, fold == 1, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block", [1 << 24, 3000])
def test_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "日本", "A"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(80))), rng.randrange(5)) for i in range(150)]
    rows += [(200, None, 0), (201, "", 1), (202, " \n", 4), (203, "the the the " * 3000, 2), (203, "the the the " * 3000, 2), (204, "brandnew words", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, fold int").repartition(3)
    got = sorted(map(tuple, lmscore.log_scores(df).collect()))
    for g, w in zip(got, sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3, abs=0.02)


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 1)], "row_id bigint, text string, fold int")
    (r,) = lmscore.log_scores(df).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["score"] == pytest.approx(r["base_score"])
    assert lmscore.log_scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind, ids", [("bigint", [None, 2 ** 60 + 1, -1, None, 2 ** 63 - 1]), ("string", ["a", None, "01", "1", ""]), ("decimal(38,0)", [None, 10 ** 37 + 1, 1, 2, 3])])
def test_ids_of_any_type_stay_as_they_are(spark, kind, ids):
    from decimal import Decimal

    own = [Decimal(i) if kind.startswith("dec") and i is not None else i for i in ids]
    rows = [(k, "one two " * n, n % 5, "extra") for n, k in enumerate(own)]
    df = spark.createDataFrame(rows, f"row_id {kind}, text string, fold int, data string").coalesce(1)
    got = lmscore.log_scores(df)
    assert got.schema["row_id"].dataType == df.schema["row_id"].dataType
    assert sorted(((r["row_id"], r["n_tokens"]) for r in got.collect()), key=str) == sorted(((k, 2 * n + 1) for n, k in enumerate(own)), key=str)


def test_query_with_null_and_large_ids(spark, tmp_path):
    from vigil.llm.queries import QUERIES

    rows = [(None, "a b"), (2 ** 60 + 1, "a"), (7, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_lm_score"](spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted([(None, 3), (2 ** 60 + 1, 2), (7, 1)], key=str)


def test_blocks_take_several_batches(spark):
    """Of 3,000 short rows, handed over 100 at a time, one block; before, a block for each batch, each with its own keys."""
    df = spark.range(3000).selectExpr("id as row_id", "concat('some words and one more w', id % 7) as text", "0 as role").coalesce(1)
    name, own = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "100")
    try:
        streams, requests = lmscore._blocks(df, 1, True).collect(), lmscore._blocks(df, 1, False).collect()
    finally:
        spark.conf.set(name, own)
    assert [r["kind"] for r in streams] == ["s"] and [r["kind"] for r in requests] == ["u", "b"]
    assert len({r["block"] for r in streams + requests}) == 1 and len(streams[0]["roles"]) == 3000


def test_blocks_do_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [None if n % 11 == 0 else "é" * rng.randrange(9) if n % 50 else "long " * 40 for n in range(400)]
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "row_id": list(range(400))})
    want = None
    for step in (1, 3, 64, 400):
        got = [b.to_pydict() for b in lmscore._gathered((whole.slice(i, step) for i in range(0, 400, step)), 100)]
        assert [i for b in got for i in b["row_id"]] == list(range(400)) and [t for b in got for t in b["text"]] == texts
        assert all(len(b["text"]) == 1 or sum(len((t or "").encode()) for t in b["text"]) <= 100 or b["text"][0] == "long " * 40 for b in got)
        assert got == (want := want or got)


def test_values_of_any_order_travel_sorted():
    values = np.array([7 << 24 | 5, 3, 0xFFFFFFFF, 3, 0], np.uint32)
    for v in (values, values[:0]):
        packed = lmscore._sorted_pack(v)
        assert np.cumsum(lmscore._unpack(packed, np.uint32), dtype=np.uint32).tolist() == sorted(v.tolist())
    many = np.random.default_rng(1).integers(0, 1 << 24, 2000).astype(np.uint32)
    assert len(lmscore._sorted_pack(many)) < 0.7 * len(lmscore._pack(many))
