"""The pipeline, stage by stage, against brute force on a small corpus."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import brute as windows
from tests.llm.test_neardup import brute as components
from tests.llm.test_quality import base
from vigil.llm import bpe, neardup, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    passage = say(70)
    rows = [(i, say(rng.randrange(40, 160))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(120 + i, rows[i][1] + " end") for i in range(5, 9)]
    rows += [(200 + i, say(40) + "\n" + passage + "\n" + say(40)) for i in range(5)] + [(210 + i, say(60) + " " + items[i][1] + " " + say(60)) for i in range(3)]
    rows += [(300, None), (301, ""), (302, "too short"), (303, "again and again " * 60), (304, say(50) + "***")] + [(310 + i, " ".join(w + "***" for w in say(60).split())) for i in range(12)]
    rows += [(0, rows[0][1]), (None, say(90))]
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, int("***" not in (t or "")), 0) for k, t in rows if k is not None and k not in range(30, 40)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), items


def test_stages(spark, folder):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d).cache()
        at[name] = ([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect())
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = at["quality_rules"]
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    p = {r["text"]: r["probability"] for r in quality.score(spark.read.parquet(f"{d}/documents.parquet"), model).collect()}
    fine = lambda t: base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0] and p[t] >= 0.5
    assert sorted((str(r["doc_id"]), r["text"]) for r in after) == sorted((str(k), t) for k, t in before if fine(t))
    assert not {300, 301, 302, 303, *range(310, 322)} & {r["doc_id"] for r in after} and len(after) >= 55

    before, after = at["near_dedup"]
    assert len(after) == len({(k, c) for k, _, c, _ in components(before) if k == c}) and len({r["doc_id"] for r in after}) == len(after)
    assert {r["doc_id"] for r in after} == {c for _, _, c, _ in components(before)}

    before, after = at["substring_dedup"]
    texts = dict(before)
    left = {r["doc_id"]: r for r in after}
    assert set(left) == set(texts)
    assert left[200]["text"] == texts[200]
    for i in range(201, 205):
        assert len(left[i]["text"]) < len(texts[i]) - 100 and left[i]["n_chars"] == len(left[i]["text"])
    assert all(left[k]["text"] == t for k, t in texts.items() if k is None or k < 200)

    before, after = at["decontamination"]
    bad = {k for k, _, _, _, _, hit in windows(before, items) if hit}
    assert bad == {210, 211, 212} and {r["doc_id"] for r in after} == {k for k, _ in before} - bad

    before, after = at["byte_bpe"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(public_tokenizers.path(corpus_pipeline.BPE_RANKS)).ranks, special_tokens={})
    got = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for k, t in before:
        assert got[k]["token_ids"] == enc.encode_ordinary(t) and got[k]["n_tokens"] == len(got[k]["token_ids"]) and got[k]["round_trip"]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, d).collect()) == sorted(str(r["doc_id"]) for r in after)


def test_near_dedup_goes_by_component(spark):
    """Unrelated texts stay, under no doc_id or under one; near-copies go, whatever their doc_ids."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c, d, e = (say(60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, b + " end"), (7, c), (7, d), (7, d), (8, d + " end"), (None, c), (9, e), (9, e + " end"), (None, None), (5, "")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    first = lambda *texts: min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(got, key=str) == sorted([(None, a), (None, first(b, b + " end")), (7, c), (7, d), (9, first(e, e + " end")), (None, None), (5, "")], key=str)


def test_near_dedup_links_at_80_percent(spark):
    """A pair at 0.82 is one in the pipeline, and two for op10; one at 0.78 is two in both."""
    rng = random.Random(6)
    words = [[f"w{rng.randrange(1 << 30)}" for _ in range(104)] for _ in range(2)]  # 100 shingles, of which the last n are changed
    texts = [(2 * i + j, " ".join(w if j == 0 else w[:104 - n] + [f"x{k}" for k in range(n)])) for i, (w, n) in enumerate(zip(words, (10, 12))) for j in range(2)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2, 3]
    assert neardup.near_duplicates(df, 85).where("kept").count() == 4


def test_columns_of_any_name_are_carried(spark, folder):
    d, _ = folder
    more = {"text_key": "k", "__text_key": "m", "n_words": "w", "kept": "x", "n_hit": "h", "carried": "c", "__key": "y", "a.b": "z"}
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id is not null")
    for name, mark in more.items():
        docs = docs.withColumn(name, F.concat(F.lit(mark), F.col("doc_id").cast("string")))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == names, name
        rows = docs.collect()
        assert rows and all(r[n] == f"{m}{r['doc_id']}" for r in rows for n, m in more.items()), name
    assert corpus_pipeline.byte_bpe(spark, docs, d).count() == len(rows)


def _shuffled_rows(df):
    """The rows that the shuffles of a frame's last job wrote, for each shuffle."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                out.append(node.metrics().get("shuffleRecordsWritten").get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_near_dedup_leaves_texts_that_have_no_mark_where_they_are(spark):
    """Of 400 texts with 10 copies, only the marked ones are shuffled to meet the marks; before, all 410 were."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(1 << 30)}" for _ in range(n))
    rows = [(k, say(30)) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(10)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    name, own = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, df, "")
        moved = _shuffled_rows(out)
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(400))
    finally:
        spark.conf.set(name, own)
    assert moved and max(moved) <= 20, moved
