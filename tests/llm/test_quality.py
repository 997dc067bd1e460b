"""Quality rules: base counts against brute force, accuracy on held-out labels."""

import collections
import random
import re
import tracemalloc

import numpy as np

from vigil.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    rng = random.Random(5)
    say = lambda n, k: " ".join(rng.choice(["a", "bé", "日本", "d#", "<e>"][:k]) for _ in range(n))
    texts = [None, "", " \n\t ", "a\na\n \n a\na", say(40, 2), say(300, 5), "\n".join([say(9, 3)] * 30), "x" * 300000 + " y", "   z",
             " ".join(f"w{i}" for i in range(400000))]
    model = quality.Model(__import__("numpy").zeros(3 << quality.BITS), 0.0, 1.0, 5.0)
    df = spark.createDataFrame([(i % 6, t, "q") for i, t in enumerate(texts)], "doc_id int, text string, kept string")
    rows = quality.score(df, model).collect()
    assert sorted((r["text"] or "", *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in rows) \
        == sorted((t or "", *base(t)) for t in texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert quality.score(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    good = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        q = i % 2
        docs.append((i, " ".join(rng.choice(good) + ("" if q else rng.choice(["***", "$$$", ""])) for _ in range(60))))
        if i < 200:
            labels.append((i, q))
    d = spark.createDataFrame(docs + [(None, None)], "doc_id bigint, text string")
    model = quality.train(d, spark.createDataFrame(labels + [(None, 1), (3, None), (9999, 0)], "doc_id bigint, quality int"), epochs=60)
    p = {r["doc_id"]: r["probability"] for r in quality.score(d, model).collect()}
    assert sum((p[i] >= 0.5) == (i % 2 == 1) for i in range(200, 400)) >= 195
    nothing = quality.train(d, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert all(r["kept"] for r in quality.score(d, nothing).collect() if not r["base_failed"])


def test_training_sums_in_blocks_are_the_same(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(1))
    length = rng.integers(0, 300, 400)
    first = np.concatenate([[0], np.cumsum(length)])
    row, n, size = np.repeat(np.arange(400), length), int(first[-1]), 50
    col, val, w, err = rng.integers(0, size, n).astype(np.int32), rng.random(n).astype(np.float32), rng.normal(size=size), rng.normal(size=400)
    monkeypatch.setattr(quality, "BLOCK", 1000)
    assert (quality._sums_by_text(w, col, val, first) == np.bincount(row, val * w[col], 400)).all()
    assert (quality._sums_by_feature(err, col, val, first, size) == np.bincount(col, val * err[row], size)).all()
    monkeypatch.setattr(quality, "BLOCK", 10_000)
    col, val, first = np.tile(col, 40), np.tile(val, 40), np.concatenate([[0], np.cumsum(np.tile(length, 40))])
    err = np.tile(err, 40)
    tracemalloc.start()
    try:
        quality._sums_by_text(w, col, val, first)
        quality._sums_by_feature(err, col, val, first, size)
        assert tracemalloc.get_traced_memory()[1] < 4 * len(col)  # before: 16 bytes an entry and more
    finally:
        tracemalloc.stop()
