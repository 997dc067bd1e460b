"""Importance resampling against features listed one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [" ".join(p) for p in zip(w, w[1:])]]


def brute(docs, items):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for _, x in items:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(w), hashlib.md5((text or "").encode()).hexdigest()])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for i, r in enumerate(enough[:25 * len(enough) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("max_words", [0, 5, 1 << 16])
def test_against_brute_force(spark, max_words):
    rng = random.Random(6)
    vocab = ["Alpha", "beta", "É", "x" * 90, "x" * 70, "日本", "a", "ab", "9", "zz"] + [f"t{i}" for i in range(40)]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - ", "\x00", "\x01 "]) for _ in range(n))
    docs = [(rng.choice([None, *range(90)]), say(rng.choice([1, 19, 20, 60]))) for _ in range(150)] + [(200 + i, "same words " * 15) for i in range(60)]
    docs += [(3, None), (4, ""), (5, " .,\x00"), (6, "one"), (None, None), (7, say(30)), (8, "y" * 100000 + " z"), (9, "ends\x00"), (10, "\x00starts here")]
    items = [(1, say(40)), (2, None), (3, "beta Beta"), (3, "")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, weight int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = resampling.resampled(d, b, max_words=max_words)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b " * 20, "x"), (2, None, "y")], "doc_id long, text string, key string")
    b = spark.createDataFrame([], "item_id long, text string")
    rows = resampling.resampled(d, b).collect()
    assert sorted((r["doc_id"], r["n_features"], r["key"]) for r in rows) == [(1, 79, "x"), (2, 0, "y")]
    assert resampling.resampled(d.limit(0), b).count() == 0


def test_composed_crc():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(30)), rng.randbytes(n)) for n in (0, 1, 5, 63, 64, 65, 66, 1000, 70001)]
    got = resampling.advanced(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert [int(g) ^ zlib.crc32(b) for g, (_, b) in zip(got, pairs)] == [zlib.crc32(a + b) for a, b in pairs]


def test_payloads_do_not_depend_on_the_dictionary():
    column = pa.array(["the they then he", None, "the", "", "he,the;THE", "zz"])
    want = [[sorted(features(t)[1])] for t in column.to_pylist()]
    for words in (b"", b"the", b"he the then", b"the they then he zz"):
        bucket, row, n = resampling.scanned(column, words)
        assert [[sorted(bucket[row == i].tolist())] for i in range(6)] == want
        assert n.tolist() == [4, 0, 1, 0, 3, 1]
