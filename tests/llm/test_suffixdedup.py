"""Exact substring removal against brute force."""

import collections
import hashlib
import random

import pytest

from vigil.llm import suffixdedup as sd


def brute(rows):
    seen = collections.Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        seen.update(t[i:i + 200] for i in range(len(t) - 199))
    out = []
    for (k, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def say(rng, n):
    return "".join(rng.choice("abcdefghij éß日") for _ in range(n))


@pytest.mark.parametrize("hot", [20000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(8)
    passages = [say(rng, n) for n in (150, 185, 199, 201, 220, 260, 400, 1500)]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 450), (None, say(rng, 300))]
    for i in range(60):
        body = [say(rng, rng.randrange(1, 400))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(40)
            body += [p[a:] if rng.random() < 0.5 else p, say(rng, rng.choice([0, 1, 30, 250]))]
        rows.append((10 + i, "".join(body)))
    copy = say(rng, 900)
    rows += [(100 + i, copy) for i in range(4)] + [(104, copy[:450] + "!" + copy[450:]), (105, copy[:300] + say(rng, 90) + copy[300:500]), (100, copy)]
    rows += [(200, "ab" * 700 + say(rng, 50)), (201, passages[6] + passages[7] + passages[6]), (202, passages[7][:210])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, n_spans int").repartition(3)
    got = sd.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sd.removed(df.limit(0)).count() == 0


def test_exact_copies_send_their_contexts_once(spark, monkeypatch):
    """However many copies of a text there are, a context to compare goes to its trigger once."""
    rng = random.Random(9)
    copy = say(rng, 900)
    rows = [(i, copy) for i in range(40)] + [(50, copy[:450] + "!" + copy[450:]), (51, copy[:300] + say(rng, 90) + copy[300:500])]
    sent = []
    compared = sd._compared
    monkeypatch.setattr(sd, "_compared", lambda rows, n: (sent.extend(r["context"] for r in rows.select("context").collect()), compared(rows, n))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sd.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sent and len(sent) == len(set(sent))
