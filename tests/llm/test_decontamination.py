"""Decontamination against brute force, with short items, nulls, repeats and block borders."""

import hashlib
import random
import re

from vigil.llm.decontamination import BLOCK, WORD, contamination


def brute(docs, items, span=10):
    words = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(len(v), span)
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[s:s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(item_id) if item_id is not None else "null")
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)] + ["É", "ß", "x-y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([12, 30, 3, 10, 9])] + [(7, None), (8, "  "), (2, "Zz"), (None, "Only null")]
    long = say(BLOCK - 5) + " " + items[1][1].upper() + " " + say(BLOCK)
    docs = [(1, long), (2, items[0][1]), (2, items[0][1]), (3, None), (4, ""), (None, "a zz! ONLY, null"), (5, say(200)),
            (6, items[0][1].replace(" ", " -- ", 3)), (7, say(4) + " " + items[3][1])]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id bigint, text string, n_hit int")
    b = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, span string")
    got = contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    none = contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert contamination(d.limit(0), b).count() == 0


def test_own_columns_stay(spark):
    """Columns with the names that the join makes for itself come back as they were."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "k", 3, [4]), (2, None, "m", None, None)],
                                 "doc_id int, text string, __key string, __hit int, __ids array<int>")
    items = spark.createDataFrame([("x", "b c d e f g h i j k")], "item_id string, text string")
    got = contamination(docs, items).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_hit"], r["__key"], r["__hit"], r["__ids"]) for r in got] == [(1, 10, "k", 3, [4]), (2, 0, "m", None, None)]
