"""The filter audit against filters applied one after the other, row by row."""

import itertools
import random
import re

import pytest

from vigil.llm import filteraudit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(docs):
    out = []
    for doc_id, text, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                    "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, *_ in docs)})
    return out


def brute(docs, labels):
    fails = failures(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                found.append((order, i + 1, len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        rows += [(part, *r, shapley[r[0][r[1] - 1]]) for r in found]
    return sorted(rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    say = lambda n, k: " ".join(f"w{rng.randrange(k)}é" for _ in range(n))
    texts = [None, "", " \n\t", "A B", say(199, 1000), say(200, 1000), "x " * 200, say(300, 100), say(250, 5000) + " #", "QUITE LOUD " + say(220, 4000), "ÀÉ " * 100]
    texts += [say(rng.choice([150, 210]), rng.choice([60, 3000])) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 8]) for _ in range(30)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", "", None]), 1) for _ in range(250)]
    docs += [(70 + i, texts[5], "en", 1) for i in range(150)] + [(5, texts[7], "de", 1)] * 3 + [(None, texts[5], "fr", 1)] * 2
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_against_brute_force(spark, corpus):
    docs, labels = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int").repartition(3)
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filteraudit.audit(d, b)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)


def test_empty_tables(spark, corpus):
    docs, _ = corpus
    d = spark.createDataFrame(docs[:20], "doc_id long, text string, lang string, mask int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(d.limit(0), none).count() == 0
    assert sorted(map(tuple, filteraudit.audit(d, none).collect())) == brute(docs[:20], [])


def test_labels_are_no_broadcast(spark, corpus, tmp_path):
    """However small their file is: they are salted, and grow with the documents."""
    docs, labels = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    plan = filteraudit.mask_counts(d, spark.read.parquet(str(tmp_path / "labels")))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "salt" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_swaps_keep_the_diagram_right():
    rng = random.Random(1)
    counts = {m: (rng.randrange(4), rng.randrange(2), 0) for m in rng.sample(range(32), 20)}
    diagram, orders = filteraudit.Diagram(counts), {"ABCDE"}
    for level in filteraudit.adjacent_swaps(5):
        diagram.swap(level)
        orders.add("".join(diagram.order))
        fresh = filteraudit.Diagram(counts, "".join(diagram.order))
        assert list(diagram.steps()) == list(fresh.steps())
        assert [len(x) for x in diagram.shared[:-1]] == [len(x) for x in fresh.shared[:-1]]
    assert len(orders) == 120


def test_long_texts_by_pieces(monkeypatch):
    text = (" ".join(f"w{i % 700}" for i in range(5000)) + "\n").encode()
    whole = filteraudit._words(text)
    for size in (1, 7, 1000, len(text) - 1):
        monkeypatch.setattr(filteraudit, "PIECE", size)
        assert filteraudit._words(text) == whole == (5000, 700)
