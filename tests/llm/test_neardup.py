"""Near-duplicates against brute force, with nodes made small so that every way of splitting them is taken."""

import random
import re

import pytest

from vigil.llm import neardup
from vigil.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and 100 * n >= 85 * (len(s[i]) + len(s[j]) - n):
                root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if s[i] else k
        out.append((k, len(s[i]), least, k == least))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    say = lambda n: [f"W{rng.randrange(500)}" for _ in range(n)]
    rows, base = [], say(120)
    for i in range(60):  # a chain of copies: each is changed a little against some earlier one
        own = list(rng.choice([r for _, r in rows]) if rows and i % 3 else base)
        own[rng.randrange(120)] = f"new{i}"
        rows.append((100 - i, own))
    rows = [(k, " ".join(w)) for k, w in rows]
    rows += [(200 + i, " ".join(say(80))) for i in range(20)]
    rows += [(300, "a b c"), (301, "A  b\nc"), (302, "a b"), (303, None), (304, ""), (305, " \t"), (None, rows[0][1]), (None, "only here of all"), (300, "a b c")]
    rows += [(400 + i, rows[5][1]) for i in range(5)] + [(500, " ".join(say(30000)))]
    return rows


@pytest.mark.parametrize("node,levels", [(1024, 4), (8, 4), (4, 0)])
def test_against_brute_force(spark, monkeypatch, node, levels):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "LEVELS", levels)
    rows = corpus()
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, cid int")
    got = neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(k, n, c, k == c) for k, n, c, _ in brute(rows)]
    assert sorted(map(tuple, got), key=str) == want


def test_pairs_in_large_nodes(spark, monkeypatch):
    """Pairs around a hot passage, with nothing but large nodes: what falls apart in one tree stays together in another."""
    for name, value in {"NODE": 30, "LEVELS": 1, "BRANCHES": 1}.items():
        monkeypatch.setattr(neardup, name, value)
    rows = []
    for seed in range(120):
        rng = random.Random(seed)
        hot = [f"hot{i}" for i in range(114)]
        own = [f"w{rng.randrange(1 << 40)}" for _ in range(12)]
        changed = own[:3] + [f"w{rng.randrange(1 << 40)}" for _ in range(9)]
        rows += [(2 * seed, " ".join(hot + own)), (2 * seed + 1, " ".join(hot + changed))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert [k for k in got if got[k] != k - k % 2] == []


def test_empty_and_components(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(empty).count() == 0
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "a string, b string")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"} | {f"n{i:03}": "n000" for i in range(41)}
