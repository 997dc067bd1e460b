"""Substring dedup against a sequential version, and its resistance to shifts."""

import random
import tracemalloc

import pyarrow as pa

from vigil.llm import chunkdedup as cd
from vigil.llm.common import written
from vigil.llm.wordspans import flat, parts

SPACES = b" \t\n\x0b\x0c\r"


def borders(text: bytes) -> list[int]:
    """Chunk borders by the rule as stated, one byte at a time."""
    h = []
    for i in range(len(text)):
        h.append(sum(int(cd.GEAR[b]) << (4 * k) for k, b in enumerate(reversed(text[max(0, i - 15):i + 1]))) % 2 ** 64)

    def moved(at):
        near = next((i + 1 for i in range(at - 1, min(at + cd.SNAP, len(text))) if text[i] in SPACES and i + 1 - at <= cd.SNAP), None)
        if near is not None:
            return near
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    cuts = {0, len(text)}
    for i in range(len(h)):
        around = h[max(0, i - cd.REACH):i] + h[i + 1:i + 1 + cd.REACH]
        if all(h[i] < x for x in around) and i + 1 < len(text):
            cuts.add(moved(i + 1))
    out = sorted(cuts)
    for a, z in zip(out[:-1], out[1:]):
        cuts.update(min(moved(x), len(text)) for x in range(a + cd.LONGEST, z, cd.LONGEST))
    return sorted(cuts)


def say(rng, n):
    return " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_borders_like_the_rule():
    rng = random.Random(2)
    texts = ["", "x", say(rng, 400), "a" * 10000, "é" * 6000, say(rng, 3) + "\n" * 300 + say(rng, 90), None, say(rng, 2500)]
    got = cd.chunks(pa.array(texts))
    for t, own in zip(texts, got):
        assert own.tolist() == (borders(t.encode()) if t else [0])
        for a in own.tolist()[1:-1]:
            t.encode()[:a].decode()


def test_shift_resistance():
    rng = random.Random(3)
    text = say(rng, 2000)
    one, two = (set(map(tuple, [(t.encode()[a:z],) for a, z in zip(b[:-1], b[1:])])) for t, b in
                ((t, cd.chunks(pa.array([t]))[0].tolist()) for t in (text, "new words " + text[:3000] + "inserted" + text[3000:])))
    assert len(one - two) <= 6


def test_later_copies_go(spark):
    rng = random.Random(4)
    passage, other = say(rng, 60), say(rng, 200)
    rows = [(5, say(rng, 50) + "\n" + passage + "\n" + say(rng, 50)), (3, say(rng, 30) + "\n" + passage), (9, other), (10, other), (9, other),
            (7, None), (8, ""), (None, say(rng, 100)), (11, say(rng, 100) + " " + passage + " " + passage), (12, "of the"), (13, "of the")]
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id bigint, text string, source string, n_chunks int")
    got = cd.deduplicate(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans"}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    texts = dict(rows)
    for k in (3, None, 8, 12, 13):
        assert by[k][0]["text"] == texts[k] and by[k][0]["n_removed"] == 0
    assert by[3][0]["n_repeated"] > 150 and by[7][0]["text"] is None
    assert [r["text"] for r in by[9]] == [other, other] and by[10][0]["text"] == "" and by[10][0]["n_spans"] == 1
    assert by[5][0]["n_removed"] > len(passage.encode()) - 150 and by[11][0]["n_removed"] > 2 * len(passage.encode()) - 300
    for r in got:
        assert r["n_bytes"] - r["n_removed"] == len((r["text"] or "").encode())
    assert cd.deduplicate(df.limit(0)).count() == 0


def test_passages_of_just_over_fifty_words_go_whole(spark):
    """In every later document, wherever the cuts fall; over many seeds."""
    rows, left = [], {}
    for seed in range(300):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
        words = lambda n: " ".join(word() for _ in range(n))
        passage = words(51)
        for i in range(3):
            around = words(40), words(40)
            rows.append((3 * seed + i, around[0] + "\n" + passage + "\n" + around[1]))
            left[3 * seed + i] = rows[-1][1] if i == 0 else around[0] + around[1]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["text"].replace("\n", "") for r in cd.deduplicate(df).collect()}
    assert [k for k in left if got[k] != left[k].replace("\n", "")] == []


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b", "k", 2, "m", "h", 5)], "doc_id bigint, text string, text_key string, __id int, __marks string, held string, n_bytes int")
    (r,) = cd.deduplicate(df).collect()
    assert (r["text_key"], r["__id"], r["__marks"], r["held"], r["n_bytes"]) == ("k", 2, "m", "h", 3)


def test_the_end_of_a_passage_goes_however_far_the_last_cut(spark):
    """The passage ends in bytes without any cut, many more than a usual chunk has; and in another text it does not."""
    rng = random.Random(11)
    passage = say(rng, 60) + " " + "a" * 900
    rows = [(1, say(rng, 40) + "\n" + passage + " " + say(rng, 40)), (2, say(rng, 40) + "\n" + passage + "\n" + say(rng, 40))]
    got = {r["doc_id"]: r for r in cd.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_spans"] == 1
    assert got[2]["text"].replace("\n", "") == rows[1][1].replace(passage, "").replace("\n", "")


def test_whole_copies(spark):
    """Equal texts: the least doc_id stays, null before all; short texts stay; a row met twice is one document."""
    rng = random.Random(12)
    one, two = say(rng, 80), say(rng, 80)
    rows = [(4, one), (2, one), (9, one), (2, one), (7, two), (None, two), (5, "a few words"), (6, "a few words"), (8, one + "\n" + two)]
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"], r["n_repeated"]) for r in cd.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    n, m = len(one.encode()), len(two.encode())
    assert [g[:3] for g in got[:7]] == [(0, two, 0), (2, one, 0), (2, one, 0), (4, "", n), (5, "a few words", 0), (6, "a few words", 0), (7, "", m)]
    assert got[7][0] == 8 and got[7][1].strip() == ""
    assert [g[3] for g in got[:4]] == [m, n, n, n]


def test_slices_take_little_memory():
    rng = random.Random(3)
    column = pa.array([" ".join(f"w{rng.randrange(9000)}" for _ in range(300)) for _ in range(1200)])
    assert len(flat(column)[0]) > 2_000_000
    tracemalloc.start()
    try:
        found = [own for lo, hi in parts(column, cd.PART) for own in cd.chunks(column.slice(lo, hi - lo))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
    assert all((a == b).all() for a, b in zip(found, cd.chunks(column), strict=True))


def test_intermediate_tables_are_written_in_small_batches(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        for own, most in (("10000", 1024), ("0", 1024), ("300", 300)):
            spark.conf.set(rows, own)
            got = [r["n"] for r in written(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
            assert sum(got) == 5000 and max(got) == most and spark.conf.get(rows) == own
    finally:
        spark.conf.set(rows, before)


def test_marks_are_grouped_once(spark, monkeypatch):
    """All marks of a text, and whether it has copies, meet in one shuffle; before, marks were grouped, and the groups once more."""
    plans, own = {}, cd.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return own(df, name)

    monkeypatch.setattr(cd, "written", seen)
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage = say(80)
    texts = [say(20) + " " + passage + " " + say(20), say(20) + " " + passage + " " + say(20), say(30)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[2], texts[0]])), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in cd.deduplicate(df).collect()}
    top, _, below = plans["found"].partition("Union")
    assert top.count("Exchange") == 1 and "collect_set(mark" in top and "collect_set(mark" not in below
    assert [got[k]["n_removed"] > 0 for k in range(5)] == [False, True, False, True, True] and got[3]["text"] == got[4]["text"] == ""
    assert got[2]["n_repeated"] == len(texts[2]) and got[0]["n_repeated"] == len(texts[0])
