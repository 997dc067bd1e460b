"""Steps that work in the task that holds the texts: the same results as word by word, with fewer shuffles and no sorts."""

import io
import math
import random
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.functions import vocab
from vigil.operators import counts as C
from vigil.operators import features as FE
from vigil.operators import training as TR
from vigil.operators import views as V
from vigil.operators.extract import extract_facts, file_facts, stored_facts
from vigil.sources import files as S

TEXTS = [("p", "os.system('rm') eval the the the"), ("p", None), ("p", "Ünicode größer the K\u212a \U0001f600 eval"), ("q", ""),
         ("q", "https://x.y/a\u00a0b deadbeefdeadbeef01 import os"), (None, "a word without package"), ("r", "x"), ("p", "os.system the")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): round(r[columns[-1]], 9) for r in df.collect()}


def test_word_totals_are_word_counts_with_one_shuffle(spark):
    df = spark.createDataFrame(TEXTS * 300, "package_id string, text string").repartition(3)
    for hash in ("md5", "blake2b"):
        slow = FE.hashed_counts(FE.word_counts(df.withColumn("piece", F.lit(0))), "code", None, 10, hash=hash)
        fast = FE.hashed_counts(FE.word_totals(df, hash=hash), "code", None, 10, hash=hash)
        assert values(fast, "package_id", "feature", "value") == values(slow, "package_id", "feature", "value")
    assert plan(FE.hashed_counts(FE.word_totals(spark.read.schema("package_id string, text string").json("/dev/null")), "code", None, 10)).count("Exchange") == 1


def test_text_cells_are_signed_hashes_of_tokens(spark):
    df = spark.createDataFrame(TEXTS * 300, "package_id string, text string").repartition(3)
    slow = V.signed_hash_sparse(V.text_tokens(df, "code"))
    fast = V.normalised(V.text_cells(df, "code"))
    assert values(fast, "package_id", "view", "dim", "value") == values(slow, "package_id", "view", "dim", "value")
    want = Counter()
    for p, t in TEXTS * 300:
        if p == "p" and t:
            for token in ("os", "system", "rm", "eval", "the", "nicode", "gr", "er", "kk"):
                n = {"os": t.count("os."), "system": t.count("system"), "rm": t.count("rm"), "eval": t.count("eval"), "the": t.count("the")}.get(token, int("Ü" in t))
                b, s = T.buckets_of([token], 768)[0], T.buckets_of(["sign:" + token], 2)[0]
                want[b] += n if s == 0 else -n
    norm = math.sqrt(sum(v * v for v in want.values()))
    got = {r["dim"]: r["value"] for r in fast.where("package_id = 'p'").collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d] / norm) < 1e-9 for d in want)
    (dense,) = V.densify(fast.where("package_id = 'p'")).collect()
    assert len(dense["vector"]) == 768 and all(abs(dense["vector"][d] - v) < 1e-12 for d, v in got.items()) and sum(map(bool, dense["vector"])) == sum(map(bool, got.values()))


def test_vectors_take_one_shuffle(spark):
    df = spark.read.schema("package_id long, text string").json("/dev/null")
    assert plan(V.densify(V.normalised(V.text_cells(df, "code")))).count("Exchange") == 1


def test_snippet_features_are_those_of_the_joined_text(spark):
    rows = {r["package_id"]: r for r in FE.snippet_features(spark.createDataFrame(TEXTS, "package_id string, text string").repartition(3)).collect()}
    for p in ("p", "q", "r"):
        own = [t or "" for k, t in TEXTS if k == p]
        text = "\n".join(own)
        h = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
        occ = sum(t.lower().count(w) for t in own for w in vocab.SUSPICIOUS_WORDS)
        assert abs(rows[p]["snippet_entropy"] - h / 8) < 1e-9 and abs(rows[p]["snippet_suspicious_words"] - occ / 50) < 1e-9
        assert rows[p]["snippet_n"] == len(own)
    assert rows[None]["snippet_n"] == 1 and rows[None]["snippet_entropy"] == 0


def test_entropies_of_many_strings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé日\U0001f600 ") for _ in range(rng.randrange(80))) for _ in range(1500)]
    got = T.entropies(texts)
    assert all(abs(g - -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())) < 1e-9 for g, t in zip(got, texts))
    df = spark.createDataFrame([(t,) for t in [*texts[:50], None, ""]], "s string")
    assert all((r["a"] is None) == (r["s"] is None) and abs((r["a"] or 0) - r["b"]) < 1e-9
               for r in df.select("s", T.string_entropy("s").alias("a"), T.shannon_entropy("s").alias("b")).collect())


def test_facts_are_stored_without_a_sort(spark, monkeypatch):
    seen = []
    writer = type(spark.range(1).write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path: (seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")), write(self, path))[1])
    units = spark.createDataFrame([("p", "a.py", "import os\nos.system('x')\n")], "package_id string, path string, text string")
    facts = stored_facts(extract_facts(units))
    assert {r["kind"] for r in facts.collect()} == {"file", "import", "call", "snippet", "string"}
    assert int(seen[0]) > 8 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert C.package_scalars(facts).first()["python_files"] == 1


def test_deep_code_and_scopes():
    deep = "x = " + "-" * 500 + "1\n"
    assert [f[1] for f in file_facts("d.py", deep)] == ["file"]
    f = file_facts("p.py", "@deco(a())\ndef f(x=g()):\n  with h() as y:\n    class A:\n      async def m(self): return [i() for i in z]\n  k()\nl()\n")
    assert [(x[2], x[3]) for x in f if x[1] == "call"] == [("g", "p.py:f"), ("h", "p.py:f"), ("i", "p.py:m"), ("k", "p.py:f"), ("deco", "p.py:f"), ("a", "p.py:f"), ("l", "<module>")]


def test_training_reads_its_features_once(spark):
    runs = spark.sparkContext.accumulator(0)
    def count(batches):
        runs.add(1)
        yield from batches
    x = spark.createDataFrame([("a", "f", 1.0), ("b", "g", 2.0)], "package_id string, feature string, value double").coalesce(1)
    x = x.mapInArrow(count, x.schema)
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "package_id string, label int")
    assert TR.gradient_descent(x, labels, epochs=2).count() == 3 and runs.value == 1


def test_a_small_archive_is_one_stretch(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(40):
            z.writestr(f"m{i}.py", f"x = {i}\n")
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    import pandas as pd
    frame = pd.DataFrame({"path": ["a.zip"], "size": [len(out.getvalue())], "root": [str(tmp_path)]})
    members = pd.concat(S._directories(iter([frame])))
    assert len(members) == 40 and set(members["part"]) == {0}
    assert {(r["path"], bytes(r["content"])) for r in S.scan_archives(spark, str(tmp_path)).collect()} == {(f"m{i}.py", f"x = {i}\n".encode()) for i in range(40)}


def token_views(metadata, snippets, edges, hash="md5", **kw):
    """The view matrix with a row for each token of the graphs and each cell of the vectors."""
    cells = (V.text_cells(V.metadata_lines(metadata), "metadata", hash=hash).unionByName(V.text_cells(snippets, "code", hash=hash))
             .unionByName(V.token_cells(V.graph_view_tokens(edges, **kw), hash=hash)))
    return V.densify(V.normalised(cells))


def vectors(df):
    return {(r["package_id"], r["view"]): tuple(r["vector"]) for r in df.collect()}


def a_corpus(spark):
    rng = random.Random(5)
    texts = spark.createDataFrame(TEXTS * 40, "package_id string, text string").repartition(3)
    fields = spark.createDataFrame([("p", "name", "os"), ("q", "name", None), ("s", "summary", "fast cache")], "package_id string, field string, value string")
    edges = [(f"p{i % 9}", rng.choice(["os.system", "a", "", "näh", f"f{rng.randrange(40)}"]), rng.choice(["eval", "b", f"g{rng.randrange(15)}"]), rng.randrange(1, 9)) for i in range(900)]
    edges += [("loop", "a", "a", 2), ("p", "x", "y", 1), ("p", "y", "x", 1), (None, "x", "y", 1)] + [("often", "u", "v", 1)] * 200
    return texts, fields, spark.createDataFrame(edges, "package_id string, src string, dst string, weight long").repartition(4)


def test_view_vectors_are_those_of_the_tokens(spark):
    texts, fields, edges = a_corpus(spark)
    for hash in ("md5", "blake2b"):
        assert vectors(V.view_matrix(fields, texts, edges, hash=hash)) == vectors(token_views(fields, texts, edges, hash=hash))
    nothing = [df.limit(0) for df in (fields, texts, edges)]
    assert V.view_matrix(*nothing).count() == 0


def test_graph_rows_of_large_packages_and_of_unfinished_ranks(spark):
    _, _, edges = a_corpus(spark)
    for kw in ({}, {"max_iter": 3}):
        want = vectors(V.densify(V.normalised(V.token_cells(V.graph_view_tokens(edges, **kw)))))
        for local in (1 << 20, 90, 3):  # all whole; some by joins, some of many rows but few edges; nearly all by joins
            assert vectors(V.unit_vectors(V.graph_rows(edges, local_edges=local, **kw))) == want
    given = V.G.pagerank(edges)
    assert vectors(V.unit_vectors(V.graph_rows(edges, pagerank=given))) == vectors(V.unit_vectors(V.graph_rows(edges)))
    odd = spark.createDataFrame([("p", "a", "b", 1), ("p", None, "b", 1), ("p", "a", None, 1)], "package_id string, src string, dst string, weight long")
    (row,) = V.graph_rows(odd).collect()
    assert {T.buckets_of([t], 768)[0] for t in ("a", "b", "a->b")} >= set(row["dims"])  # null is no token


def test_word_graphs_are_the_pairs_of_words(spark, monkeypatch):
    from vigil.operators import graph as G

    long = " ".join(f"w{i * i % 31}" for i in range(300))
    df = spark.createDataFrame([*TEXTS, ("p", long), ("z", long), ("z", "two words"), ("z", "Two")], "package_id string, text string").repartition(2)
    words = T.embed_tokens("text")
    pairs = F.explode(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    edges = df.select("package_id", pairs.alias("e")).select("package_id", "e.src", "e.dst", F.lit(1).alias("weight")).where("dst is not null")

    def counted(e):
        return Counter({tuple(r)[:3]: r[3] for r in e.groupBy("package_id", "src", "dst").agg(F.sum("weight")).collect()})

    want = counted(edges)
    assert want["z", "two", "words"] == 1 and ("z", "words", "two") not in want
    whole = V.word_graphs(df)
    assert counted(G.edge_rows(whole)) == want
    matrix = vectors(V.unit_vectors(V.graph_rows(edges)))
    assert vectors(V.unit_vectors(V.graph_rows(whole))) == matrix == vectors(V.unit_vectors(V.graph_rows(whole, local_edges=20)))
    for name, n in (("PAIRS", 7), ("TOKENS", 50)):
        monkeypatch.setattr(V, name, n)
    some = V.word_graphs(df)
    assert counted(G.edge_rows(some)) == want and max(sum(r["n"]) for r in some.collect()) <= 7
    for name, n in (("BLOCK_EDGES", 15), ("BLOCK_TEXTS", 2)):
        monkeypatch.setattr(G, name, n)
    assert vectors(V.unit_vectors(V.graph_rows(some))) == matrix


def test_sums_are_given_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "SLOTS", 2)
    rows = [(f"k{i % 7}", "the words of" + " the" * (i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "package_id string, text string").repartition(2)
    assert vectors(V.unit_vectors(V.text_rows(df, "code"))) == vectors(V.densify(V.normalised(V.text_cells(df, "code"))))


def test_views_shuffle_neither_tokens_nor_cells(spark):
    """One shuffle of the edges and one of a row for each package, task and view."""
    texts, fields, edges = a_corpus(spark)
    assert plan(V.view_matrix(fields, texts, edges)).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
