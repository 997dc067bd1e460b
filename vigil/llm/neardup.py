"""Near-duplicates by a chosen-path set similarity join over word shingles.

1. Every text becomes its set of 64-bit shingle hashes. Texts with the same set
   are one *class*; a class carries as many minwise tokens of its set as there are trees.
2. Each of several independent trees puts a class into the node of its own
   minwise token: a pair of similarity J shares the node with probability J.
3. Nodes of at most ``NODE`` classes are compared exhaustively on full sets.
   Larger ones are first cut into chunks, each compared exhaustively; classes
   linked by then count as one, which settles tight groups. Large nodes that still
   hold several components branch on further minwise tokens, two for each node,
   level by level, and nodes with one component left are dropped. The tokens of a
   node are drawn from its path, so neither trees nor branches share any. What is
   still large after ``LEVELS`` levels is compared in blocks: all classes outside
   the node's largest component against all classes, exactly.
4. Links make components, by alternating stars.

A pair falls apart below a node with probability q' = (1 - J + J q) ** BRANCHES, q
being that of the level below (0 at the last). All trees miss it with probability
(1 - J (1 - q)) ** trees at most, when every node it is in is large (``missed``);
where no node is large, q is 0. There are as many trees as bring that to ``MISS``:
six at 85 % (3.0e-5, or 1.1e-5 without large nodes), seven at 80 % (6.0e-5, 1.3e-5).

Comparison in a node needs no more links than join its classes: pairs that are
already connected there are skipped, so a node returns fewer links than classes.
Texts are shipped only to nodes of two classes and more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, extended, maybe_in, partitions_for, written
from .components import components
from .wordspans import flat, grams, lowered, parts, scrambled, words_of

SHINGLE = 5
#: The most probable that a pair of just the similarity asked for may be missed.
MISS = 8e-5
LEVELS, BRANCHES = 4, 2
#: The most classes, and shingles of all of them, that are compared exhaustively at once.
NODE, NODE_SHINGLES = 4096, 4 << 20
#: Bytes of text that are shingled at once; the arrays for it take some 80 times as much.
PART = 1 << 18
_BINS, _MARGIN = 64, 0.25
_PERM = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)


def missed(similarity: float, trees: int) -> float:
    """The most probable it gets that all trees miss a pair of this similarity."""
    apart = 0.0
    for _ in range(LEVELS):
        apart = (1 - similarity * (1 - apart)) ** BRANCHES
    return (1 - similarity * (1 - apart)) ** trees


def trees_for(percent: int) -> int:
    """The number of trees that miss a pair of this similarity with probability ``MISS`` at most."""
    for trees in range(1, _PERM.shape[1] + 1):
        if missed(percent / 100, trees) <= MISS:
            return trees
    raise ValueError(f"{percent} % needs more than {_PERM.shape[1]} trees")


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of every text: of five words, or of all where there are fewer."""
    data, offsets = flat(column)
    words = words_of(data, offsets, lowered())
    gram, inside = grams(words, SHINGLE)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        n = hi - lo
        if n >= SHINGLE:
            out.append(np.unique(gram[lo:hi - SHINGLE + 1]))
        elif n:
            short = words.hash[lo:hi] * _PERM[0, :n]
            out.append(scrambled(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digests(sets: list[np.ndarray]) -> list[str]:
    """A 128-bit digest of each set."""
    return [f"{int(scrambled(s).sum(dtype=np.uint64)):016x}{int(scrambled(s ^ _PERM[1, 0]).sum(dtype=np.uint64)):016x}" for s in sets]


def _tokens(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """The minwise tokens of each set, one column for each permutation; of empty sets 0."""
    out = np.zeros((len(sets), trees), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(trees):
            out[full, k] = np.minimum.reduceat((every ^ _PERM[0, k]) * _PERM[1, k], first)
    return out.view(np.int64)


def _children(own: np.ndarray, path: int, branches: int) -> list[int]:
    """The ``branches`` nodes below ``path`` that a set goes to, by the least of its hashes under permutations drawn from the path."""
    out = []
    for key in scrambled(np.array([path], np.int64).view(np.uint64) + np.arange(1, branches + 1, dtype=np.uint64) * _PERM[1, 0]):
        out.append(int(scrambled(key + scrambled(own ^ key).min(keepdims=True)).view(np.int64)[0]))
    return out


def described(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, text_key (MD5), cid (digest of the set), n_shingles and tokens (one for each tree) of every row."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column("text"))
                tokens = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * trees, trees, dtype=np.int32), _tokens(sets, trees).reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(_digests(sets)),
                                                  pa.array([len(s) for s in sets], pa.int64()), tokens],
                                                 names=["doc_id", "text_key", "cid", "n_shingles", "tokens"])

    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.mapInArrow(run, extended(rows.drop("text"), {"cid": "string", "n_shingles": "long", "tokens": "array<long>"}))


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For sets compared exhaustively: the number of the first set that each is connected with."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.arange(n)
    if n == 2 and 100 * size.min() < percent * size.max():
        return root

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def similar(i, j):
        small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int((large[at] == small).sum())
        return 100 * both >= percent * (size[i] + size[j] - both)

    if n == 2:
        return np.array([0, 0]) if similar(0, 1) else root
    # A sketch by least hash in each of 64 stretches of the hash range orders the pairs and rules out those far below.
    sketch = np.zeros((n, _BINS), np.uint64)
    edges = (np.arange(_BINS, dtype=np.uint64) << np.uint64(58))
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        ok = at < size[i]
        found = np.where(ok, s[np.minimum(at, max(size[i] - 1, 0))], 0) if size[i] else np.zeros(_BINS, np.uint64)
        sketch[i] = np.where(ok & ((found >> np.uint64(58)) == np.arange(_BINS, dtype=np.uint64)), found, 0)
    same, used = np.zeros((n, n), np.int16), np.zeros((n, n), np.int16)
    for k in range(_BINS):
        c = sketch[:, k]
        has = c != 0
        same += (c[:, None] == c[None, :]) & has[:, None]
        used += has[:, None] | has[None, :]
    likely = same / np.maximum(used, 1)
    i, j = np.nonzero(np.triu((likely >= percent / 100 - _MARGIN) & (100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)), 1))
    for x in np.argsort(-likely[i, j], kind="stable"):
        a, b = find(i[x]), find(j[x])
        if a != b and similar(i[x], j[x]):
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def compare(rows: DataFrame, parts_: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is connected within each node, from rows (node, cid, text)."""
    def run(batches):
        node, own, pairs = None, {}, []

        def finish():
            if len(own) > 1:
                cids = sorted(own)
                root = _linked([own[c] for c in cids], percent)
                pairs.extend((cids[i], cids[r]) for i, r in enumerate(root) if r != i)

        def given():
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["a", "b"])
            pairs.clear()
            return out

        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                for n, c, s in zip(part.column("node").to_pylist(), part.column("cid").to_pylist(), shingle_sets(part.column("text"))):
                    if n != node:
                        finish()
                        node, own = n, {}
                    own[c] = s
                if len(pairs) > 10_000:
                    yield given()
        finish()
        yield given()

    return (rows.select("node", "cid", "text").repartition(parts_, "node").sortWithinPartitions("node").mapInArrow(run, "a string, b string"))


def _texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, cid, text) for (node, cid): the text of each class's first row, with the list of its nodes."""
    wanted = nodes.groupBy("cid").agg(F.collect_set("node").alias("nodes")).join(classes.select("cid", "first_id", "text_key"), "cid")
    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    wanted = written(wanted, "wanted")
    near = maybe_in(rows, "key", bitmap(wanted, "text_key"))  # most texts are wanted nowhere, and stay where they are
    return (near.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("text_key")))
            .select("nodes", "cid", "text"))


def _with_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cid, text) for (node, cid): the text is sent once for each node."""
    return _texts_of(docs, classes, nodes).select(F.explode("nodes").alias("node"), "cid", "text")


def _branched(docs: DataFrame, classes: DataFrame, level: DataFrame) -> DataFrame:
    """(path, cid, n_shingles) of the nodes below those of ``level`` (path, cid)."""
    branches = BRANCHES

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                rows = []
                for nodes, c, own in zip(part.column("nodes").to_pylist(), part.column("cid").to_pylist(), shingle_sets(part.column("text"))):
                    rows += [(child, c, len(own)) for path in nodes for child in _children(own, path, branches)]
                paths, cids, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), pa.array(cids, pa.string()), pa.array(sizes, pa.int64())],
                                                 names=["path", "cid", "n_shingles"])

    rows = _texts_of(docs, classes, level.select(F.col("path").alias("node"), "cid"))
    return rows.mapInArrow(run, "path long, cid string, n_shingles long").distinct()


def find_components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The described rows of ``docs``, and (node, root) of the classes that are linked with another class."""
    trees_ = trees_for(percent)
    rows = written(described(docs, trees_), "described")
    classes = written(rows.where("n_shingles > 0").groupBy("cid").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
        .select("cid", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "n_shingles", "tokens"), "classes")
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles").alias("s")).first()["s"] or 0
    parts_ = partitions_for(spark, trees_ * total, 8 << 20)
    trees = classes.select("cid", "n_shingles", F.posexplode("tokens").alias("tree", "token"))
    sized = _sized(trees.select(F.xxhash64("tree", "token").alias("path"), "cid", "n_shingles"))
    sized = written(sized, "nodes")
    chunk = F.pmod(F.xxhash64("cid", "path"), F.col("pieces"))
    links = written(compare(_with_texts(docs, classes, sized.select(F.xxhash64("path", chunk).alias("node"), "cid")), parts_, percent), "links")
    large = sized.where("pieces > 1")
    if not large.isEmpty():
        links = _rest(docs, classes, large, links, parts_, percent)
    return rows, components(links)


def _sized(level: DataFrame) -> DataFrame:
    """(path, cid, n_shingles) of nodes with two classes and more, with the number of pieces a node needs."""
    size = (level.groupBy("path").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
            .select("path", F.greatest(F.ceil(F.col("n") / NODE), F.when(F.col("n") > 2, F.ceil(F.col("s") / NODE_SHINGLES)).otherwise(1)).cast("int").alias("pieces")))
    return level.join(size, "path")


def _rest(docs, classes, large, links, parts_, percent):
    """Large nodes with several components: branch, then compare what is small, and the rest in blocks."""
    labels = written(components(links), "labels")

    def open_nodes(level):
        """Rows of nodes with several components, with their component."""
        own = level.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        several = own.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("path")
        return own.join(several, "path")

    level, found = large.select("path", "cid", "n_shingles"), [links]
    for depth in range(LEVELS + 1):
        sized = written(_sized(open_nodes(level)), "level")
        small = sized.where("pieces = 1").select(F.col("path").alias("node"), "cid")
        found.append(written(compare(_with_texts(docs, classes, small), parts_, percent), "links"))
        level = sized.where("pieces > 1")
        if depth == LEVELS or level.isEmpty():
            break
        level = written(_branched(docs, classes, level), "branches")
    else:
        return _union(found)
    if not level.isEmpty():
        found.append(written(compare(_with_texts(docs, classes, _blocks(level)), parts_, percent), "links"))
    return _union(found)


def _blocks(level: DataFrame) -> DataFrame:
    """Nodes (pairs of blocks): the classes outside a node's largest component, in pieces, against all pieces of it."""
    main = (level.groupBy("path", "root").agg(F.count("*").alias("n")).groupBy("path")
            .agg(F.max(F.struct("n", "root"))["root"].alias("main")))
    rows = level.join(main, "path").withColumn("pieces", F.col("pieces") * 2).withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    outside = rows.where("root != main")
    blocks = outside.select("path", "piece").distinct()
    every = rows.join(blocks.withColumnRenamed("piece", "block"), "path").select(F.xxhash64("path", "block", "piece").alias("node"), "cid")
    outer = outside.select(F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"), "path", "piece", "cid").select(
        F.xxhash64("path", "piece", "other").alias("node"), "cid")
    return every.unionByName(outer).distinct()


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, root, component_id and kept for every row of ``docs`` (doc_id, text).

    Texts are linked that share ``percent`` % of their shingles (of all that either has) or more.
    root names the row's component, whatever its doc_ids are; it is null for texts without words.
    component_id is the least doc_id of the row's component, kept whether it is the row's own. Texts without words
    (or null) are linked with nothing. Rows with the same doc_id are separate rows, which share what their texts give.
    A null doc_id is never the least unless all of its component are null; then component_id is null and kept is true.
    """
    rows, roots = find_components(docs, percent)
    named = (rows.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
             .join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(first, "root").select("cid", "root", "component_id")
    return (rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("cid"))
            .join(of_class, "cid", "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "text_key", "n_shingles", "root", "component_id", F.expr("doc_id <=> component_id").alias("kept")))
