"""Call-graph operators.

Graphs are edge tables ``(package_id, src, dst, weight)``; every package's graph
is processed at once, keyed by ``(package_id, node)``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vocab
from ..session import ensure_checkpoint_dir, saved
from .joins import broadcast_if_small

KEY = "package_id"


def node_degrees(edges: DataFrame, key: str = KEY) -> DataFrame:
    """``(package_id, node, out_w, in_w, degree)``; a self-loop counts twice.

    Endpoints are emitted by one ``explode`` (no union, one scan) and summed
    with partial aggregation, so a hub node is collapsed map-side.
    """
    ends = edges.select(key, F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("weight").cast("double").alias("o"), F.lit(0.0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("weight").cast("double").alias("i")),
    )).alias("e"))
    return (ends.groupBy(key, F.col("e.node").alias("node"))
                .agg(F.sum("e.o").alias("out_w"), F.sum("e.i").alias("in_w"))
                .withColumn("degree", F.col("out_w") + F.col("in_w")))


def graph_stats(edges: DataFrame, key: str = KEY, degrees: DataFrame | None = None) -> DataFrame:
    """A3: nodes, total weight, weighted density, max in/out degree, average degree.

    Packages without edges are absent here; callers fill zeros.
    """
    deg = degrees if degrees is not None else node_degrees(edges, key)
    g = deg.groupBy(key).agg(
        F.count(F.lit(1)).alias("graph_nodes"),
        F.sum("out_w").alias("graph_edges"),
        F.max("in_w").alias("max_indegree"),
        F.max("out_w").alias("max_outdegree"),
        F.sum("degree").alias("_deg"))
    n = F.col("graph_nodes").cast("double")
    return g.select(
        key,
        F.col("graph_nodes").cast("double").alias("graph_nodes"),
        F.col("graph_edges").cast("double").alias("graph_edges"),
        (F.col("graph_edges") / F.greatest(F.lit(1.0), n * (n - 1))).alias("graph_density"),
        F.col("max_indegree").cast("double").alias("max_indegree"),
        F.col("max_outdegree").cast("double").alias("max_outdegree"),
        (F.col("_deg") / n).alias("avg_degree"))


#: Packages of at most so many edges are ranked whole, many at a time, in one task.
LOCAL_EDGES = 1 << 20
#: Edges that make a block, if no package has more, and graphs of texts that are looked at together.
BLOCK_EDGES, BLOCK_TEXTS = 1 << 18, 64
_RANKED = "node string, pagerank double, iterations int, converged boolean"


def pagerank(edges: DataFrame, key: str = KEY, alpha: float = vocab.PAGERANK_ALPHA, max_iter: int | None = None,
             tol: float | None = vocab.PAGERANK_TOL, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Weighted PageRank of every package graph at once.

    Power iteration with uniform teleport, out-weights normalised per source and
    dangling mass spread evenly - the usual definition. With ``tol`` set, a
    package stops (its ranks freeze) at the first iteration whose L1 change is
    below ``n * tol``, which is the usual stopping rule; it always comes, as the
    change shrinks by ``alpha`` each time. ``max_iter`` ends earlier; with
    ``tol=None`` exactly ``max_iter`` iterations run.

    Packages are far smaller than the corpus: those of at most ``local_edges`` edges are dealt out whole and
    iterated to the end in their task, blocks of many packages as one matrix, after one shuffle in all. The larger
    ones, fewer than total edges / ``local_edges``, are iterated by joins over the whole cluster (:func:`_by_joins`).
    Both give the same ranks.

    Returns ``(package_id, node, pagerank, iterations, converged)``.
    """
    if tol is None and max_iter is None:
        raise ValueError("without tol, max_iter is needed")
    spark = edges.sparkSession
    weights, total, large = sized_weights(edges, key, local_edges)
    if large is None:
        return _by_blocks(weights, total, key, alpha, max_iter, tol)
    small = _by_blocks(weights.join(large, key, "left_anti"), total, key, alpha, max_iter, tol)
    return small.unionByName(_by_joins(spark, weights.join(large, key, "left_semi"), key, alpha, max_iter, tol))


def sized_weights(edges: DataFrame, key: str = KEY, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, int, DataFrame | None]:
    """The stored edges ``(package_id, src, dst, w)``, each once, their number, and the packages of more than ``local_edges`` if there are any."""
    weights = saved(edges.groupBy(key, "src", "dst").agg(F.sum("weight").cast("double").alias("w")), "edges")
    return weights, weights.count(), packages_over(weights, local_edges, key)


def packages_over(edges: DataFrame, n: int, key: str = KEY) -> DataFrame | None:
    """The packages of more than ``n`` edges, counted by rows or in graphs of texts, for a join, or none."""
    size = F.sum(F.size("src")) if "words" in edges.columns else F.count(F.lit(1))
    large = saved(edges.groupBy(key).agg(size.alias("_e")).where(F.col("_e") > n).select(key), "large")
    return None if large.isEmpty() else broadcast_if_small(large)


def in_blocks(rows: DataFrame, total: int, key: str, make, schema: str) -> DataFrame:
    """``make(block)`` of blocks of whole packages, about ``BLOCK_EDGES`` of their ``total`` edges each: Arrow tables sorted by
    package, to Arrow batches. ``rows`` are edges or, with a column ``words``, graphs of texts (:func:`edge_rows`)."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * LOCAL_EDGES)))

    def edges_in(part):
        return part.num_rows if "words" not in part.schema.names else int(pc.sum(pc.list_value_length(part.column("src"))).as_py() or 0)

    def pieces(batches):
        for batch in batches:
            step = BLOCK_TEXTS if "words" in batch.schema.names else BLOCK_EDGES
            yield from (batch.slice(begin, step) for begin in range(0, batch.num_rows, step))

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches):
            if held and size >= BLOCK_EDGES:  # all but the last package of what is held are whole
                block = pa.Table.from_batches(held)
                begin = block.num_rows - int(pc.sum(pc.equal(block.column(key), block.column(key)[-1])).as_py())
                if begin:
                    yield from make(block.slice(0, begin))
                    block = block.slice(begin)
                held, size = block.to_batches(), edges_in(block)
            held.append(batch)
            size += edges_in(batch)
        if held:
            yield from make(pa.Table.from_batches(held))

    dealt = rows.where(F.col(key).isNotNull()).repartition(parts, key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def edge_rows(graphs: DataFrame, key: str = KEY) -> DataFrame:
    """Graphs of texts, ``(package_id, words, src, dst, n)`` where ``src`` and ``dst`` are places in ``words`` and ``n`` counts
    each such pair, as edges ``(package_id, src, dst, weight)``."""
    pairs = graphs.select(key, "words", F.explode(F.arrays_zip("src", "dst", "n")).alias("_e"))
    return pairs.select(key, F.col("words")[F.col("_e.src")].alias("src"), F.col("words")[F.col("_e.dst")].alias("dst"), F.col("_e.n").alias("weight"))


def _by_blocks(weights: DataFrame, total: int, key: str, alpha: float, max_iter: int | None, tol: float | None) -> DataFrame:
    """Ranks of whole packages, in blocks of about ``BLOCK_EDGES`` edges."""
    def make(block):
        graph = Block(block, key)
        rank, iterations, done = graph.ranks(alpha, max_iter, tol)
        columns = [graph.packages.take(pa.array(graph.of)), graph.names.take(pa.array(graph.name)), pa.array(rank), pa.array(iterations[graph.of]), pa.array(done[graph.of])]
        yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.string()), *columns[2:]], names=[key, *(c.split()[0] for c in _RANKED.split(", "))])

    return in_blocks(weights, total, key, make, _RANKED)


def _coded(chunks: list[pa.Array]) -> pa.DictionaryArray:
    """Strings as places in their dictionary; null is one of these."""
    return pa.chunked_array([x.cast(pa.large_string()) for x in chunks], pa.large_string()).combine_chunks().dictionary_encode(null_encoding="encode")


class Block:
    """All edges of some packages (:func:`in_blocks`) as numbers: ``src`` and ``dst`` (places of nodes), ``w`` and ``package`` by edge, ``of``
    (package) and ``name`` (place in ``names``) by node. Rows of the same edge add up."""

    def __init__(self, block: pa.Table, key: str):
        coded = block.column(key).combine_chunks().dictionary_encode()
        package, self.packages = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if "words" in block.schema.names:
            words, src, dst, w = ([c for c in block.column(name).chunks] for name in ("words", "src", "dst", "n"))
            coded = _coded([x.flatten() for x in words])
            sizes, edges = (np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]) for lists in (words, src))
            begin = np.repeat(np.cumsum(sizes) - sizes, edges)
            name = coded.indices.to_numpy()
            ends = [name[begin + np.concatenate([x.flatten().to_numpy() for x in lists])] for lists in (src, dst)]
            package, w = np.repeat(package, edges), np.concatenate([x.flatten().to_numpy() for x in w])
        else:
            coded = _coded([x for c in ("src", "dst") for x in block.column(c).chunks])
            ends, w = np.split(coded.indices.to_numpy(), 2), block.column("w").to_numpy()
        self.names = coded.dictionary
        at, nodes = pd.factorize(np.concatenate([package, package]) * len(self.names) + np.concatenate(ends))
        self.of, self.name = nodes // len(self.names), nodes % len(self.names)
        row, edges = pd.factorize(at[:len(package)] * len(nodes) + at[len(package):])
        self.src, self.dst = edges // len(nodes), edges % len(nodes)
        self.w = np.bincount(row, w.astype(float), len(edges))
        self.package = self.of[self.src]

    def ranks(self, alpha: float, max_iter: int | None, tol: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank of each node, and of each package the iterations and whether it has converged.

        Packages that have are left out of the iterations once they are half of the edges.
        """
        src, dst, of, packages = self.src, self.dst, self.of, len(self.packages)
        out_w = np.bincount(src, self.w, len(of))
        p, dangling = self.w / out_w[src], out_w == 0
        n = np.bincount(of, minlength=packages).astype(float)
        rank = 1.0 / n[of]
        ranks, ids = rank.copy(), np.arange(len(of))
        done, iterations, i = np.zeros(packages, bool), np.zeros(packages, np.int32), 0
        while not done.all() and i != max_iter:
            i += 1
            loose = np.bincount(of, np.where(dangling, rank, 0.0), packages)
            new = alpha * (np.bincount(dst, rank[src] * p, len(of)) + (loose / n)[of]) + ((1.0 - alpha) / n)[of]
            change = np.bincount(of, np.abs(new - rank), packages)
            iterations[~done] = i
            ended = ~done & ((change < n * tol) if tol is not None else np.full(packages, i == max_iter))
            if i == max_iter:
                ended, done = ~done, done | ended  # what has not converged has the ranks of the last iteration
            else:
                done = done | ended
            if ended.any():
                there = ended[of]
                ranks[ids[there]] = new[there]
            rank = new
            live = ~done[of]
            own = live[src]
            if 2 * np.count_nonzero(own) < len(src):
                place = np.cumsum(live) - 1
                src, dst, p = place[src[own]], place[dst[own]], p[own]
                of, dangling, rank, ids = of[live], dangling[live], rank[live], ids[live]
        return ranks, iterations, done


def _bucketed(df: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, str]:
    """``df`` as a table below the shared folder in one bucket for each shuffle partition, and its name in the catalogue."""
    spark = df.sparkSession
    name = f"vigil_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).option("path", path).saveAsTable(name)
    return spark.table(name), name


def _by_joins(spark, weights: DataFrame, key: str, alpha: float, max_iter: int | None, tol: float | None) -> DataFrame:
    """Ranks of large packages. Edges by source and ranks by node are bucketed alike, so that a round shuffles once: what
    the nodes receive. What a package needs (size, dangling mass, change) is a table of a row for each of these few."""
    nodes = node_degrees(weights.withColumnRenamed("w", "weight"), key).select(key, "node", "out_w")
    nodes = saved(nodes, "nodes")
    sizes = saved(nodes.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.sum(F.when(F.col("out_w") == 0, 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("d")), "sizes")
    trans, table = _bucketed(weights.join(nodes.select(key, F.col("node").alias("src"), "out_w"), [key, "src"])
                             .select(key, "src", "dst", (F.col("w") / F.col("out_w")).alias("p")), "moves", [key, "src"])
    tables = [table]
    state, table = _bucketed(nodes.join(broadcast_if_small(sizes), key).select(
        key, "node", (F.col("out_w") == 0).alias("dangling"), (F.lit(1.0) / F.col("n")).alias("rank")), "ranks", [key, "node"])
    tables.append(table)
    finished, i = [], 0
    while True:
        i += 1
        known = broadcast_if_small(sizes)
        got = (trans.join(state.select(F.col(key).alias("_k"), "node", "rank"), (F.col(key) == F.col("_k")) & (F.col("src") == F.col("node")))
               .groupBy(F.col(key).alias("_k"), F.col("dst").alias("_to")).agg(F.sum(F.col("rank") * F.col("p")).alias("c")))
        new = (state.join(got, (F.col(key) == F.col("_k")) & (F.col("node") == F.col("_to")), "left").join(known, key).select(
            key, "node", "dangling", F.col("rank").alias("old"),
            (F.lit(alpha) * (F.coalesce("c", F.lit(0.0)) + F.col("d") / F.col("n")) + F.lit(1.0 - alpha) / F.col("n")).alias("rank")))
        new, table = _bucketed(new, "ranks", [key, "node"])
        tables.append(table)
        done = F.col("err") < F.col("n") * F.lit(tol) if tol is not None else F.lit(i == max_iter)
        sums = new.groupBy(key).agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("err"), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("d"))
        sizes = saved(sums.join(broadcast_if_small(sizes.select(key, "n")), key).select(key, "n", "d", done.alias("done")), "sizes")
        last = i == max_iter
        ends = broadcast_if_small((sizes if last else sizes.where("done")).select(key, "done"))
        finished.append(new.join(ends, key).select(key, "node", F.col("rank").alias("pagerank"), F.lit(i).alias("iterations"), F.col("done").alias("converged")))
        if last or sizes.where(~F.col("done")).isEmpty():
            break
        sizes = sizes.where(~F.col("done")).drop("done")
        state = new.join(broadcast_if_small(sizes.select(key)), key, "left_semi").drop("old")
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    result = saved(result, "pagerank")
    for table in tables:
        spark.sql(f"DROP TABLE {table}")  # its files are in the checkpoint folder
    return result


def api_rank(api_counts: DataFrame, stats: DataFrame, top: int = 100, key: str = KEY) -> DataFrame:
    """A10 + W2: corpus API score = sum over packages of cnt*(3 if sensitive else 1)
    + that package's graph density; global top ``top`` (ties by name)."""
    j = api_counts.join(stats.select(key, "graph_density"), key, "left")
    boost = F.when(P.is_sensitive_call("name"), F.lit(3)).otherwise(F.lit(1))
    scored = j.groupBy("name").agg(
        F.sum(F.col("cnt") * boost + F.coalesce("graph_density", F.lit(0.0))).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("name").asc()).limit(top)
