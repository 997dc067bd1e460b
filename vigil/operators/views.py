"""Three-view representation.

Vectors are aggregated sparse as ``(package_id, view, dim, value)`` and turned
into dense ``ARRAY<DOUBLE>`` (768) only at the end, one bounded array per
(package, view).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions import vocab
from ..session import saved
from . import graph as G
from .features import KNOWN, PIECES, Remembered, piece_counts

KEY = "package_id"


def signed_hash_sparse(tokens: DataFrame, dim: int = vocab.EMBED_DIM, key: list[str] | None = None,
                       hash: str = "md5") -> DataFrame:
    """M12 (sparse): ``tokens(keys..., token, cnt)`` -> ``(keys..., dim, value)``.

    index = bucket(token, dim), sign = +1 when bucket("sign:" + token, 2) == 0;
    counts add up, then the vector is L2-normalised per key. Signed counts add up
    by dimension in every task, so no token is shuffled.
    """
    keys = key or [KEY, "view"]
    return normalised(token_cells(tokens, dim, keys, hash), keys)


def token_cells(tokens: DataFrame, dim: int = vocab.EMBED_DIM, key: list[str] | None = None, hash: str = "md5") -> DataFrame:
    """``tokens(keys..., token, cnt)`` -> ``(keys..., dim, v)``, the signed counts by dimension."""
    keys = key or [KEY, "view"]
    t = tokens.where(F.col("token").isNotNull() & (F.length("token") > 0))
    signed = t.select(*keys, T.bucket("token", dim, hash).alias("dim"),
                      (F.when(T.bucket(F.concat(F.lit("sign:"), F.col("token")), 2, hash) == 0, F.lit(1.0))
                        .otherwise(F.lit(-1.0)) * F.col("cnt")).alias("v"))
    return signed.groupBy(*keys, "dim").agg(F.sum("v").alias("v"))


def text_cells(pieces: DataFrame, view: str, dim: int = vocab.EMBED_DIM, key: str = KEY, text: str = "text", hash: str = "md5") -> DataFrame:
    """F6 + M12: text pieces -> ``(package_id, view, dim, v)``: :func:`token_cells` of their tokens, added up in the task that
    holds the texts. A package has some rows of a dimension, at most one for each chunk of texts."""
    pattern = re.compile(vocab.EMBED_TOKEN_PATTERN, re.ASCII)  # as Java's \s

    def run(batches):
        known = Remembered(lambda t: (T.buckets_of([t], dim, hash)[0], 1.0 if T.buckets_of(["sign:" + t], 2, hash)[0] == 0 else -1.0))
        for keys, at, tokens, counts in piece_counts(batches, pattern):
            hashed = [known[t] for t in tokens]
            cell = np.array(at, np.int64) * dim + np.array([h[0] for h in hashed], np.int64)
            cells, own = np.unique(cell, return_inverse=True)
            v = np.bincount(own, np.array(counts, float) * np.array([h[1] for h in hashed], float), len(cells))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cells // dim)), pa.array(cells % dim, pa.int32()), pa.array(v, pa.float64())], names=[key, "dim", "v"])

    id_type = pieces.schema[key].dataType.simpleString()
    cells = pieces.select(key, F.lower(text)).mapInArrow(run, f"{key} {id_type}, dim int, v double")
    return cells.select(key, F.lit(view).alias("view"), "dim", "v")


def normalised(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``(keys..., dim, v)``, any number of rows for a dimension -> ``(keys..., dim, value)`` of length 1 for each key.

    The cells of a package, a bounded number from every task, meet in one shuffle (by the first key: a literal view would hide
    from Spark that the rows lie together already); rows with a null key are left out.
    """
    keys = key or [KEY, "view"]
    known = cells
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    summed = known.repartition(keys[0]).groupBy(*keys, "dim").agg(F.sum("v").alias("v"))
    whole = summed.groupBy(*keys).agg(F.collect_list(F.struct("dim", "v")).alias("_p"))
    n = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x["v"] * x["v"]))
    rows = whole.select(*keys, n.alias("_n"), "_p").select(*keys, "_n", F.explode("_p").alias("_x"))
    return rows.select(*keys, F.col("_x.dim").alias("dim"),
                       F.when(F.col("_n") > 0, F.col("_x.v") / F.col("_n")).otherwise(F.lit(0.0)).alias("value"))


def densify(sparse: DataFrame, dim: int = vocab.EMBED_DIM, key: list[str] | None = None) -> DataFrame:
    """Sparse ``(keys..., dim, value)`` -> ``(keys..., vector ARRAY<DOUBLE>)`` of length ``dim``."""
    keys = key or [KEY, "view"]
    pairs = sparse.groupBy(*keys).agg(F.collect_list(F.struct("dim", "value")).alias("_p"))
    pairs = pairs.select(*keys, F.col("_p.dim").alias("_d"), F.col("_p.value").alias("_x"))
    names = [*keys, "vector"]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                at, value = part.column(len(keys)), part.column(len(keys) + 1)
                out = np.zeros((part.num_rows, dim))
                row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                out[row, at.flatten().to_numpy()] = value.flatten().to_numpy()
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keys)], pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], names=names)

    schema = ", ".join(f"{k} {sparse.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.mapInArrow(run, f"{schema}, vector array<double>")


def text_tokens(pieces: DataFrame, view: str, key: str = KEY, text: str = "text") -> DataFrame:
    """F6 tokens of text pieces -> ``(package_id, view, token, cnt=1)`` rows."""
    return pieces.select(key, F.lit(view).alias("view"), F.explode(T.embed_tokens(text)).alias("token"),
                         F.lit(1).cast("bigint").alias("cnt"))


def metadata_view_tokens(metadata: DataFrame, key: str = KEY) -> DataFrame:
    """Metadata view text = sorted ``k: v`` lines; tokens never span lines, so
    each present field contributes the tokens of its own line."""
    return text_tokens(metadata_lines(metadata, key), "metadata", key)


def metadata_lines(metadata: DataFrame, key: str = KEY) -> DataFrame:
    return metadata.select(key, F.concat(F.col("field"), F.lit(": "), F.col("value")).alias("text"))


def code_view_tokens(snippets: DataFrame, key: str = KEY) -> DataFrame:
    """Code view text = all snippets given, joined by blank lines -> their tokens."""
    return text_tokens(snippets, "code", key)


def graph_view_tokens(edges: DataFrame, key: str = KEY, pagerank: DataFrame | None = None,
                      max_iter: int | None = None, local_edges: int = G.LOCAL_EDGES) -> DataFrame:
    """Node tokens repeated ``int(min(20, 1 + degree + 100 x pagerank))`` (+4 when the
    node name is a sensitive call) plus one ``src->dst`` token per distinct edge.

    PageRank runs until every package has converged. With ``max_iter``, packages that
    did not by then fall back to edge tokens repeated ``min(weight, 5)``.
    """
    deg = G.node_degrees(edges, key)
    pr = pagerank if pagerank is not None else saved(G.pagerank(edges, key, max_iter=max_iter, local_edges=local_edges), "ranks")
    failed = pr.where(~F.col("converged")).select(key).distinct()
    nodes = deg.join(pr, [key, "node"]).select(
        key, F.col("node").alias("token"),
        (F.floor(F.least(F.lit(float(vocab.GRAPH_REPEAT_CAP)),
                         F.lit(1.0) + F.col("degree") + F.col("pagerank") * vocab.GRAPH_PR_SCALE)).cast("bigint")
         + F.when(P.is_sensitive_call("node"), F.lit(vocab.GRAPH_SENSITIVE_BONUS)).otherwise(F.lit(0))).alias("cnt"))
    ed = edges.groupBy(key, "src", "dst").agg(F.sum("weight").alias("w")).select(
        key, F.concat(F.col("src"), F.lit("->"), F.col("dst")).alias("token"), F.lit(1).cast("bigint").alias("cnt"))
    good = nodes.unionByName(ed).join(failed, key, "left_anti")
    bad = (edges.join(failed, key, "left_semi").groupBy(key, "src", "dst").agg(F.sum("weight").alias("w"))
                .select(key, F.concat(F.col("src"), F.lit("->"), F.col("dst")).alias("token"),
                        F.least(F.col("w"), F.lit(5)).cast("bigint").alias("cnt")))
    return good.unionByName(bad).select(key, F.lit("graph").alias("view"), "token", "cnt")


class _Sums:
    """Sums of signed counts by dimension for many packages; given back as rows when it holds ``SLOTS`` packages."""

    def __init__(self, key: str, key_type: pa.DataType, view: str, dim: int):
        self.names, self.key_type, self.view, self.dim = [key, "view", "dims", "values"], key_type, view, dim
        self.slots, self.total = {}, np.zeros((SLOTS + PIECES, dim))

    def add(self, keys: list, sums: np.ndarray) -> None:
        place = [self.slots.setdefault(k, len(self.slots)) for k in keys]
        self.total[place] += sums

    def full(self) -> bool:
        return len(self.slots) >= SLOTS

    def rows(self) -> pa.RecordBatch:
        n = len(self.slots)
        out = sparse_rows(pa.array(self.slots, self.key_type), self.view, self.total[:n], self.names)
        self.slots = {}
        self.total[:n] = 0.0
        return out


#: Packages that a task sums up at a time, in an array of ``SLOTS`` x 768 doubles (25 MB).
SLOTS = 4096


def sparse_rows(keys: pa.Array, view: str, sums: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row for each key: its dimensions and their sums, without zeros."""
    row, dims = np.nonzero(sums)
    offsets = pa.array(np.searchsorted(row, np.arange(len(sums) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.array([view] * len(sums), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(dims, pa.int32())),
                                       pa.ListArray.from_arrays(offsets, pa.array(sums[row, dims]))], names=names)


_SPARSE = "view string, dims array<int>, values array<double>"


def signed_codes(tokens: list[bytes], dim: int, hash: str) -> np.ndarray:
    """Of each token twice its dimension, plus one if its sign is minus."""
    return 2 * T.bucket_array(tokens, dim, hash) + (T.bucket_array(tokens, 2, hash, b"sign:") != 0)


def text_rows(pieces: DataFrame, view: str, dim: int = vocab.EMBED_DIM, key: str = KEY, text: str = "text", hash: str = "md5") -> DataFrame:
    """:func:`text_cells` as ``(package_id, view, dims, values)``: about one row for each package that a task meets."""
    pattern = re.compile(vocab.EMBED_TOKEN_PATTERN, re.ASCII)

    def run(batches):
        known, sums = {}, None
        for keys, at, tokens, counts in piece_counts(batches, pattern):
            sums = sums or _Sums(key, keys.type, view, dim)
            if len(known) >= KNOWN:
                known.clear()
            fresh = list(set(tokens).difference(known))
            known.update(zip(fresh, signed_codes([t.encode("utf-8", "replace") for t in fresh], dim, hash).tolist()))
            code, at = np.array([known[t] for t in tokens], np.int64), np.array(at, np.int64)
            v = np.bincount(at * dim + (code >> 1), np.where(code & 1, -1.0, 1.0) * np.array(counts, float), len(keys) * dim).reshape(-1, dim)
            named = keys.to_pylist()
            some = [i for i in np.unique(at).tolist() if named[i] is not None]
            sums.add([named[i] for i in some], v[some])
            if sums.full():
                yield sums.rows()
        if sums:
            yield sums.rows()

    id_type = pieces.schema[key].dataType.simpleString()
    return pieces.select(key, F.lower(text)).mapInArrow(run, f"{key} {id_type}, {_SPARSE}")


def graph_rows(edges: DataFrame, key: str = KEY, dim: int = vocab.EMBED_DIM, hash: str = "md5", pagerank: DataFrame | None = None,
               max_iter: int | None = None, local_edges: int = G.LOCAL_EDGES) -> DataFrame:
    """M15 + M12: the signed counts of :func:`graph_view_tokens` as ``(package_id, view, dims, values)``.

    A package of at most ``local_edges`` edges is in one task whole, which ranks its nodes, counts its tokens and adds them
    up: neither ranks nor tokens are shuffled. For the larger ones, and with ranks given, the tokens are rows. ``edges`` may
    be graphs of texts (:func:`word_graphs`).
    """
    if pagerank is not None:
        edges = G.edge_rows(edges, key) if "words" in edges.columns else edges
        return _packed(token_cells(graph_view_tokens(edges, key, pagerank), dim, [key, "view"], hash), key)

    def make(block):
        graph = G.Block(block, key)
        rank, _, done = graph.ranks(vocab.PAGERANK_ALPHA, max_iter, vocab.PAGERANK_TOL)
        # nodes: a count for each, none in packages that have not converged
        names = graph.names.to_pylist()
        degree = np.bincount(graph.src, graph.w, len(graph.of)) + np.bincount(graph.dst, graph.w, len(graph.of))
        cnt = np.floor(np.minimum(float(vocab.GRAPH_REPEAT_CAP), 1.0 + degree + rank * vocab.GRAPH_PR_SCALE))
        bonus = np.array([vocab.GRAPH_SENSITIVE_BONUS if t and P.sensitive_name(t) else 0 for t in names])
        code = signed_codes([(t or "").encode() for t in names], dim, hash)
        mine = np.flatnonzero(done[graph.of] & np.array([bool(t) for t in names])[graph.name])
        mine = mine[np.argsort(graph.of[mine], kind="stable")]
        node = graph.of[mine], code[graph.name[mine]], (cnt + bonus[graph.name])[mine]
        # edges: once each, or by weight
        pair, pairs = pd.factorize(graph.name[graph.src] * len(names) + graph.name[graph.dst])
        tokens = pc.binary_join_element_wise(*(graph.names.take(pa.array(x)) for x in (pairs // len(names), pairs % len(names))), pa.scalar("->", pa.large_string()))
        code = signed_codes([t or b"" for t in tokens.cast(pa.large_binary()).to_pylist()], dim, hash)
        mine = np.flatnonzero(tokens.is_valid().to_numpy(zero_copy_only=False)[pair])
        edge = graph.package[mine], code[pair[mine]], np.where(done[graph.package], 1.0, np.floor(np.minimum(graph.w, 5.0)))[mine]
        for begin in range(0, len(graph.packages), PIECES):
            n = min(PIECES, len(graph.packages) - begin)
            sums, some = np.zeros(n * dim), np.zeros(n, bool)
            for of, code, count in (node, edge):
                lo, hi = np.searchsorted(of, [begin, begin + n])
                at, c = of[lo:hi] - begin, code[lo:hi]
                sums += np.bincount(at * dim + (c >> 1), np.where(c & 1, -count[lo:hi], count[lo:hi]), n * dim)
                some[at] = True
            own = np.flatnonzero(some)
            yield sparse_rows(graph.packages.take(pa.array(begin + own)), "graph", sums.reshape(n, dim)[own], [key, "view", "dims", "values"])

    packed = "words" in edges.columns
    rows = saved(edges if packed else edges.select(key, "src", "dst", F.col("weight").cast("double").alias("w")), "edges", batch_rows=BATCH_ROWS if packed else None)
    total = (rows.agg(F.sum(F.size("src")).alias("n")).first()["n"] or 0) if packed else rows.count()
    many = G.packages_over(rows, local_edges, key)
    if many is None:
        return G.in_blocks(rows, total, key, make, _SPARSE)
    out = G.in_blocks(rows.join(many, key, "left_anti"), total, key, make, _SPARSE)
    # of many rows: maybe the same edges often
    often = rows.join(many, key, "left_semi")
    weights, total, large = G.sized_weights(G.edge_rows(often, key) if packed else often.withColumnRenamed("w", "weight"), key, local_edges)
    if large is None:
        return out.unionByName(G.in_blocks(weights, total, key, make, _SPARSE))
    out = out.unionByName(G.in_blocks(weights.join(large, key, "left_anti"), total, key, make, _SPARSE))
    tokens = graph_view_tokens(weights.join(large, key, "left_semi").withColumnRenamed("w", "weight"), key, max_iter=max_iter, local_edges=local_edges)
    return out.unionByName(_packed(token_cells(tokens, dim, [key, "view"], hash), key))


def _packed(cells: DataFrame, key: str) -> DataFrame:
    """``(package_id, view, dim, v)``, each dimension once, -> ``(package_id, view, dims, values)``."""
    pairs = cells.groupBy(key, "view").agg(F.collect_list(F.struct("dim", "v")).alias("_p"))
    return pairs.select(key, "view", F.col("_p.dim").alias("dims"), F.col("_p.v").alias("values"))


def unit_vectors(rows: DataFrame, dim: int = vocab.EMBED_DIM, key: str = KEY) -> DataFrame:
    """``(package_id, view, dims, values)``, any number of rows for a view -> ``(package_id, view, vector)``: their sum as a dense
    vector of length 1 (or 0), after one shuffle; rows with a null key are left out."""
    names = [key, "view", "vector"]

    def out(keys, views, sums):
        n = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        unit = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
        offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim)
        return pa.RecordBatch.from_arrays([keys, views, pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))], names=names)

    def run(batches):
        held = None  # the last key, view and sum so far: the next batch may have more of it
        for batch in batches:
            for begin in range(0, batch.num_rows, PIECES):
                part = batch.slice(begin, PIECES)
                coded = [part.column(i).dictionary_encode().indices.to_numpy().astype(np.int64) for i in (0, 1)]
                new = np.ones(part.num_rows, bool)
                new[1:] = (coded[0][1:] != coded[0][:-1]) | (coded[1][1:] != coded[1][:-1])
                of, first = np.cumsum(new) - 1, pa.array(np.flatnonzero(new))
                cell = np.repeat(of, np.diff(part.column(2).offsets.to_numpy())) * dim + part.column(2).flatten().to_numpy()
                sums = np.bincount(cell, part.column(3).flatten().to_numpy(), len(first) * dim).reshape(-1, dim)
                keys, views = part.column(0).take(first), part.column(1).take(first)
                if held and held[0].equals(keys.slice(0, 1)) and held[1].equals(views.slice(0, 1)):
                    sums[0] += held[2][0]
                elif held:
                    yield out(*held)
                if len(sums) > 1:
                    yield out(keys.slice(0, len(sums) - 1), views.slice(0, len(sums) - 1), sums[:-1])
                held = keys.slice(len(sums) - 1), views.slice(len(sums) - 1), sums[-1:].copy()
        if held:
            yield out(*held)

    dealt = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "view")
    return dealt.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, view string, vector array<double>")


#: Rows that Python is given at a time where these are texts, word graphs or sums by dimension: some 10 KB each.
BATCH_ROWS = 512


def view_matrix(metadata: DataFrame, snippets: DataFrame, edges: DataFrame, key: str = KEY,
                hash: str = "md5", dim: int = vocab.EMBED_DIM, pagerank: DataFrame | None = None) -> DataFrame:
    """``(package_id, view, vector)`` for the metadata, code and graph views
    (dense, ``dim`` each). Views without tokens are absent (= zero vector)."""
    rows = (text_rows(metadata_lines(metadata, key), "metadata", dim, key, hash=hash)
            .unionByName(text_rows(snippets, "code", dim, key, hash=hash))
            .unionByName(graph_rows(edges, key, dim, hash, pagerank)))
    return unit_vectors(rows, dim, key)


def word_graphs(texts: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The graph of the words of each text that follow each other, words being the tokens of F6: ``(package_id, words, src, dst, n)``,
    see :func:`graph.edge_rows`. Texts of more than ``PAIRS`` pairs come in several rows, and a row has no more."""
    pattern = re.compile(vocab.EMBED_TOKEN_PATTERN, re.ASCII)
    names = [key, "words", "src", "dst", "n"]

    def lists(of, rows, *values):
        offsets = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, x) for x in values]

    def graphs(keys, row, tokens, sizes):
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        own, piece = len(coded.dictionary), np.repeat(np.arange(len(sizes)), sizes)
        word, at = np.unique(piece * own + coded.indices.to_numpy(), return_inverse=True)
        pairs = np.flatnonzero(piece[1:] == piece[:-1])
        edge, n = np.unique(at[pairs] * len(word) + at[pairs + 1], return_counts=True)
        src, dst, of = edge // len(word), edge % len(word), word // own
        begin = np.searchsorted(of, np.arange(len(sizes)))[of[src]]
        words = lists(of, len(sizes), coded.dictionary.take(pa.array(word % own)))
        ends = lists(of[src], len(sizes), pa.array((src - begin).astype(np.int32)), pa.array((dst - begin).astype(np.int32)), pa.array(n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *words, *ends], names=names)

    def run(batches):
        for batch in batches:
            keys, row, tokens, sizes = batch.column(0), [], [], []
            for i in range(batch.num_rows):
                found = pattern.findall(batch.column(1)[i].as_py() or "")
                for begin in range(0, len(found) - 1, PAIRS):
                    own = found[begin:begin + PAIRS + 1]  # the last word of a piece is the first of the next
                    row.append(i)
                    tokens += own
                    sizes.append(len(own))
                    if len(tokens) >= TOKENS:
                        yield graphs(keys, row, tokens, sizes)
                        row, tokens, sizes = [], [], []
            if row:
                yield graphs(keys, row, tokens, sizes)

    id_type = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.lower(text)).mapInArrow(run, f"{key} {id_type}, words array<string>, src array<int>, dst array<int>, n array<bigint>")


#: Pairs of words in a row of :func:`word_graphs`, and tokens whose pairs are counted at a time.
PAIRS, TOKENS = 1 << 12, 1 << 17
