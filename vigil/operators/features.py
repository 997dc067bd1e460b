"""Feature operators (M1-M8).

Named features are built as one wide row per package (40 columns) from
per-package aggregates that are all hash-partitioned on ``package_id``; hashed
features are a long ``(package_id, feature, value)`` table. ``feature_long``
stacks both into the sparse long form used for scoring and training.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import predicates as P
from ..functions import text as T
from ..functions import vocab
from ..session import saved
from . import counts as C
from . import graph as G
from . import ranking as R

KEY = "package_id"

META_COLS = {f: "meta_" + f.replace("-", "_") for f in vocab.METADATA_FIELDS}

NAMED_FEATURES = (
    [f"meta_has_{f}" for f in vocab.METADATA_FIELDS] + [f"meta_len_{f}" for f in vocab.METADATA_FIELDS]
    + ["meta_missing_ratio", "meta_entropy", "meta_suspicious_words",
       "source_file_count", "parse_error_ratio", "api_unique_count", "api_total_count",
       "sensitive_api_unique", "sensitive_api_total", "sensitive_import_unique", "sensitive_import_total",
       "graph_nodes", "graph_edges", "graph_density", "max_indegree", "max_outdegree", "avg_degree",
       "cfg_nodes", "cfg_edges", "max_nesting",
       "snippet_count", "snippet_suspicious_words", "snippet_entropy",
       "high_entropy_string_count", "url_string_count", "long_string_count"])


# ------------------------------------------------------------------ M2 ---

def hashed_counts(counts: DataFrame, prefix: str, k: int | None, cap: int, key: str = KEY,
                  hash: str = "md5", buckets: int = vocab.HASH_BUCKETS,
                  sensitive=None, sensitive_prefix: str | None = None) -> DataFrame:
    """M2: per bucket the sum of ``min(cnt, cap) / cap`` over all names of a package, or with
    ``k`` over its top ``k`` (count desc, first occurrence). Without ``k`` nothing is ranked.

    ``counts`` is ``(package_id, name, cnt, first)``. When ``sensitive`` (a
    Column predicate on ``name``) is given, the sensitive subset *of the same
    names* is also emitted under ``sensitive_prefix``. The hash runs once per
    distinct (package, name), after counting, unless the counts bring the ``bucket`` along (:func:`word_totals`).
    """
    top = counts if k is None else R.top_k_names(counts, k, key)
    at = F.col("bucket") if "bucket" in counts.columns else T.bucket("name", buckets, hash)
    top = top.select(key, at.alias("_b"), "name", "cnt").withColumn("_v", N.clamp_scale("cnt", cap))
    fams = [F.struct(F.lit(prefix).alias("fam"), F.col("_v").alias("v"))]
    if sensitive is not None:
        fams.append(F.struct(F.lit(sensitive_prefix).alias("fam"),
                             F.when(sensitive, F.col("_v")).alias("v")))
    x = top.select(key, "_b", F.explode(F.array(*fams)).alias("f")).where(F.col("f.v").isNotNull())
    return (x.groupBy(key, F.col("f.fam").alias("fam"), "_b").agg(F.sum("f.v").alias("value"))
             .select(key, F.concat(F.col("fam"), F.lit("_hash_"), F.col("_b").cast("string")).alias("feature"),
                     "value"))


def word_counts(pieces: DataFrame, key: str = KEY, order: str = "piece", text: str = "text") -> DataFrame:
    """Word counts of a text given as ordered pieces ``(package_id, piece, text)``.

    Tokens never span pieces joined by whitespace, so the joined text is not
    built. ``first`` = (piece, position) of the first occurrence.
    """
    toks = pieces.select(key, order, F.posexplode(T.word_tokens(text)).alias("pos", "name"))
    return toks.groupBy(key, "name").agg(F.count(F.lit(1)).alias("cnt"),
                                         F.min(F.struct(order, "pos")).alias("first"))


#: Texts that a task counts together, and tokens whose hashes it remembers.
PIECES, KNOWN = 512, 1 << 17


def piece_counts(batches: Iterator[pa.RecordBatch], pattern: re.Pattern) -> Iterator[tuple[pa.Array, list[int], list[str], list[int]]]:
    """From batches (key, lower-cased text): ``(keys, at, tokens, counts)`` of some texts; ``at`` is the place of a token's key in ``keys``.

    The texts of a key that lie together are counted together. Small: about ``PIECES`` texts at a time.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECES):
            part = batch.slice(begin, PIECES)
            coded = part.column(0).dictionary_encode(null_encoding="encode")
            own: dict[int, Counter] = {}
            for i, text in zip(coded.indices.to_pylist(), part.column(1).to_pylist()):
                if text:
                    own.setdefault(i, Counter()).update(pattern.findall(text))
            at, tokens, counts = [], [], []
            for i, found in own.items():
                at += [i] * len(found)
                tokens += found
                counts += found.values()
            yield coded.dictionary, at, tokens, counts


class Remembered(dict):
    """Values of tokens, ``of(token)`` for those not seen yet; forgets all when it holds ``KNOWN``."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token):
        if len(self) >= KNOWN:
            self.clear()
        self[token] = value = self.of(token)
        return value


def word_totals(pieces: DataFrame, key: str = KEY, text: str = "text", hash: str = "md5",
                buckets: int = vocab.HASH_BUCKETS) -> DataFrame:
    """:func:`word_counts` for hashing: ``(package_id, bucket, name, cnt)``, without first places.

    Tasks count the words of the texts they hold and hash them; the counts are dealt out by package and bucket, which is
    the only shuffle up to the hashed features, and a large package is many tasks' work.
    """
    pattern = re.compile(vocab.WORD_PATTERN)

    def run(batches):
        known = Remembered(lambda w: T.buckets_of([w], buckets, hash)[0])
        for keys, at, words, counts in piece_counts(batches, pattern):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array([known[w] for w in words], pa.int32()),
                                              pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=[key, "bucket", "name", "cnt"])

    id_type = pieces.schema[key].dataType.simpleString()
    counted = pieces.select(key, F.lower(text)).mapInArrow(run, f"{key} {id_type}, bucket int, name string, cnt bigint")
    return counted.repartition(key, "bucket").groupBy(key, "bucket", "name").agg(F.sum("cnt").alias("cnt"))


# ------------------------------------------------------------------ M1 ---

def metadata_wide(metadata: DataFrame, packages: DataFrame, key: str = KEY) -> DataFrame:
    """One row per package with the seven metadata fields as columns ('' when absent)."""
    agg = metadata.groupBy(key).agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for f, c in META_COLS.items()])
    j = packages.select(key).join(agg, key, "left")
    return j.select(key, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in META_COLS.values()])


def metadata_features(meta_wide: DataFrame, key: str = KEY) -> DataFrame:
    """M1: has/len per field, weak-or-missing ratio, entropy/8 and keyword presence/20
    of the space-joined metadata text."""
    cols = []
    missing = F.lit(0)
    for f, c in META_COLS.items():
        v = F.col(c)
        cols.append(F.when(F.length(v) > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"meta_has_{f}"))
        cols.append(N.clamp_scale(F.length(v), 5000).alias(f"meta_len_{f}"))
        missing = missing + F.when(P.is_weak_metadata(v), 1).otherwise(0)
    text = F.concat_ws(" ", *[F.col(c) for c in META_COLS.values()])
    return meta_wide.select(
        key, *cols,
        (missing / F.lit(float(len(META_COLS)))).alias("meta_missing_ratio"),
        (T.shannon_entropy(text) / 8.0).alias("meta_entropy"),
        T.keyword_presence(text).alias("meta_suspicious_words"))


def metadata_pieces(meta_wide: DataFrame, key: str = KEY) -> DataFrame:
    """The metadata text as ordered pieces (one per field) for word counting."""
    return meta_wide.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("piece"), F.col(c).alias("text")) for i, c in enumerate(META_COLS.values())
    ])).alias("p")).select(key, "p.piece", "p.text")


# ------------------------------------------------------------------ M5 ---

def snippet_features(snippets: DataFrame, key: str = KEY, max_snippets: int = vocab.MAX_SNIPPETS) -> DataFrame:
    """M5: snippet count/80, keyword occurrences/50 and entropy/8 of the
    newline-joined snippets, from the character histograms and counts of the snippets that a task holds (one pass)."""
    id_type = snippets.schema[key].dataType.simpleString()
    rows = snippets.select(key, "text").mapInArrow(lambda it: _snippet_sums(it, key), f"{key} {id_type}, ch string, cnt bigint, n bigint, occ bigint")
    per = rows.groupBy(key, "ch").agg(*[F.sum(c).alias(c) for c in ("cnt", "n", "occ")])
    # every snippet brought a newline, and the last of a package has none after it
    c = F.when(F.col("ch") == "\n", F.col("cnt") - 1).otherwise(F.col("cnt"))
    per = per.select(key, F.when(c > 0, c).alias("_c"), "n", "occ").groupBy(key).agg(
        F.sum("n").alias("snippet_n"), F.sum("occ").alias("_occ"),
        T.entropy_from_counts(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.sum(F.col("_c") * F.log2(F.col("_c"))), F.lit(0.0))).alias("_ent"))
    return per.select(key, F.col("snippet_n").alias("snippet_n"),
                      N.clamp_scale("snippet_n", max_snippets).alias("snippet_count"),
                      (F.col("_occ") / 50.0).alias("snippet_suspicious_words"),
                      (F.when(F.col(key).isNotNull(), F.col("_ent")).otherwise(F.lit(0.0)) / 8.0).alias("snippet_entropy"))


def _snippet_sums(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """``(key, ch, cnt, n, occ)``: characters of the texts of a package, a newline for each text; with the newline the number
    of texts and of suspicious words in them."""
    words = vocab.SUSPICIOUS_WORDS
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECES):
            part = batch.slice(begin, PIECES)
            coded = part.column(0).dictionary_encode(null_encoding="encode")
            of = coded.indices.to_numpy(zero_copy_only=False)
            texts = [t or "" for t in part.column(1).to_pylist()]
            size = len(coded.dictionary)
            low = [t.lower() for t in texts]
            occ = np.bincount(of, [sum(t.count(w) for w in words) for t in low], size).astype(np.int64)
            points, counts = T.character_counts([t + "\n" for t in texts], of, size)
            at, place = np.nonzero(counts)
            first = points[place] == 10
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(at)), pa.array([chr(p) for p in points[place].tolist()], pa.string()),
                 pa.array(counts[at, place], pa.int64()),
                 pa.array(np.where(first, np.bincount(of, minlength=size)[at], 0), pa.int64()),
                 pa.array(np.where(first, occ[at], 0), pa.int64())], names=[key, "ch", "cnt", "n", "occ"])


def sensitive_call_sites(facts: DataFrame, key: str = KEY) -> DataFrame:
    """Call facts whose name is sensitive (P1), with their file coordinates."""
    return facts.where((F.col("kind") == "call") & P.is_sensitive_call("name")).select(key, "path", "seq", "lineno")


# ------------------------------------------------------------------ M7 ---

def build_features(facts: DataFrame, metadata: DataFrame, packages: DataFrame,
                   snippets: DataFrame | None = None, hash: str = "md5", key: str = KEY,
                   extra_api_counts: DataFrame | None = None,
                   edges: DataFrame | None = None, block_counts: DataFrame | None = None,
                   top_words: int | None = None, top_apis: int | None = None,
                   top_imports: int | None = None) -> dict[str, DataFrame]:
    """M3-M7: per-package named features (wide) and hashed features (long).

    Returns a dict with ``named`` (one row per package, 40 feature columns),
    ``hashed`` (package_id, feature, value), ``long`` (both stacked) and the
    intermediate frames reused by views and reports. ``top_words``, ``top_apis`` and
    ``top_imports`` hash only the most frequent names; by default all are hashed. Frames: (``snippets``, ``api_counts``,
    ``import_counts``, ``edges``, ``graph``, ``scalars``, ``meta_wide``).
    """
    from .extract import fact_snippets
    from .joins import merge_external_blocks

    pk = packages.select(key).distinct()
    api_counts = saved(C.count_names(facts, "call"), "api-counts")
    if extra_api_counts is not None:
        api_counts = (api_counts.unionByName(extra_api_counts.select(
            key, "name", "cnt", F.struct(F.lit("~").alias("path"), F.lit(0).alias("seq")).alias("first")))
            .groupBy(key, "name").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first")))
    import_counts = saved(C.count_names(facts, "import"), "import-counts")
    scalars = C.package_scalars(facts)
    if block_counts is not None:
        scalars = merge_external_blocks(scalars, block_counts)
    scalars = saved(scalars, "scalars")
    totals = saved(C.name_totals(api_counts, import_counts), "totals")
    e = saved(edges if edges is not None else C.edge_weights(facts).select(key, "src", "dst", "weight"), "edges")
    graph = saved(G.graph_stats(e), "graph")
    if snippets is None:
        snippets = fact_snippets(facts)
    snip = saved(snippet_features(snippets), "snippet-stats")
    meta_w = metadata_wide(metadata, pk)
    meta_f = metadata_features(meta_w)

    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = (meta_f.join(scalars, key, "left").join(totals, key, "left").join(graph, key, "left")
                   .join(snip, key, "left"))
    graph_cols = ["graph_nodes", "graph_edges", "max_indegree", "max_outdegree", "avg_degree"]
    named = named.select(
        key, *[F.col(c) for c in NAMED_FEATURES[:17]],
        N.clamp_scale(z("python_files"), 1000).alias("source_file_count"),
        (z("parse_errors") / F.greatest(F.lit(1), z("python_files"))).cast("double").alias("parse_error_ratio"),
        N.clamp_scale(z("api_unique"), 1000).alias("api_unique_count"),
        N.clamp_scale(z("api_total"), 10000).alias("api_total_count"),
        N.clamp_scale(z("sensitive_api_unique"), 100).alias("sensitive_api_unique"),
        N.clamp_scale(z("sensitive_api_total"), 500).alias("sensitive_api_total"),
        N.clamp_scale(z("sensitive_import_unique"), 100).alias("sensitive_import_unique"),
        N.clamp_scale(z("sensitive_import_total"), 500).alias("sensitive_import_total"),
        *[N.clamp_scale(z(c), 10000).alias(c) for c in graph_cols[:2]],
        F.least(z("graph_density").cast("double"), F.lit(1.0)).alias("graph_density"),
        *[N.clamp_scale(z(c), 10000).alias(c) for c in graph_cols[2:]],
        N.clamp_scale(z("cfg_nodes"), 5000).alias("cfg_nodes"),
        N.clamp_scale(z("cfg_edges"), 10000).alias("cfg_edges"),
        N.clamp_scale(z("max_nesting"), 50).alias("max_nesting"),
        z("snippet_count").cast("double").alias("snippet_count"),
        z("snippet_suspicious_words").cast("double").alias("snippet_suspicious_words"),
        z("snippet_entropy").cast("double").alias("snippet_entropy"),
        N.clamp_scale(z("high_entropy_strings"), 100).alias("high_entropy_string_count"),
        N.clamp_scale(z("url_strings"), 100).alias("url_string_count"),
        N.clamp_scale(z("long_strings"), 200).alias("long_string_count"),
    )
    named = saved(named, "named")  # what follows reads the rows of packages, not the facts again
    words = word_counts if top_words is not None else lambda pieces: word_totals(pieces, key, hash=hash)
    snippet_words = words(snippets.select(key, F.struct("path", "snippet_seq").alias("piece"), "text"))
    meta_words = words(metadata_pieces(meta_w))
    hashed = (hashed_counts(meta_words, "meta", top_words, vocab.WORD_CAP, hash=hash)
              .unionByName(hashed_counts(snippet_words, "code", top_words, vocab.WORD_CAP, hash=hash))
              .unionByName(hashed_counts(api_counts, "api", top_apis, vocab.API_CAP, hash=hash,
                                         sensitive=P.is_sensitive_call("name"), sensitive_prefix="sapi"))
              .unionByName(hashed_counts(import_counts, "import", top_imports, vocab.IMPORT_CAP, hash=hash,
                                         sensitive=P.is_sensitive_import("name"), sensitive_prefix="simport")))
    long = named_to_long(named).unionByName(hashed)
    return {"named": named, "hashed": hashed, "long": long, "snippets": snippets, "api_counts": api_counts,
            "import_counts": import_counts, "edges": e, "graph": graph, "scalars": scalars, "meta_wide": meta_w,
            "totals": totals, "snippet_stats": snip}


def named_to_long(named: DataFrame, key: str = KEY) -> DataFrame:
    """Wide named features -> ``(package_id, feature, value)`` (no shuffle)."""
    return named.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in NAMED_FEATURES
    ])).alias("f")).select(key, "f.feature", "f.value")


def vocabulary(features_long: DataFrame) -> DataFrame:
    """Sorted distinct feature names with their vector index."""
    from pyspark.sql import Window
    v = features_long.select("feature").distinct()
    return v.withColumn("idx", (F.row_number().over(Window.orderBy("feature")) - 1).cast("int"))


def vectorise(features_long: DataFrame, vocab_df: DataFrame, size: int, key: str = KEY) -> DataFrame:
    """M8: one sparse vector for each package, ``features struct<size, indices, values>`` in vocabulary order.

    Features that the vocabulary lacks, and zeros, are left out; a package without any other has no row. The vocabulary is bounded
    (40 named + 6 x buckets hashed); it is broadcast after its size is checked.
    """
    from .joins import broadcast_if_small
    vb = broadcast_if_small(vocab_df.select("feature", "idx"))
    j = features_long.join(vb, "feature", "inner").where(F.col("value") != 0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))))
    return j.groupBy(key).agg(pairs.alias("_p")).select(key, F.struct(
        F.lit(size).alias("size"), F.col("_p.idx").alias("indices"), F.col("_p.value").alias("values")).alias("features"))


def dense_vector(features: str) -> Column:
    """A sparse vector as ``array<double>`` of its size."""
    v = F.col(features)
    return F.when(v.isNotNull(), F.transform(F.sequence(F.lit(0), v["size"] - 1), lambda i: F.coalesce(
        F.get(v["values"], (F.array_position(v["indices"], i) - 1).cast("int")), F.lit(0.0))))
