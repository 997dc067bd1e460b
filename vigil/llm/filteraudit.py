"""Filter interaction audit: what each filter removes, under every order of the filters.

Every document has a failure mask, one bit for each filter. Documents are counted by
part and mask in Spark; from then on a part is at most 2 ** 5 rows. For each part a
count-weighted decision diagram is built: a level for each filter, two edges (pass,
fail) at each node, equal subgraphs shared, and as the weight of a node the counts of
the documents below it. Changing the order of two neighbouring filters swaps two
adjacent levels and leaves all other nodes as they are; a walk of such swaps visits
all orders. On the path on which all filters pass, the weight of a node's two
successors is what its filter keeps and removes at that step.

Filters, on words ``[^\\x20\\x09-\\x0D]+``: A under 200 words; B fewer than half of the
words distinct; C over 3 % of the code points in A-Z; D any of ``#$%&*|``; E the text of
a smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended
from .wordspans import flat, parts

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SALTS = 16
#: Longer texts are split into words piece by piece, and their distinct words counted by 64-bit hash.
PIECE = 4 << 20
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_SPACE = b" \t\n\x0b\x0c\r"
_AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def _words(text: bytes) -> tuple[int, int]:
    """The numbers of words and of distinct words."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    import xxhash

    n, seen, lo = 0, np.zeros(0, np.uint64), 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and text[hi] not in _SPACE:  # a piece ends before white space
            hi += 1
        words = text[lo:hi].split()
        n += len(words)
        seen = np.union1d(seen, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in set(words)), np.uint64))
        lo = hi
    return n, len(seen)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (bits of A to D) of every document; a null text is empty, a null lang the part ``''``."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    made = extended(rows.drop("text"), {"digest": "binary", "mask": "int"})

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                column = part.column("text").fill_null("")
                data, offsets = flat(column)
                points = pc.utf8_length(column).to_pylist()
                digests, found = [], []
                for i, n in enumerate(points):
                    text = data[offsets[i]:offsets[i + 1]].tobytes()
                    words, distinct = _words(text)
                    upper = len(text) - len(text.translate(None, _UPPER))
                    symbols = len(text) - len(text.translate(None, _SYMBOLS))
                    fails = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * n, symbols > 0)
                    digests.append(hashlib.md5(text).digest())
                    found.append(sum(1 << k for k, f in enumerate(fails) if f))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(found, pa.int32())],
                                                 names=["doc_id", "part", "digest", "mask"])

    return rows.mapInArrow(run, made)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: documents by what they fail, and how many of them are labelled so.

    A document is good or toxic if any label of its doc_id says so. Rows with a null doc_id have no label, copy
    nothing and are not copied; rows under one doc_id with one text are no copies of each other.
    """
    rows = masks(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flags = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
             .where("good or toxic").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    # one doc_id may be on a third of all rows, so are null ones: the salt deals them out by text
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    # never by broadcast: the planner goes by the labels' bytes on disk, a tenth and less of what their salted rows take in memory
    known = (rows.withColumn("salt", salt).join(flags.hint("merge"), ["doc_id", "salt"], "left")
             .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
    # doc_id, digest, part and mask are unique by now, so the least doc_id of a group brings all of its rows along
    kind = ["digest", "part", "mask", "good", "toxic"]
    alike = known.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
                                     F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = alike.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"))
    own = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    copies = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n"))))
    split = (alike.join(first, "digest").select("part", "good", "toxic", copies.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0"))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                             F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Diagram:
    """A quasi-reduced decision diagram over failure masks, weighted by counts (documents, good, toxic).

    Every path visits every level, so that the weight of a node is the sum of its successors' weights.
    """

    def __init__(self, counts: dict[int, tuple[int, int, int]], order: str = FILTERS):
        self.order = list(order)
        self.weight: dict[int, tuple] = {}
        self.edges: dict[int, tuple[int, int]] = {}  # node: its successors on pass and on fail
        self.shared: list[dict] = [{} for _ in range(len(order) + 1)]  # by level: edges, or a terminal's counts, to node

        def build(level: int, mask: int) -> int:
            if level == len(order):
                return self._terminal(counts.get(mask, (0, 0, 0)))
            bit = 1 << FILTERS.index(order[level])
            return self._node(level, build(level + 1, mask), build(level + 1, mask | bit))

        self.root = build(0, 0)

    def _terminal(self, weight: tuple) -> int:
        node = self.shared[-1].setdefault(weight, len(self.weight))
        self.weight[node] = weight
        return node

    def _node(self, level: int, passed: int, failed: int) -> int:
        node = self.shared[level].get((passed, failed))
        if node is None:
            node = self.shared[level][passed, failed] = len(self.weight)
            self.edges[node] = (passed, failed)
            self.weight[node] = tuple(map(sum, zip(self.weight[passed], self.weight[failed])))
        return node

    def swap(self, level: int) -> None:
        """Exchange ``level`` and the next one; nodes of other levels, and what each node stands for, stay."""
        upper = self.shared[level]
        self.shared[level], self.shared[level + 1] = {}, {}
        for (passed, failed), node in upper.items():
            (pp, pf), (fp, ff) = self.edges[passed], self.edges[failed]
            self.edges[node] = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.shared[level][self.edges[node]] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, tuple, tuple]]:
        """Along the path on which all pass: the filter, and the counts that it keeps and removes."""
        node = self.root
        for f in self.order:
            node, failed = self.edges[node]
            yield f, self.weight[node], self.weight[failed]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places to swap with the next one, so that all n! orders come by, each once (the given order is the first)."""
    place, way = list(range(n)), [-1] * n  # place[i]: where the i-th element stands
    while True:
        for i in reversed(range(n)):
            to = place[i] + way[i]
            if 0 <= to < n and (other := place.index(to)) < i:
                yield min(place[i], to)
                place[i], place[other] = to, place[i]
                way[i + 1:] = [-w for w in way[i + 1:]]
                break
        else:
            return


def audited(counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram = Diagram(counts)
    seen = [("".join(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(len(FILTERS)):
        diagram.swap(level)
        seen.append(("".join(diagram.order), list(diagram.steps())))
    fails = {order[0]: steps[0][2][0] for order, steps in seen}
    unique = {order[-1]: steps[-1][2][0] for order, steps in seen}
    shapley = dict.fromkeys(FILTERS, 0)
    for _, steps in seen:
        for f, _, removed in steps:
            shapley[f] += removed[0]
    return [(order, i + 1, kept[0], removed[0], fails[f] - removed[0], unique[f], removed[1], removed[2], shapley[f])
            for order, steps in sorted(seen) for i, (f, kept, removed) in enumerate(steps)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: 600 rows a part.

    Documents are counted: kept after the step, removed at it, redundant (failing its filter, but removed before),
    unique_fails (failing its filter only), good_lost and toxic_lost among the removed; shapley is what its filter
    removes, summed over all orders. Without documents there is no part and no row; other columns are ignored.
    """
    names = [c.strip().split()[0] for c in _AUDIT.split(",")]

    def one(key, rows):
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        return pd.DataFrame([(key[0], *r) for r in audited(counts)], columns=names)

    return mask_counts(docs, labels).groupBy("part").applyInPandas(one, _AUDIT)
