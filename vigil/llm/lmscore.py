"""Language-model scores by deleted interpolation of bigram and unigram estimates.

    P(w | h) = l(b) * c(h, w) / c(h)  +  (1 - l(b)) * (c(w) + 0.5) / (N + 0.5 * (V + 1)),   b = floor(log2 c(h))

Counts come from the training rows. One weight l(b) for each bucket of context
frequencies is learned by expectation-maximisation: the counts of a fifth of the
rows (training rows, kept out of the estimates for this) are explained by estimates
from the others. An unseen context leaves the unigram alone.

Flow, with tokens as 64-bit hashes:

1. *Blocks.* About ``BLOCK_BYTES`` of a task's texts, from however many Arrow batches,
   become one block: its distinct tokens and bigrams with counts, cut into ranges of
   the hash, and its token stream. The more texts share a block, the fewer keys travel.
2. *Counting.* The ranges of all blocks meet by range; each block gets the corpus
   counts of its own keys back, in its own order. A key occurs once in a block
   however often its texts have it, so frequent words weigh no more than rare ones.
3. *Scoring.* A block's stream and its counts meet; every text keeps what its score
   needs, and blocks add the held-out counts to a histogram of bounded size, from
   which the driver learns the weights. A last map gives the scores.

Blocks and ranges are bounded, and there are never more rows than keys.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from .common import groups, partitions_for, written
from .wordspans import flat, lowered, released, scrambled, words_of

BLOCK_BYTES, RANGE_BYTES = 12 << 20, 24 << 20
BUCKETS, STEPS, ROUNDS = 40, 16, 60
NONE = 255  # the bucket of a context that training rows don't have
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HELD_OUT, ESTIMATE, WEIGHTS = 0, 1, 2
_ROW = "kind string, range long, block long, keys binary, first binary, second binary, ids binary, roles binary"


def _pairs(context, token):
    return scrambled(context * _M1 + (token ^ (token >> np.uint64(31))) * _M2)


def _stream(words, first):
    """Tokens and contexts of all texts: each text's words and the end, after the start."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    token = np.full(len(words) + len(first) - 1, END)
    token[np.arange(len(words)) + row] = words
    begin = first[:-1] + np.arange(len(first) - 1)
    return token, begin


def _contexts(token, begin, start):
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[begin] = start
    return context


def _cut(kind, keys, first, second, block, ranges):
    """Rows for the ranges of sorted keys, with their two counts."""
    edges = np.searchsorted(keys, ((np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) + np.uint64(1)) << np.uint64(32)) \
        if ranges > 1 else np.zeros(0, np.int64)
    edges = np.concatenate([[0], edges, [len(keys)]])
    for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        if hi > lo:
            yield (kind, r, block, _pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), _pack(first[lo:hi].astype(np.uint32)), _pack(second[lo:hi].astype(np.uint32)), None, None)


def _batch(rows):
    columns = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "range", "block", "keys", "first", "second", "ids", "roles"])


def _kept(column: pa.Array) -> bytes:
    """A column as it is, of whatever type, nulls included."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["row_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _column(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: the high ones compress to nothing."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _gathered(batches, size: int):
    """The rows of ``batches`` in blocks of about ``size`` bytes of text (one row at least); how they are batched is all the same."""
    held, room = [], size
    for batch in batches:
        lo, ends = 0, flat(batch.column("text"))[1]
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + room, "right")) - 1
            if not held:
                hi = max(hi, lo + 1)
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                room -= int(ends[hi] - ends[lo])
                lo = hi
            if lo < batch.num_rows:
                yield pa.concat_batches(held)
                held, room = [], size
                released()
    if held:
        yield pa.concat_batches(held)
        released()


def _sorted_pack(numbers: np.ndarray) -> bytes:
    """Numbers whose order doesn't matter: sorted, by their differences."""
    return _pack(np.diff(np.sort(numbers), prepend=numbers.dtype.type(0)))


def _blocks(rows: DataFrame, ranges: int, streams: bool) -> DataFrame:
    """The blocks of rows (row_id, text, role): their streams (kind s), or their requests (kinds u and b).

    Both read the rows once; a block is the same in both as long as the input gives its rows in the same order.
    """
    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for part in _gathered(batches, BLOCK_BYTES):
            data, offsets = flat(part.column("text"))
            words = words_of(data, offsets, lowered())
            role = part.column("role").to_numpy(zero_copy_only=False).astype(np.int8)
            token, begin = _stream(words.hash, words.first)
            own = np.repeat(role, np.diff(words.first) + 1)
            keys, at = np.unique(token, return_inverse=True)
            if streams:
                # frequent words get small numbers, by powers of two; those alike in that stay sorted by key, so that differences travel
                rank = np.empty(len(keys), np.int64)
                rank[np.argsort(-np.bincount(at, minlength=len(keys)), kind="stable")] = np.arange(1, len(keys) + 1)
                often = np.argsort(np.frexp(rank)[1], kind="stable")
                number = np.empty(len(keys), np.uint32)
                number[often] = np.arange(len(keys), dtype=np.uint32)
                yield _batch([("s", 0, block, _pack(np.diff(keys[often], prepend=np.uint64(0))), _pack(number[at]), np.diff(words.first).astype(np.int64).tobytes(), _kept(part.column("row_id")), role.tobytes())])
                block += 1
                continue
            count = lambda at, n, which: np.bincount(at[own == which], minlength=n)
            begins = [[(role == which).sum()] for which in (ESTIMATE, WEIGHTS)]
            place = int(np.searchsorted(keys, START))  # the start counts as a context, once for each text
            yield _batch(_cut("u", np.insert(keys, place, START), *(np.insert(count(at, len(keys), w), place, b) for w, b in zip((ESTIMATE, WEIGHTS), begins)), block, ranges))
            pairs, where = np.unique(_pairs(_contexts(token, begin, START), token), return_inverse=True)
            yield _batch(_cut("b", pairs, count(where, len(pairs), ESTIMATE), count(where, len(pairs), WEIGHTS), block, ranges))
            block += 1

    return rows.mapInArrow(run, _ROW)


def _counted(requests: DataFrame, parts_: int) -> DataFrame:
    """For every request the corpus counts of its keys; and kind n, the numbers of tokens and of distinct ones."""
    def run(batches):
        for where, table in groups(batches, "where"):
            kind = where.partition(":")[0]
            rows = table.select(["range", "block", "keys", "first", "second"]).to_pylist()
            keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = [np.bincount(at, np.concatenate([_unpack(r[c], np.uint32) for r in rows]), len(every)).astype(np.int64) for c in ("first", "second")]
            edges = np.cumsum([0, *map(len, keys)])
            out = []
            for r, lo, hi in zip(rows, edges[:-1], edges[1:]):
                both = [_pack(t[at[lo:hi]].astype(np.uint32)) for t in totals]
                out.append((kind, r["range"], r["block"], None, *both, None, None))
            if kind == "u":
                real = every != START
                all_, some = (totals[0] + totals[1])[real], totals[0][real]
                out.append(("n", 0, -1, np.array([all_.sum(), (all_ > 0).sum(), some.sum(), (some > 0).sum()], np.int64).tobytes(), *[None] * 4))
            yield _batch(out)

    named = requests.withColumn("where", F.concat_ws(":", "kind", "range"))
    return named.repartition(parts_, "where").sortWithinPartitions("where").mapInArrow(run, _ROW)


def _parted(streams: DataFrame, counts: DataFrame, parts_: int, id_field: StructField) -> DataFrame:
    """What the scores need: kind d for each text, kind h histograms of the weights' part, kind n as they are."""
    schema = StructType([StructField("kind", StringType()), id_field, *StructType.fromDDL("role int, n_tokens long, n_known long, logs double, data binary").fields])
    arrow_id = to_arrow_type(id_field.dataType)

    def rows_of(table):
        by = {"u": [], "b": []}
        stream = None
        for r in table.select(["kind", "range", "keys", "first", "second", "ids", "roles"]).to_pylist():
            if r["kind"] == "s":
                stream = r
            else:
                by[r["kind"]].append((r["range"], _unpack(r["first"], np.uint32), _unpack(r["second"], np.uint32)))
        given = np.cumsum(_unpack(stream["keys"], np.uint64), dtype=np.uint64)
        order = np.argsort(given)
        keys, place_of = given[order], np.empty(len(given), np.int32)
        place_of[order] = np.arange(len(given), dtype=np.int32)
        at = place_of[_unpack(stream["first"], np.uint32)]
        length, ids, role = np.frombuffer(stream["second"], np.int64), _column(stream["ids"]), np.frombuffer(stream["roles"], np.int8)
        token = keys[at]
        begin = np.concatenate([[0], np.cumsum(length + 1)])
        _, pair = np.unique(_pairs(_contexts(token, begin[:-1], START), token), return_inverse=True)
        place = int(np.searchsorted(keys, START))
        del token
        at = at + (at >= place).astype(np.int32)
        context = _contexts(at, begin[:-1], place)
        counts = {k: [np.concatenate([x[i] for x in sorted(v, key=lambda x: x[0])]).astype(np.float64) for i in (1, 2)] for k, v in by.items()}
        by.clear()
        if len(counts["u"][0]) != len(keys) + 1 or len(counts["b"][0]) != pair.max(initial=-1) + 1:
            raise ValueError("the two passes saw different rows: write them to a table first")

        def ratios(u, b):
            """Buckets of the contexts, and c(h, w) / (c(h) * (c(w) + 0.5)), which the denominator N + 0.5 (V + 1) makes the ratio of the estimates."""
            ch = u[context]
            bucket = np.where(ch > 0, np.minimum(np.log2(np.maximum(ch, 1)), BUCKETS - 1), NONE).astype(np.uint8)
            return bucket, np.where(ch > 0, b[pair] / (np.maximum(ch, 1) * (u[at] + 0.5)), 0)

        all_u = counts["u"][0] + counts["u"][1]
        bucket, ratio = ratios(all_u, counts["b"][0] + counts["b"][1])
        logs, known = np.log10(all_u[at] + 0.5), all_u[at] > 0
        out = []
        for i, (lo, hi) in enumerate(zip(begin[:-1], begin[1:])):
            own, r = bucket[lo:hi], ratio[lo:hi]
            seen = r > 0
            unseen = np.bincount(own[~seen & (own != NONE)], minlength=BUCKETS).astype(np.uint32)
            # ratios to 16 bits of the mantissa, by rounding the fourth byte of a float
            r = (r[seen].astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)
            data = unseen.tobytes() + _sorted_pack(r | own[seen].astype(np.uint32) << np.uint32(24))
            out.append(("d", i, int(role[i]), int(hi - lo), int(known[lo:hi].sum()), float(logs[lo:hi].sum()), data))
        chosen = np.repeat(role, length + 1) == WEIGHTS
        if chosen.any():
            bucket, ratio = ratios(counts["u"][0], counts["b"][0])
            use = chosen & (bucket != NONE)
            level = np.where(ratio[use] > 0, np.round(np.log2(np.maximum(ratio[use], 1e-300)) * STEPS), -(1 << 20)).astype(np.int64)
            cell, n = np.unique(bucket[use].astype(np.int64) << 32 | (level + (1 << 24)), return_counts=True)
            cells = np.stack([cell >> 32, (cell & ((1 << 32) - 1)) - (1 << 24)])
            out.append(("h", None, None, None, None, None, np.concatenate([cells, n[None]]).astype(np.int64).tobytes()))
        return out, ids

    def run(batches):
        for block, table in groups(batches, "block"):
            if block < 0:
                rows, ids = [("n", None, None, None, None, None, k) for k in table.column("keys").to_pylist()], pa.nulls(0, arrow_id)
            else:
                rows, ids = rows_of(table)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            for lo in range(0, len(rows), 2000):
                kind, place, *rest = [pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 2000]), kinds)]
                yield pa.RecordBatch.from_arrays([kind, ids.take(place), *rest], names=["kind", "row_id", "role", "n_tokens", "n_known", "logs", "data"])

    return streams.unionByName(counts).repartition(parts_, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def learned(cells: np.ndarray, denominator: float) -> np.ndarray:
    """The weight of each bucket by EM, from rows (bucket, log2 ratio in steps, count)."""
    weights = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b]
        if len(own):
            ratio = np.where(own[:, 1] > -(1 << 19), np.exp2(own[:, 1] / STEPS) * denominator, 0)
            n, l = own[:, 2].astype(float), 0.5
            for _ in range(ROUNDS):
                l = (np.sum(n * l * ratio / (l * ratio + 1 - l)) + 0.5) / (n.sum() + 1)
            weights[b] = l
    return weights


def log_scores(docs: DataFrame, fold: str = "fold", total_bytes: int | None = None) -> DataFrame:
    """row_id, held_out, n_tokens, n_known, train_tokens, base_score and score for rows (row_id, text, ``fold``).

    ``fold`` is 0 to 4: 1 is held out, 4 (a training fold) also teaches the weights, whose estimates then come from
    0, 2 and 3. A null or empty text is one end token. Without training rows all estimates are those of an empty
    corpus. Rows keep their row_id, of any type, which need not be unique and may be null. Other columns are ignored.
    """
    spark = docs.sparkSession
    role = F.when(F.col(fold) == 1, HELD_OUT).when(F.col(fold) == 4, WEIGHTS).otherwise(ESTIMATE)
    rows = docs.select("row_id", "text", role.cast("int").alias("role"))
    id_field = StructField("row_id", rows.schema["row_id"].dataType)
    if total_bytes is None:
        total_bytes = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = partitions_for(spark, total_bytes, RANGE_BYTES)
    counts = _counted(_blocks(rows, ranges, False), ranges)
    done = written(_parted(_blocks(rows, ranges, True), counts, ranges, id_field), "parted")
    small = done.where("kind != 'd'").select("kind", "data")
    stats = [0, 0, 0, 0]
    hist = np.zeros((0, 3), np.int64)
    for r in _summed(small).collect():
        if r["kind"] == "n":
            stats = [r["a"], r["b"], r["c"], r["n"]]
        else:
            hist = np.concatenate([hist, [[r["a"], r["b"], r["n"]]]])
    tokens, types, some_tokens, some_types = stats
    weights = learned(hist, some_tokens + 0.5 * (some_types + 1))
    denominator = tokens + 0.5 * (types + 1)

    def run(batches):
        keep, change = np.append(1 - weights, 1), np.append(weights, 0)
        for batch in batches:
            base = batch.column("logs").to_numpy() - batch.column("n_tokens").to_numpy() * np.log10(denominator)
            more = []
            for data in batch.column("data"):
                raw = data.as_buffer()
                unseen = np.frombuffer(raw, np.uint32, BUCKETS)
                seen = np.cumsum(_unpack(bytes(raw[4 * BUCKETS:]), np.uint32), dtype=np.uint32)
                bucket, ratio = seen >> np.uint32(24), (seen << np.uint32(8)).view(np.float32).astype(float)
                more.append(np.log10(keep[bucket] + change[bucket] * ratio * denominator).sum() + (unseen * np.log10(keep[:BUCKETS])).sum())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(batch.column("role").to_numpy() == HELD_OUT), batch.column("n_tokens"), batch.column("n_known"),
                                              pa.array(np.full(batch.num_rows, tokens, np.int64)), pa.array(base), pa.array(base + np.array(more, float))],
                                             names=["row_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    made = StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.where("kind = 'd'").mapInArrow(run, StructType([id_field, *made.fields]))


def _summed(small: DataFrame) -> DataFrame:
    """The sums of the statistics (one row) and of the histograms (a row for each cell)."""
    def run(batches):
        for batch in batches:
            rows = []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
                x = np.frombuffer(data, np.int64)
                rows += [("n", 0, 0, int(x[0]), int(x[1]), int(x[2]), int(x[3]))] if kind == "n" else [("h", int(a), int(b), 0, 0, 0, int(n)) for a, b, n in x.reshape(3, -1).T]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 6])], names=["kind", "i", "j", "a", "b", "c", "n"])

    cells = small.mapInArrow(run, "kind string, i long, j long, a long, b long, c long, n long").groupBy("kind", "i", "j").agg(*(F.sum(x).alias(x) for x in "abcn"))
    return cells.select("kind", F.when(F.col("kind") == "h", F.col("i")).otherwise(F.col("a")).alias("a"),
                        F.when(F.col("kind") == "h", F.col("j")).otherwise(F.col("b")).alias("b"), "c", "n")
