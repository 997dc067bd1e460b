"""Exact removal of long repeated byte strings by prefix-free parsing.

*Parsing.* A rolling hash of ``WINDOW`` (100) bytes triggers a phrase where it is the
least of some 101 neighbouring windows. Every string of ``LENGTH`` (200) bytes holds
101 windows, so it holds a trigger, at the same place in all its occurrences. Phrases
run from one trigger to the end of the next, overlapping by the window, so no phrase
is a prefix of another and a text is its sequence of phrases.

*Order.* The corpus order of suffixes is needed only up to their first 200 bytes:
suffixes with equal heads stand together in it. A head that holds a trigger is a stretch
of the trigger's *context*, the 100 bytes before it and 200 from it on: a suffix of the
phrase before, and what follows in the parse. So heads are compared by trigger:

1. triggers met once in the corpus can lie in no repeated head; a fixed-size bitmap of
   the others thins the rows, and an exact join follows;
2. equal contexts are counted. One met twice has all its heads repeated;
3. contexts met once are compared with all different contexts of their trigger, by the
   hashes of the bytes before and after. Heads of one trigger overlap, so the first and
   the last repeated one tell what is covered. A trigger with more than ``HOT`` different
   contexts is compared by counting the digests of its heads instead.

*Removal.* Bytes covered by a repeated head go. Only digests and places are shuffled, and
the texts of those documents that hold contexts to compare or bytes to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, extended, groups, maybe_in, partitions_for, written
from .wordspans import _powers, as_is, flat, parts, scrambled

LENGTH, WINDOW = 200, 100
#: Triggers with more different contexts than this are compared by counting heads.
HOT = 20_000
_RUN = LENGTH - WINDOW + 1


def _least(values: np.ndarray, n: int, least=np.minimum) -> np.ndarray:
    """The least (or by ``least`` the greatest) of each ``n`` neighbouring values."""
    m, s = values, 1
    while 2 * s <= n:
        m = least(m[:-s], m[s:])
        s *= 2
    return m if s == n else least(m[:len(values) - n + 1], m[n - s:n - s + len(values) - n + 1])


def _hashed(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hash of each window of a text, and the least of each head's windows."""
    n = len(text)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(as_is()[text] * power[:n], out=sums[1:])
    h = scrambled((sums[WINDOW:] - sums[:-WINDOW]) * inverse[:n - WINDOW + 1])
    return h, _least(h, _RUN)


def triggers(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the triggers of one text (bytes), and the hashes of their windows."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, low = _hashed(text)
    # a window is a trigger if it is the least of some run that holds it
    padded = np.concatenate([np.zeros(_RUN - 1, np.uint64), low, np.zeros(_RUN - 1, np.uint64)])
    at = np.flatnonzero(_least(padded, _RUN, np.maximum) == h)
    return at, h[at]


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts long enough to hold a head, with their identity: 64-bit hash and length."""
    return docs.where(F.octet_length("text") >= LENGTH).select(F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"), "text")


def _trigger_hashes(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), 1 << 20):
                data, offsets = flat(batch.column("text").slice(lo, hi - lo))
                found = [triggers(data[a:z])[1] for a, z in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["trigger"])

    return rows.select("text").mapInArrow(run, "trigger long")


def _contexts(rows: DataFrame) -> DataFrame:
    """(trigger, context, key, size, at) of every trigger."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                hashes, digests, places, row = [], [], [], []
                for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:])):
                    at, h = triggers(data[a:z])
                    whole = data[a:z].tobytes()
                    hashes.append(h)
                    places.append(at)
                    digests += [hashlib.blake2b(whole[max(0, p - WINDOW):p + LENGTH], digest_size=16, salt=bytes((min(p, WINDOW),))).digest() for p in at.tolist()]
                    row.append(np.full(len(at), i))
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(digests, pa.binary()), part.column("key").take(row),
                                                  part.column("size").take(row), pa.array(np.concatenate(places).astype(np.int32))],
                                                 names=["trigger", "context", "key", "size", "at"])

    return rows.mapInArrow(run, "trigger long, context binary, key long, size int, at int")


_BYTES = "trigger long, context binary, n long, before binary, after binary"


def _context_bytes(rows: DataFrame) -> DataFrame:
    """The bytes of the contexts asked for: texts with ``asked`` (trigger, context, n, at)."""
    def run(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist()):
                whole = memoryview(text.as_buffer())
                for x in asked:
                    p = x["at"]
                    out.append((x["trigger"], x["context"], x["n"], bytes(whole[max(0, p - WINDOW):p]), bytes(whole[p + WINDOW:p + LENGTH])))
                    if len(out) == 5000:
                        yield _as_batch(out, _BYTES)
                        out = []
            if out:
                yield _as_batch(out, _BYTES)

    return rows.select("text", "asked").mapInArrow(run, _BYTES)


def _as_batch(rows, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _running(rows: list[bytes], backwards: bool) -> np.ndarray:
    """For each row the hashes of its first 0..100 bytes (backwards: last), 0 where it has fewer."""
    out = np.zeros((len(rows), WINDOW + 1), np.uint64)
    grid = np.zeros((len(rows), WINDOW), np.uint8)
    length = np.array([len(r) for r in rows])
    for i, r in enumerate(rows):
        x = np.frombuffer(r, np.uint8)
        grid[i, :len(x)] = x[::-1] if backwards else x
    power, _ = _powers(WINDOW)
    np.cumsum(as_is()[grid] * power[:WINDOW], axis=1, out=out[:, 1:])
    out = scrambled(out + np.uint64(1 if backwards else 2))
    out[np.arange(WINDOW + 1)[None, :] > length[:, None]] = 0
    return out


def _extents(trigger: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts: the most and the least bytes before the trigger at which a repeated head begins (-1: none).

    A head that begins ``a`` bytes before its trigger holds these and the ``100 - a`` after the window.
    """
    left, right = _running(before, True), _running(after, False)
    most, least = np.full(len(trigger), -1), np.full(len(trigger), -1)
    for a in range(WINDOW + 1):
        ok = np.flatnonzero((left[:, a] != 0) & (right[:, WINDOW - a] != 0))
        key = scrambled(left[ok, a] + scrambled(right[ok, WINDOW - a] ^ trigger[ok]))
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = ok[n[at] > 1]
        most[twice] = a
        least[twice[least[twice] < 0]] = a
    return most, least


_EXTENT = "context binary, most int, least int"


def _compared(rows: DataFrame, parts_: int) -> DataFrame:
    """(context, most, least) of contexts met once, compared with the others of their trigger; many triggers at a time."""
    def run(batches):
        held, n = {}, 0
        for trigger, table in groups(batches, "trigger"):
            own = {r["context"]: (trigger, r["n"], r["before"], r["after"]) for r in table.drop_columns(["trigger"]).to_pylist()}
            held |= own
            if len(held) >= 4000:
                yield from found(held)
                held = {}
        if held:
            yield from found(held)

    def found(held):
        contexts = list(held)
        rows = list(held.values())
        most, least = _extents(np.array([r[0] for r in rows], np.int64).view(np.uint64), [r[2] for r in rows], [r[3] for r in rows])
        out = [(c, int(m), int(l)) for c, r, m, l in zip(contexts, rows, most, least) if r[1] == 1 and m >= 0]
        if out:
            yield _as_batch(out, _EXTENT)

    return rows.repartition(parts_, "trigger").sortWithinPartitions("trigger").mapInArrow(run, _EXTENT)


def _counted(rows: DataFrame) -> DataFrame:
    """The same for triggers with any number of contexts, by counting heads."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for a in range(max(0, WINDOW - len(r["after"])), len(r["before"]) + 1):
                    head = hashlib.blake2b(r["before"][len(r["before"]) - a:] + r["after"][:WINDOW - a], digest_size=16, salt=bytes((a,)), key=r["trigger"].to_bytes(8, "little", signed=True))
                    out.append((r["context"], r["n"], a, head.digest()))
                    if len(out) == 10000:
                        yield _as_batch(out, schema)
                        out = []
            if out:
                yield _as_batch(out, schema)

    schema = "context binary, n long, a int, head binary"
    heads = rows.dropDuplicates(["context"]).mapInArrow(run, schema)
    twice = heads.groupBy("head").agg(F.count("*").alias("c")).where("c > 1").select("head")
    return heads.where("n = 1").join(twice, "head", "left_semi").groupBy("context").agg(F.max("a").alias("most"), F.min("a").alias("least"))


def covered(docs: DataFrame) -> DataFrame:
    """(key, size, spans): for every text with one, stretches (first, last + 1) that repeated heads cover; they may overlap."""
    spark = docs.sparkSession
    rows = _keyed(docs)
    again = written(_trigger_hashes(rows).groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger"), "triggers")
    found = written(maybe_in(_contexts(rows), "trigger", bitmap(again, "trigger")).join(again, "trigger", "left_semi"), "contexts")
    classes = written(found.groupBy("context").agg(F.count("*").alias("n"), F.min(F.struct("trigger", "key", "size", "at")).alias("first"))
                      .select("context", "n", "first.*"), "classes")
    open_ = (classes.groupBy("trigger").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("least = 1 and c > 1")
             .select("trigger", (F.col("c") > HOT).alias("hot")))
    asked = written(classes.join(open_, "trigger").groupBy("key", "size").agg(
        F.collect_list(F.struct("trigger", "context", "n", "at", "hot")).alias("asked")), "asked")
    # of exact copies one is enough: a context's bytes are asked of one text
    one = maybe_in(rows, "key", bitmap(asked, "key")).groupBy("key", "size").agg(F.first("text").alias("text"))
    near = written(one.join(asked, ["key", "size"]), "near")
    total = asked.agg(F.sum(F.size("asked")).alias("n")).first()["n"]
    cool = _compared(_context_bytes(near.withColumn("asked", F.filter("asked", lambda x: ~x["hot"]))), partitions_for(spark, total, 50_000))
    extents = cool
    if not open_.where("hot").isEmpty():
        extents = cool.unionByName(_counted(_context_bytes(near.withColumn("asked", F.filter("asked", lambda x: x["hot"])))))
    extents = written(extents, "extents")
    all_of = classes.where("n > 1").select("context", F.lit(None).cast("int").alias("most"), F.lit(None).cast("int").alias("least"))
    spans = (found.join(extents.unionByName(all_of), "context")
             .withColumn("most", F.coalesce("most", F.least(F.col("at"), F.lit(WINDOW))))
             .withColumn("least", F.coalesce("least", F.greatest(F.lit(0), F.lit(LENGTH) - F.col("size") + F.col("at"))))
             .where("most >= least"))
    return written(spans.groupBy("key", "size").agg(F.collect_set(F.struct((F.col("at") - F.col("most")).alias("a"), (F.col("at") - F.col("least") + LENGTH).alias("z")))
                                                   .alias("spans")), "spans")


def removed(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, binary).

    A byte goes if it lies in a string of 200 bytes that starts anywhere else, in another row or in the same; strings
    are judged on the input. A null text counts as empty, texts under 200 bytes stay whole, equal rows are different
    rows. Columns with the names of new ones are replaced.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    spans = covered(docs)
    rows = docs.drop(*made, "__key", "__size", "__spans").withColumns({"__key": F.xxhash64("text"), "__size": F.coalesce(F.octet_length("text"), F.lit(0))})
    lists = spans.select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    here = maybe_in(rows, "__key", bitmap(spans, "key"), keep=True)
    touched = here.where("__maybe").drop("__maybe").join(lists, ["__key", "__size"], "left").select(*rows.columns, "__spans")
    rest = here.where("not __maybe").drop("__maybe").withColumn("__spans", F.lit(None).cast(spans.schema["spans"].dataType))
    names = [c for c in rows.columns if c not in ("__key", "__size")]

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), 4 << 20):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                out = []
                for a, z, own in zip(offsets[:-1], offsets[1:], part.column("__spans").to_pylist()):
                    out.append(_cut(data[a:z], [(x["a"], x["z"]) for x in own or ()]))
                columns = zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, t) for c, t in columns)], names=[*names, *made])

    schema = extended(docs.select(*names), dict(zip(made, ["long", "long", "long", "string", "binary"])))
    return touched.unionByName(rest).drop("__key", "__size").mapInArrow(run, schema)


def _cut(text: np.ndarray, stretches) -> tuple[int, int, int, str, bytes]:
    whole = text.tobytes()
    kept, at, gone, spans = [], 0, 0, 0
    end = -1
    for a, z in sorted(stretches):
        spans += a > end
        if a > at:
            kept.append(whole[at:a])
        gone += max(0, z - max(a, at))
        at = end = max(at, z)
    kept.append(whole[at:])
    left = b"".join(kept)
    return len(whole), gone, spans, hashlib.sha256(left).hexdigest(), left
