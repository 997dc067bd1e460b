"""Substring deduplication by content-defined chunking.

A gear hash (shift, add a table value for the next byte) rolls over the bytes of a
text; it depends on the last 16 bytes only. A text is cut where the hash is
strictly least among the ``REACH`` places before and after, then moved on to the
next word, so cuts depend on nothing but the bytes near them and an insertion moves
no cut farther away. Chunks are at least ``REACH`` bytes before that move, about
twice that on average; without a cut they end after ``LONGEST`` bytes.

Chunks are known by digest. The first chunk of a digest (by doc_id, text digest,
place) stays, later ones go if they lie in a stretch of neighbouring later copies
of at least ``MIN_RUN`` bytes; shorter repeats are common phrases. Cuts near the ends
of a passage depend on what stands around it, so a stretch is first made longer, byte
by byte and to whole words, as far as its text goes on like that of the first copies
of its first and last chunk. What the two have in common ends within the chunk next to
the stretch or a few bytes on (``BEHIND``, ``AHEAD``): further on, the same bytes would
have made the same cut, and the chunk would be part of the stretch.

Whole copies come first: of equal texts the one of the least doc_id leads, and a
bitmap of all leads tells surely that a row is none; it goes whole, without a join.
The leads' chunk hashes are counted; a bitmap of those met twice thins the chunks that
are sent with their places. Digests are pre-aggregated, and only those met twice are
joined back, so no group is ever gathered. Chunks become stretches at once, and bytes
travel for the two ends of a stretch only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, extended, maybe_in, written
from .wordspans import SPACE, flat, parts

REACH, LONGEST, MIN_RUN, SNAP = 16, 4096, 96, 48
_WINDOW = 16
#: Bytes that a cut depends on before and after it: where they and the chunk are the same, so is the cut.
BEHIND, AHEAD = SNAP + REACH + _WINDOW + 4, SNAP + REACH + 4
#: Bytes of text worked on at a time: the arrays beside them take some sixty times as much.
PART = 1 << 18
GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GEAR[255] = 0  # never a byte of UTF-8: it stands between texts


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the last 16 bytes, each shifted four bits further than the next."""
    h, s = GEAR[data], 1
    while s < _WINDOW:
        longer = h.copy()
        longer[s:] += h[:-s] << np.uint64(4 * s)
        h, s = longer, 2 * s
    return h


def _ahead(h: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on; ``n`` is a power of two."""
    m, s = h.copy(), 1
    while s < n:
        m[:-s] = np.minimum(m[:-s], m[s:])
        s *= 2
    return m


def chunks(column: pa.Array) -> list[np.ndarray]:
    """For every text of a column the borders of its chunks: 0, ..., length in bytes (one border if it is empty)."""
    data, offsets = flat(column)
    length = np.diff(offsets)
    gap = max(REACH + _WINDOW, SNAP)  # no cut moves on to the next text
    begin = offsets[:-1] - offsets[0] + gap * np.arange(1, len(length) + 1)
    padded = np.full(int(length.sum()) + gap * (len(length) + 1), 255, np.uint8)
    row = np.repeat(np.arange(len(length)), length)
    padded[np.arange(len(row)) + gap * (row + 1)] = data[offsets[0]:offsets[-1]]
    h = rolled(padded)
    h[padded == 255] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _ahead(h, REACH)
    cut = np.zeros(len(h), bool)
    cut[REACH:-1] = (h[REACH:-1] < least[:-REACH - 1]) & (h[REACH:-1] < least[REACH + 1:])
    at = np.flatnonzero(cut) + 1
    spaces = np.flatnonzero(SPACE[padded])
    starts = np.flatnonzero((padded & 0xC0) != 0x80)
    def moved(at):
        i = np.searchsorted(spaces, at - 1)
        near = np.append(spaces, len(padded) + SNAP)[i] + 1
        return np.where(near - at <= SNAP, near, np.append(starts, len(padded))[np.searchsorted(starts, at)])
    at = np.unique(moved(at))
    out = []
    for b, n, lo, hi in zip(begin, length, np.searchsorted(at, begin, "right"), np.searchsorted(at, begin + length)):
        own = np.concatenate([[0], at[lo:hi] - b, [n]]) if n else np.zeros(1, np.int64)
        if len(own) > 1 and np.diff(own).max() > LONGEST:
            more = np.concatenate([np.arange(a + LONGEST, z, LONGEST) for a, z in zip(own[:-1], own[1:])])
            own = np.unique(np.concatenate([own, np.minimum(moved(more + b) - b, n)]))
        out.append(own)
    return out


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, seq) of every chunk."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                digests, seq = [], []
                for o, own in zip(offsets[:-1], chunks(part.column("text"))):
                    whole = data[o:o + own[-1]].tobytes()
                    at = own.tolist()
                    digests += [hashlib.blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(at[:-1], at[1:])]
                    seq.append(np.arange(len(own) - 1, dtype=np.int32))
                row = pa.array(np.repeat(np.arange(hi - lo), [len(s) for s in seq]))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("doc_id").take(row), part.column("text_key").take(row),
                                                  pa.array(np.concatenate(seq))], names=["digest", "doc_id", "text_key", "seq"])

    return docs.mapInArrow(run, f"digest binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, seq int")


def _chunk_hashes(docs: DataFrame) -> DataFrame:
    """A 64-bit hash of every chunk, the first half of its digest."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                column = batch.column("text").slice(lo, hi - lo)
                data, offsets = flat(column)
                digests = []
                for o, own in zip(offsets[:-1], chunks(column)):
                    whole = data[o:o + own[-1]].tobytes()
                    at = own.tolist()
                    digests += [hashlib.blake2b(whole[a:z], digest_size=16).digest()[:8] for a, z in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(digests), ">i8").astype(np.int64))], names=["hash"])

    return docs.select("text").mapInArrow(run, "hash long")


def _stretches(marked: DataFrame) -> DataFrame:
    """A row for each stretch of neighbouring repeated chunks, all later copies or all first ones.

    ``marked``: doc_id, text_key and marks, an array of (seq, first), where first is the place of the first copy, null
    for that itself. The stretch holds the chunks from lo to hi - 1; before and after are first of the first and the last.
    """
    def run(batches):
        for batch in batches:
            marks = batch.column("marks")
            inner = marks.flatten()
            if not len(inner):
                continue
            row = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
            seq, first = pc.struct_field(inner, "seq").to_numpy(zero_copy_only=False), pc.struct_field(inner, "first")
            order = np.lexsort((seq, row))
            row, seq, later = row[order], seq[order], first.is_valid().to_numpy(zero_copy_only=False)[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (seq[1:] != seq[:-1] + 1) | (later[1:] != later[:-1])])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(row)) - 1
            of = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(seq[begin], pa.int32()),
                                              pa.array(seq[end] + 1, pa.int32()), pa.array(later[begin]), first.take(pa.array(order[begin])),
                                              first.take(pa.array(order[end]))], names=["doc_id", "text_key", "lo", "hi", "later", "before", "after"])

    first = marked.schema["marks"].dataType.elementType["first"].dataType.simpleString()
    return marked.mapInArrow(run, extended(marked.select("doc_id", "text_key"), {"lo": "int", "hi": "int", "later": "boolean", "before": first, "after": first}))


def _surroundings(docs: DataFrame) -> DataFrame:
    """For texts with asks, an array of (seq, side): the bytes before (side 0) or after (1) the chunk seq, the next chunk and some more."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                row, seq, side, near = [], [], [], []
                for i, (o, own, asks) in enumerate(zip(offsets[:-1], chunks(part.column("text")), part.column("asks").to_pylist())):
                    whole = data[o:o + own[-1]].tobytes()
                    at = own.tolist()
                    for ask in asks:
                        s = ask["seq"]
                        row.append(i)
                        seq.append(s)
                        side.append(ask["side"])
                        near.append(whole[at[s + 1]:at[min(s + 2, len(at) - 1)] + AHEAD] if ask["side"] else whole[max(0, at[max(s - 1, 0)] - BEHIND):at[s]])
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("text_key").take(of), pa.array(seq, pa.int32()),
                                                  pa.array(side, pa.int32()), pa.array(near, pa.binary())], names=["doc_id", "text_key", "seq", "side", "near"])

    return docs.mapInArrow(run, extended(docs.select("doc_id", "text_key"), {"seq": "int", "side": "int", "near": "binary"}))


def _key():
    return F.xxhash64("doc_id", "text_key")


def _marks(leads: DataFrame) -> DataFrame:
    """doc_id, text_key and mark, a row for each of a text's marks: (lo, hi, later) of a stretch of repeated chunks, (lo, side, near) of its ends."""
    again = written(_chunk_hashes(leads).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "again")
    chunk = _chunk_rows(leads).withColumn("hash", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    twice = written(maybe_in(chunk, "hash", bitmap(again, "hash")).drop("hash"), "chunks")
    place = F.struct("doc_id", "text_key", "seq")
    repeated = twice.groupBy("digest").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least != most").select("digest", "least")
    mark = F.struct("seq", F.when(place != F.col("least"), F.col("least")).alias("first"))
    marked = twice.join(repeated, "digest").groupBy("doc_id", "text_key").agg(F.collect_set(mark).alias("marks"))
    runs = written(_stretches(marked), "stretches")
    later = runs.where("later")
    ends = (later.where("lo > 0 and before.seq > 0").select("doc_id", "text_key", "lo", F.lit(0).alias("side"), F.col("before").alias("first"))
            .unionByName(later.select("doc_id", "text_key", "lo", F.lit(1).alias("side"), F.col("after").alias("first"))))
    asked = written(ends.groupBy(F.col("first.doc_id").alias("f_id"), F.col("first.text_key").alias("f_key"))
                    .agg(F.collect_set(F.struct("first.seq", "side")).alias("asks")), "asked")
    texts = maybe_in(leads.withColumn("key", _key()), "key", bitmap(asked.select(F.xxhash64("f_id", "f_key").alias("key")), "key"))
    near = (_surroundings(texts.join(asked, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key"))).select("doc_id", "text_key", "text", "asks"))
            .dropDuplicates(["doc_id", "text_key", "seq", "side"])
            .select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key"), F.col("seq").alias("n_seq"), F.col("side").alias("n_side"), "near"))
    answered = ends.join(near, F.col("first.doc_id").eqNullSafe(F.col("n_id")) & (F.col("first.text_key") == F.col("n_key"))
                         & (F.col("first.seq") == F.col("n_seq")) & (F.col("side") == F.col("n_side")))
    none = {"hi": "int", "later": "boolean", "side": "int", "near": "binary"}
    def marks(rows):
        return rows.select("doc_id", "text_key", F.struct("lo", *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]).alias("mark"))
    return marks(runs.drop("before", "after")).unionByName(marks(answered.select("doc_id", "text_key", "lo", "side", "near")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and more) with repeated chunks taken out of text, and n_bytes, n_chunks, n_repeated, n_removed, n_spans.

    n_removed counts the bytes that went, in n_spans runs; n_repeated these and the bytes of first copies, in stretches of
    at least ``MIN_RUN``. A null text stays null and counts as empty. Rows equal in doc_id and text are one document and
    are treated alike. Columns with the names of the counts are replaced, all others stay whatever their names.
    """
    made = {"n_bytes": "long", "n_chunks": "long", "n_repeated": "long", "n_removed": "long", "n_spans": "long"}
    held = [c for c in docs.columns if c not in ("doc_id", "text") and c not in made]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)]) if held else F.lit(None).cast("int")
    rows = docs.select("doc_id", "text", packed.alias("held"), F.xxhash64("text").alias("text_key"))
    ids = F.struct("doc_id")
    equal = written(rows.groupBy(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("same"), "text_key")
                    .agg(F.min(ids).alias("least"), F.max(ids).alias("most")).select("text_key", "least.doc_id", (F.col("least") != F.col("most")).alias("copied")), "leads")
    leading = bitmap(equal.select(_key().alias("key")), "key")
    keyed = rows.withColumn("key", _key())
    leads = maybe_in(keyed.select("doc_id", "text_key", "text", "key"), "key", leading).select("doc_id", "text_key", "text")
    copied = equal.where("copied").select("doc_id", "text_key", F.lit(True).alias("copied"))
    found = written(_marks(leads).withColumn("copied", F.lit(False)).unionByName(copied, allowMissingColumns=True)
                    .groupBy("doc_id", "text_key").agg(F.max("copied").alias("copied"), F.collect_set("mark").alias("marks")), "found")
    known = maybe_in(maybe_in(keyed, "key", leading, keep=True).withColumnRenamed("__maybe", "lead"),
                     "key", bitmap(found.select(_key().alias("key")), "key"), keep=True)
    there = F.col("lead") & F.col("__maybe")
    there_found = known.where(there).join(found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "copied", "marks"),
                                          F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    wanted = ["doc_id", "text", "held", "lead", "copied", "marks"]
    rest = known.where(~there).withColumn("copied", F.lit(False)).withColumn("marks", F.lit(None).cast(found.schema["marks"].dataType))
    joined = there_found.select(*wanted).unionByName(rest.select(*wanted))
    names = ["doc_id", "text", "held"]

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                texts, counts = [], []
                for o, own, marks, lead, copied, valid in zip(offsets[:-1], chunks(part.column("text")), *(part.column(c).to_pylist() for c in ("marks", "lead", "copied")),
                                                              part.column("text").is_valid().to_pylist()):
                    text, count = _applied(data[o:o + own[-1]].tobytes(), own, marks or (), not lead, bool(copied))
                    texts.append(text.decode("utf-8") if valid else None)
                    counts.append(count)
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(made)))], names=[*names, *made])

    out = joined.mapInArrow(run, extended(joined.select(*names), made))
    place = {c: F.col("held")[f"c{i}"].alias(c) for i, c in enumerate(held)}
    return out.select(*[place.get(c, c) for c in docs.columns if c not in made], *made)


def _common(a: bytes, b: bytes) -> int:
    """How many bytes ``a`` and ``b`` begin with alike."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])


def _applied(whole: bytes, borders: np.ndarray, marks, copy: bool = False, copied: bool = False) -> tuple[bytes, tuple[int, ...]]:
    """The text without its later copies, and its counts.

    ``marks``: as of :func:`_marks`; ``copy``: the whole text is a later copy; ``copied``: it has one.
    """
    at, size = borders.tolist(), len(whole)
    n = len(at) - 1
    near = {(m["lo"], m["side"]): m["near"] for m in marks if m["side"] is not None}
    runs = sorted([m["lo"], m["hi"], m["later"]] for m in marks if m["side"] is None)
    gone = [[0, size]] if copy and size >= MIN_RUN else []
    for first, last, later in runs if not copy else ():
        if not later:
            continue
        a, z = at[first], at[last]
        before, after = near.get((first, 0), b""), near.get((first, 1), b"")
        lo, hi = a - _common(whole[max(0, a - len(before)):a][::-1], before[::-1]), z + _common(whole[z:z + len(after)], after)
        while lo < a and not (lo == 0 or SPACE[whole[lo - 1]]):
            lo += 1
        while hi > z and not (hi == size or SPACE[whole[hi]] or SPACE[whole[hi - 1]]):
            hi -= 1
        if hi - lo < MIN_RUN:
            continue
        if gone and lo <= gone[-1][1]:
            gone[-1][0], gone[-1][1] = min(lo, gone[-1][0]), max(hi, gone[-1][1])
        else:
            gone.append([lo, hi])
    kept, end = [], 0
    for lo, hi in gone:
        kept.append(whole[end:lo])
        end = hi
    kept.append(whole[end:])
    removed = sum(z - a for a, z in gone)
    return b"".join(kept), (size, n, size if copied and size >= MIN_RUN else _repeated(at, runs, gone), removed, len(gone))


def _repeated(at: list[int], runs, gone) -> int:
    """The bytes of ``gone`` and of stretches of repeated chunks of at least ``MIN_RUN``, each counted once."""
    whole = []
    for first, last, _ in runs:
        if whole and whole[-1][1] == at[first]:
            whole[-1][1] = at[last]
        else:
            whole.append([at[first], at[last]])
    total, end = 0, 0
    for a, z in sorted([s for s in whole if s[1] - s[0] >= MIN_RUN] + gone):
        total += max(0, z - max(a, end))
        end = max(end, z)
    return total
