"""Importance resampling towards a target distribution, on hashed words and word pairs.

Words are runs of bytes that are no delimiters, A-Z lower-cased. A dictionary of
distinct words, each bounded by a delimiter on both sides, is compiled into an
Aho-Corasick automaton; a word carries its CRC-32 and its length as payload. One
scan of a text emits the payloads of its words in order, and the CRC-32 of two
adjacent words joined by a space is composed from theirs: a CRC is linear, so that
of the first is advanced by the second's length and added. CRCs modulo
``BUCKETS`` are the features.

1. *Dictionary.* Words are counted over all rows; the most frequent, up to ``max_words`` of
   at most ``MAX_WORD`` bytes, make the dictionary. It only saves work: words that it
   lacks get the same payload from their own bytes, so no result depends on it.
2. *Counting.* Each task adds up the buckets of its rows; the sums have 10,000 rows.
3. *Scoring.* The gains of the buckets are averaged over each document's features.
4. *Drawing.* Gumbel noise from a hash of doc_id is added, and the highest scores are
   numbered by a range-partitioned sort.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, unused, written
from .sharding import numbered
from .wordspans import flat, parts

BUCKETS, SEED, MIN_WORDS, PERCENT = 10000, 7, 20, 25
#: The bound of the dictionary: 4 MB on the driver and in each task.
MAX_WORDS, MAX_WORD = 1 << 16, 64
#: Counts held by a task before they go to the shuffle.
HELD = 1 << 18
PIECE = 2 << 20

_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BYTES = bytes(32 if not _IS_WORD[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))  # delimiters are spaces, A-Z is a-z
_BREAK = b" \x00 "  # between texts: no word is next to another across it


def _advance_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a CRC becomes after more bytes, by each of its own four bytes: after 0 to 64 bytes, and after 2 ** k."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    short = [state]
    for _ in range(MAX_WORD):
        state = c[state & 255] ^ (state >> np.uint32(8))
        short.append(state)
    doubled = [short[1]]
    for _ in range(31):
        doubled.append(_looked_up(doubled[-1], doubled[-1]))
    return np.stack(short), np.stack(doubled)


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHORT, _DOUBLED = _advance_tables()


def advanced(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The share of ``crc`` in the CRC of its text followed by ``length`` more bytes."""
    near = np.minimum(length, MAX_WORD)
    out = _SHORT[near, 0, crc & 255] ^ _SHORT[near, 1, crc >> 8 & 255] ^ _SHORT[near, 2, crc >> 16 & 255] ^ _SHORT[near, 3, crc >> 24]
    rest = length - near
    for k in range(int(rest.max(initial=0)).bit_length()):
        more = np.flatnonzero(rest >> k & 1)
        out[more] = _looked_up(_DOUBLED[k], out[more])
    return out


@functools.lru_cache(maxsize=2)
def _compiled(words: bytes):
    """The automaton of space-joined words, and their payloads: CRC, CRC with a space after it, length."""
    import ahocorasick

    own = words.split()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(own):
        automaton.add_word(" " + w.decode("latin-1") + " ", i)
    if own:
        automaton.make_automaton()
    crc = np.fromiter((zlib.crc32(w) for w in own), np.uint32, len(own))
    return automaton, crc, np.fromiter((zlib.crc32(b" ", int(c)) for c in crc), np.uint32, len(own)), np.fromiter(map(len, own), np.int64, len(own))


def _bounded(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts with delimiters as spaces, breaks between them, and the n + 1 places where they begin."""
    data, offsets = flat(column)
    text = data[offsets[0]:offsets[-1]].tobytes().translate(_BYTES)
    cut = offsets - offsets[0]
    joined = b" " + _BREAK.join(text[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())) + _BREAK
    return joined, cut + np.arange(len(cut)) * len(_BREAK)


def scanned(column: pa.Array, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of all word pairs, by text, and for each text its number of words.

    The three arrays: bucket of each feature, the text it belongs to, and the words of each text.
    """
    automaton, crcs, spaced, lengths = _compiled(words)
    text, begin = _bounded(column)
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    np.greater(raw, 32, out=inside[:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the text begins with a space: starts and ends take turns
    start, end = edges[0::2], edges[1::2]
    crc, first = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
    known = np.zeros(len(start), bool)
    if len(crcs) and len(start):
        hits = np.array([x for hit in automaton.iter(text.decode("latin-1")) for x in hit], np.int64).reshape(-1, 2)
        ids = hits[:, 1]
        at = np.searchsorted(end, hits[:, 0])  # a hit ends at the space after its word
        crc[at], first[at], known[at] = crcs[ids], spaced[ids], True
    for i in np.flatnonzero(~known).tolist():
        crc[i] = own = zlib.crc32(text[start[i]:end[i]])
        first[i] = zlib.crc32(b" ", own)
    row = np.searchsorted(begin, start, "right") - 1
    together = np.flatnonzero(row[1:] == row[:-1])
    pair = advanced(first[together], (end - start)[together + 1]) ^ crc[together + 1]
    return (np.concatenate([crc, pair]) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([row, row[together]]), np.bincount(row, minlength=len(column))


def _texts(df: DataFrame) -> DataFrame:
    return df.select("text")


def dictionary(rows: DataFrame, max_words: int = MAX_WORDS) -> bytes:
    """Words of all texts, joined by spaces: those of at least the frequency (a power of 2 ** 0.25) that at most
    ``max_words`` words reach, so that the driver gets no more than these (4 MB)."""
    def run(batches):
        held: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for lo, hi in parts(batch.column("text"), PIECE):
                for w, n in Counter(_bounded(batch.column("text").slice(lo, hi - lo))[0].split()).items():
                    if len(w) <= MAX_WORD and w != b"\x00":
                        held[w] += n
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    counts = _texts(rows).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("level", F.floor(4 * F.log2("n")).cast("int")), "words")
    level, left = None, max_words
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("words")).collect(), reverse=True):  # 4 * 63 levels at most
        left -= r["words"]
        if left < 0:
            break
        level = r["level"]
    best = [] if level is None else counts.where(F.col("level") >= level).select("word").collect()
    return b" ".join(sorted(bytes(r["word"]) for r in best))


def bucket_counts(rows: DataFrame, words: bytes) -> np.ndarray:
    """The number of features of all texts in each bucket."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PIECE):
                total += np.bincount(scanned(batch.column("text").slice(lo, hi - lo), words)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in _texts(rows).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored 1000 * log of how much likelier it is in the target, both smoothed by one."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, words: bytes) -> DataFrame:
    """``docs`` (whole rows) with n_words, n_features and weight, the floored mean gain of its features (none: 0).

    A null or empty text has no words. Columns of these names are replaced; all others stay.
    """
    made = {"n_words": "long", "n_features": "long", "weight": "long"}
    keep = docs.drop(*made)
    schema, names = extended(keep, made), [*keep.columns, *made]

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PIECE):
                part = batch.slice(lo, hi - lo)
                bucket, row, n_words = scanned(part.column("text"), words)
                n = np.bincount(row, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                                                  pa.array(total // np.maximum(n, 1))], names=names)

    return keep.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the digest of seed and doc_id (null: as an empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
              max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without its text, with n_words, n_features, weight, score and rank (1, 2, 3 ... of the drawn, else null).

    Drawn are ``percent`` % (rounded down) of the documents with ``min_words`` words, those of the highest scores; ties
    go to the smaller doc_id, null last, then to the smaller text digest. Rows equal in all of these take each other's
    ranks. Null and empty texts have no words, are weighed 0 and never drawn; an empty table gives an empty
    result, an empty target gives the gains of no counts. Columns of the names above are replaced.
    """
    both = _texts(docs).unionByName(_texts(target))
    words = dictionary(both, max_words)
    gain = gains(bucket_counts(docs, words), bucket_counts(target, words))
    keep = docs.drop("n_words", "n_features", "weight", "score", "rank")
    down, none, key = (unused(keep, n) for n in ("down", "none", "key"))
    scored = (weighted(keep, gain, words).withColumn(key, F.md5(F.coalesce("text", F.lit("")))).drop("text")
              .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
              .withColumns({down: -F.col("score"), none: F.col("doc_id").isNull()}))
    rows = written(scored, "scored")
    enough = F.col("n_words") >= min_words
    ordered, n = numbered(rows.where(enough), [down, none, "doc_id", key])
    rank = F.when(F.col("row_number") < n * percent // 100, F.col("row_number") + 1)
    out = (ordered.withColumn("rank", rank.cast("long")).drop("row_number")
           .unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))))
    return out.drop(down, none, key)
