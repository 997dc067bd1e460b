"""Quality rules: counted base rules, and a calibrated hashed n-gram logistic regression.

Features of a text: hashed words, hashed word pairs and hashed byte 4-grams, each
kind as shares of its own total, so that length doesn't matter. The model is fitted
by full-batch gradient descent (Adam) on labelled rows, its margin calibrated to a
probability by Platt's method on a part kept from the fit, and scored against a
fixed threshold. Scoring is a sum of table look-ups, by Arrow batch, map only.

Sample bound: the ``max_labelled`` labelled rows with the least hash of doc_id are
fitted on; all documents are scored, on whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended
from .wordspans import SPACE, as_is, flat, grams, parts, released, scrambled, sums, words_of

#: Features of each of the three kinds.
BITS = 14
MAX_LABELLED = 4000
THRESHOLD = 0.5
#: Bytes of text whose words, lines and n-grams are in arrays at a time (about a hundred times as many bytes).
PART = 1 << 18
#: Entries of the training sample that the driver multiplies at a time.
BLOCK = 1 << 19
MIN_WORDS, REPEAT_SPAN, REPEAT_PERCENT = 20, 8, 30
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_SPACES = b" \t\n\x0b\x0c\r"


@dataclass
class Model:
    weights: np.ndarray  # 3 << BITS
    bias: float
    slope: float  # Platt: probability = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float


def _kinds(data, offsets, words):
    """For each kind of feature: bucket numbers (from 0 in each kind) and the n + 1 borders of the texts."""
    low = np.uint64((1 << BITS) - 1)
    yield (words.hash & low).astype(np.int64), words.first
    pair, inside = grams(words, 2)
    row = words.row[inside]
    yield (pair[inside] & low).astype(np.int64), np.searchsorted(row, np.arange(len(words.first)))
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = data[lo:hi]
    if hi - lo >= 4:
        four = text[:-3].astype(np.uint32) | text[1:-2].astype(np.uint32) << np.uint32(8) | text[2:-1].astype(np.uint32) << np.uint32(16) \
            | text[3:].astype(np.uint32) << np.uint32(24)
        bucket = (four * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
        begin = offsets[:-1] - lo
        ends = np.maximum(begin, offsets[1:] - lo - 3)
        inside = np.zeros(len(bucket) + 1, np.int8)
        full = ends > begin
        np.add.at(inside, begin[full], 1)
        np.add.at(inside, ends[full], -1)
        mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
        counts = np.where(full, ends - begin, 0)
        yield bucket[mask], np.concatenate([[0], np.cumsum(counts)])
    else:
        yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)


def margins(model: Model, data, offsets, words) -> np.ndarray:
    out = np.full(len(offsets) - 1, model.bias)
    for k, (bucket, first) in enumerate(_kinds(data, offsets, words)):
        total = sums(model.weights[k << BITS:(k + 1) << BITS][bucket], first, np.float64)
        out += total / np.maximum(np.diff(first), 1)
    return out


def _base(data, offsets, words) -> dict[str, np.ndarray]:
    lo = int(offsets[0])
    text, first = data[lo:int(offsets[-1])], offsets - lo
    counts = {"n_words": np.diff(words.first)}
    counts["word_chars"] = sums((~SPACE[text] & ((text & 0xC0) != 0x80)).view(np.int8), first)
    counts["n_symbols"] = sums(_SYMBOL[text].view(np.int8), first)
    lines = sums((text == 10).view(np.int8), first)
    repeats = np.zeros(len(lines), np.int64)
    for i in np.flatnonzero(lines):
        seen = [x for x in text[first[i]:first[i + 1]].tobytes().split(b"\n") if x.strip(_SPACES)]
        repeats[i] = len(seen) - len(set(seen))
    counts["n_dup_lines"] = repeats
    gram, inside = grams(words, REPEAT_SPAN)
    key = scrambled(gram + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key[inside])
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    edges = np.zeros(len(key) + REPEAT_SPAN + 1, np.int64)
    if len(again):
        at = np.flatnonzero(inside & np.isin(key, again))
        edges[at] += 1
        edges[at + REPEAT_SPAN] -= 1
    counts["n_repeat_words"] = sums((np.cumsum(edges)[:len(key)] > 0).view(np.int8), words.first)
    return counts


def _features(rows: DataFrame) -> DataFrame:
    """(quality, buckets, shares) of labelled texts: sparse, for the bounded sample only."""
    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                words = words_of(data, offsets, as_is())
                kinds = list(_kinds(data, offsets, words))
                out = []
                for i in range(hi - lo):
                    at, share = [], []
                    for k, (bucket, first) in enumerate(kinds):
                        own, n = np.unique(bucket[first[i]:first[i + 1]], return_counts=True)
                        at.append(own + (k << BITS))
                        share.append(n / max(1, first[i + 1] - first[i]))
                    out.append((np.concatenate(at).astype(np.int32).tobytes(), np.concatenate(share).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())],
                                                 names=["quality", "at", "share"])
    return rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "quality int, at binary, share binary")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = 150, l2: float = 1e-7) -> Model:
    """Fit on the ``max_labelled`` labelled rows (quality 0 or 1) of least hash of doc_id that have a text.

    Without rows of both kinds the model keeps everything.
    """
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    got, rows = [], _features(rows).collect()
    while rows:
        r = rows.pop()
        got.append((bytes(r["at"]), bytes(r["share"]), r["quality"]))
    got.sort()
    y = np.array([q for _, _, q in got], float)
    if len(set(y)) < 2:
        return Model(np.zeros(3 << BITS), 0.0, 0.0, 10.0)
    at = [np.frombuffer(a, np.int32) for a, _, _ in got]
    share = [np.frombuffer(b, np.float32) for _, b, _ in got]
    fold = np.arange(len(y)) % 5 == 0  # for calibration; the order is by content, not by label

    def stacked(which):
        ids = np.flatnonzero(which)
        return np.concatenate([at[i] for i in ids]), np.concatenate([share[i] for i in ids]), np.cumsum([0, *(len(at[i]) for i in ids)]), y[ids]

    last = stacked(fold)
    col, val, first, target = stacked(~fold)
    del got, at, share  # the driver holds the sample once
    released()
    each = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))  # the kinds weigh alike
    w, b = np.zeros(3 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        margin = _sums_by_text(w, col, val, first) + b
        err = (1 / (1 + np.exp(-margin)) - target) * each
        g, gb = _sums_by_feature(err, col, val, first, len(w)) + l2 * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.5 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-9)
    col, val, first, target = last
    margin = _sums_by_text(w, col, val, first) + b
    slope, shift = _platt(margin, target)
    return Model(w, b, slope, shift)


def _blocks(first: np.ndarray):
    """Ranges (of texts, of entries) with about ``BLOCK`` entries each."""
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + BLOCK, "right")) - 1)
        yield slice(lo, hi), slice(int(first[lo]), int(first[hi]))
        lo = hi


def _sums_by_text(w: np.ndarray, col: np.ndarray, val: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the sum of val * w[col] over its entries, in their order; first: its first entry."""
    out = np.zeros(len(first) - 1)
    for texts, own in _blocks(first):
        n = texts.stop - texts.start
        out[texts] = np.bincount(np.repeat(np.arange(n), np.diff(first[texts.start:texts.stop + 1])), val[own] * w[col[own]], n)
    return out


def _sums_by_feature(err: np.ndarray, col: np.ndarray, val: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each feature the sum of val * err of the text, added up in the order of the entries whatever the blocks."""
    out = np.zeros(size)
    for texts, own in _blocks(first):
        each = np.repeat(err[texts], np.diff(first[texts.start:texts.stop + 1]))
        out = np.bincount(np.concatenate([np.arange(size), col[own]]), np.concatenate([out, val[own] * each]), size)
    return out


def _platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Newton's method on Platt's smoothed targets."""
    up, down = (target == 1).sum(), (target == 0).sum()
    if not up or not down:
        return 1.0, 0.0
    goal = np.where(target == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (ab - [1, 0]))
        ab -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (whole rows) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    A null or empty text has no words and fails the base rules. Equality of lines is by bytes, of windows by 64-bit
    hash. Columns of the names above are replaced; row order and everything else stay.
    """
    made = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
            "base_failed": "boolean", "probability": "double", "kept": "boolean"}
    keep = docs.drop(*made)
    schema, names = extended(keep, made), [*keep.columns, *made]

    def run(batches):
        for batch in batches:
            for lo, hi in parts(batch.column("text"), PART):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part.column("text"))
                words = words_of(data, offsets, as_is())
                base = _base(data, offsets, words)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                p = 1 / (1 + np.exp(-np.clip(model.slope * margins(model, data, offsets, words) + model.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(base[c].astype(np.int64)) for c in list(made)[:5]),
                                                  pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                                                 names=names)

    return keep.mapInArrow(run, schema)
