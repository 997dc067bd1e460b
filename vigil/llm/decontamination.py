"""Benchmark decontamination by winnowing.

A *window* is ``span`` consecutive words of a benchmark item (an item with fewer
words, but not none, is one shorter window). Both sides are fingerprinted: with
k-grams of ``k`` words (3 for windows of 10), ``span - k + 1`` consecutive k-grams lie in a window, and
the one with the least hash (the last of equals) is kept. Equal windows keep the
k-gram at the same place, so joining fingerprints and comparing the words around
each hit finds every shared window and no other.

Native Spark throughout. Documents are cut into overlapping blocks of words, so
the work of a row is bounded by the block; only matched fingerprints leave the
scan. Hits are kept by digest of the text, so copies share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
#: Window starts in a block; with the overlap below 2 ** POS_BITS words.
BLOCK, POS_BITS = 1024, 11
#: Fingerprint tables up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
_LOW = (1 << POS_BITS) - 1


def words_of(text: Column) -> Column:
    """The words of a text (null: none), A-Z in lower case."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, although lambdas refer to it again and again."""
    return F.get(F.transform(F.array(value), use), 0)


def fingerprints(words: Column, span: int) -> Column:
    """Winnowed fingerprints of a block of at least ``span`` words: one long per change of the window minimum.

    The high bits hold the hash, the low ones ``_LOW - place``, so that of equal hashes the last is least.
    """
    width = 1 << max(span - 2, 1).bit_length() - 1  # neighbouring k-grams: a power of two, so that minima come by doubling
    k = span - width + 1

    def grams(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
                           .bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - i).cast("bigint")))

    def minima(g):
        low, step = g, 1
        while step < width:
            low, step = _with_later(low, step), 2 * step
        return let(low, lambda m: F.slice(m, 1, F.size(m) - (width - 1)))

    def _with_later(values, step):
        return let(values, lambda v: F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda x, y: F.least(x, y)))

    # the place of the minimum never goes back, so each change of it is one distinct value
    return let(words, lambda w: F.when(F.size(w) >= span, let(grams(w), lambda g: F.array_distinct(minima(g)))))


def _fingerprinted(df: DataFrame, words: str, span: int) -> DataFrame:
    return df.where(F.size(words) >= span).withColumn("__mins", fingerprints(F.col(words), span))


def _unpacked(df: DataFrame) -> DataFrame:
    return (df.withColumn("fp", F.col("__m").bitwiseAND(F.lit(~_LOW)))
            .withColumn("place", (F.lit(_LOW) - F.col("__m").bitwiseAND(F.lit(_LOW))).cast("int")).drop("__m"))


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct (item_id, window) of the benchmark: columns item_id, words, window (digest), span."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                     words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("span", F.least(F.size("w"), F.lit(span)))
    cut = F.explode(let(F.col("w"), lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - F.least(F.size(w), F.lit(span))),
        lambda s: F.slice(w, s + 1, F.least(F.size(w), F.lit(span))))))
    return (w.select("item_id", "span", cut.alias("words"))
            .withColumn("window", F.md5(F.concat_ws(" ", "words"))).distinct())


def find_windows(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Every occurrence of a benchmark window: text_key, start (word number from 0), span, window, item_id.

    ``docs`` needs ``text``; ``items`` needs ``item_id`` and ``text``. ``text_key`` is the MD5 of the text, so equal
    texts have their hits once. Null and empty texts have no words and no hits; a null item_id reads ``null``; an
    empty table on either side gives no rows; other columns are ignored.
    """
    windows = written(item_windows(items, span), "windows")
    size = windows.select(F.sum(F.length(F.concat_ws(" ", "words")) + 64 + 24 * F.size("words")).alias("b")).first()["b"]
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most `span` of them
    small = (size or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    def cut(w):
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(BLOCK)),
                                                 lambda s: F.slice(w, s + 1, BLOCK + span - 1)))

    blocks = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
                         F.posexplode(let(words_of(F.col("text")), cut)).alias("block", "bw"))
    out = None
    for n in spans:
        known = (_unpacked(_fingerprinted(windows.where(F.col("span") == n).select("words", "window").distinct(), "words", n)
                           .select("words", "window", F.element_at("__mins", 1).alias("__m")))
                 .withColumnRenamed("place", "off"))
        seen = _unpacked(_fingerprinted(blocks, "bw", n).select("text_key", "block", "bw", F.explode("__mins").alias("__m")))
        at = F.col("place") - F.col("off")
        hit = (seen.join(hint(known), "fp").where((at >= 0) & (at < BLOCK) & (at + n <= F.size("bw")))
               .where(F.slice("bw", F.greatest(at, F.lit(0)) + 1, n) == F.col("words"))
               .select("text_key", (F.col("block").cast("bigint") * BLOCK + at).alias("start"), F.lit(n).alias("span"), "window"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return docs.sparkSession.createDataFrame([], "text_key string, start bigint, span int, window string, item_id string")
    hits = out.distinct()
    return hits.join(hint(windows.select("window", "item_id")), "window").select("text_key", "start", "span", "window", "item_id")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (columns of these names are replaced).

    n_hit counts the words inside any occurrence of a benchmark window; items_sha256 is the digest of the
    comma-joined sorted ids of the items that have one.
    """
    hits = written(find_windows(docs, items, span), "hits")
    key, hit, own = (unused(docs, name) for name in ("__key", "__hit", "__ids"))
    covered = (hits.select("text_key", "start", "span").distinct()
               .select("text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)).alias("at"))
               .distinct().groupBy("text_key").agg(F.count("*").alias(hit)))
    ids = (hits.select("text_key", "item_id").distinct().groupBy("text_key")
           .agg(F.sort_array(F.collect_list("item_id")).alias(own)))
    found = covered.join(ids, "text_key").withColumnRenamed("text_key", key)
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = docs.drop(*made).withColumns({
        key: F.md5(F.coalesce("text", F.lit(""))),
        "n_words": F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), "")).cast("bigint")})
    ids = F.coalesce(own, F.array().cast("array<string>"))
    return (rows.join(found, key, "left").withColumns({
        "n_hit": F.coalesce(hit, F.lit(0)).cast("bigint"), "n_items": F.size(ids).cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", ids), 256), "contaminated": F.col(hit).isNotNull()})
        .drop(key, hit, own))
