"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, KNOWN, SPELLINGS
from .sharding import ROUNDS


def sharding(shards: int, seed: int) -> str:
    """The same permutation: rounds as CTE columns, cycle walking by recursion, CRC-32 by its bitwise rule."""
    def half(i: int, v: str) -> str:
        return f"CAST('0x' || substr(md5('{seed}:{i}:' || CAST({v} AS VARCHAR)), 1, 15) AS BIGINT)"

    inner = "SELECT p % a_b.b AS r, p // a_b.b AS l, w.* FROM {src} w, a_b"
    for i in range(ROUNDS):
        if i % 2 == 0:
            inner = f"SELECT r, (l + {half(i, 'r')}) % a_b.a AS l, q.* EXCLUDE (r, l) FROM ({inner}) q, a_b"
        else:
            inner = f"SELECT (r + {half(i, 'l')}) % a_b.b AS r, l, q.* EXCLUDE (r, l) FROM ({inner}) q, a_b"
    once = f"SELECT row_number, l * a_b.b + r AS p FROM ({inner}) z, a_b"
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                          lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM range(256) t(i))),
rows0 AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
        lambda x, c: xor(x >> 8, bits.tab[CAST((xor(x, c) & 255) + 1 AS INT)])), 4294967295) AS text_crc32
  FROM documents, bits),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM rows0),
total AS (SELECT count(*) AS n FROM numbered),
a_n AS (SELECT n, CAST(greatest(1, ceil(sqrt(n))) AS BIGINT) AS a FROM total),
a_b AS (SELECT n, a, CAST(greatest(1, (n + a - 1) // a) AS BIGINT) AS b FROM a_n),
walk(row_number, p) AS (
  {once.format(src="(SELECT row_number, row_number AS p FROM numbered)")}
  UNION ALL
  {once.format(src="(SELECT row_number, p FROM walk, total WHERE p >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, CAST(p // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard, CAST(row_number AS BIGINT) AS row_number
FROM numbered JOIN walk USING (row_number), total WHERE p < n
"""


def decontamination(span: int = 10) -> str:
    """Every window of every item looked up at every place of every document, by its words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {words} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), {span}) AS k, w, unnest(range(len(w) - least(len(w), {span}) + 1)) AS s FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1:s + k], ' ') AS v FROM iw),
doc AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS w FROM documents),
place AS (SELECT rid, w, unnest(range(len(w))) AS s FROM doc),
hit AS (SELECT rid, s, win.k, item_id FROM place, (SELECT DISTINCT k FROM win) n, win
        WHERE s + n.k <= len(w) AND win.k = n.k AND win.v = array_to_string(w[s + 1:s + n.k], ' ')),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN cover USING (rid) LEFT JOIN ids USING (rid)
"""


def license_scan() -> str:
    """The same canonical form by DuckDB's functions, and joins by its digest."""
    def canonical(x: str) -> str:
        low = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        low = f"regexp_replace({low}, '(?m){COPYRIGHT_LINE}', ' ', 'g')"
        plain = f"trim(regexp_replace({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
        for said, meant in SPELLINGS:
            plain = f"replace({plain}, '{said}', '{meant}')"
        return f"sha256({plain})"

    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known AS (SELECT {canonical("t")} AS digest, min(i) AS license_id FROM (VALUES {known}) v(i, t) GROUP BY 1),
doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS said FROM doc),
hit AS (SELECT rid, license_id FROM line JOIN known ON {canonical("said")} = digest),
notice AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM hit GROUP BY rid)
SELECT doc_id, {canonical("text")} AS canonical_sha256, license_id, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM doc LEFT JOIN known ON {canonical("text")} = digest LEFT JOIN notice USING (rid)
"""


def filter_audit() -> str:
    """Failure flags by window and list functions, and every order of the five letters applied to their counts."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
m AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS f FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
letter AS (SELECT range AS i FROM range(1, 6)),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
cell AS (SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, range AS step, o[range] AS filter, n, good, toxic,
           f[o[range]] AS fails, len(list_filter(o[1:range - 1], lambda i: f[i])) AS earlier, len(list_filter(f, lambda b: b)) AS failed
         FROM x, orders, range(1, 6)),
step AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT fails AND earlier = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN fails AND earlier = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND earlier > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND earlier = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails AND earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM cell GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM step
"""


def url_filters(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """Every rule held against every URL, the longest that fits taken."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT rid, arg_max([r_host || r_path, r_verdict], length(r_host || r_path)) AS best FROM p, r
        WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], '{default}') AS verdict FROM p LEFT JOIN fit USING (rid)
"""


def resampling(buckets: int = 10000, seed: int = 7, percent: int = 25, min_words: int = 20) -> str:
    """Features listed one by one; CRC-32 of each distinct one by its bitwise rule."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                          lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM range(256) t(i))),
texts AS (SELECT row_number() OVER () AS rid, doc_id, true AS ours, {words} AS w, md5(coalesce(text, '')) AS text_key FROM documents
          UNION ALL SELECT -row_number() OVER (), NULL, false, {words}, '' FROM benchmark),
feature AS (SELECT rid, ours, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
counted AS (SELECT rid, ours, f, count(*) AS n FROM feature GROUP BY rid, ours, f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda x, c: xor(x >> 8, bits.tab[CAST((xor(x, c) & 255) + 1 AS INT)])), 4294967295) % {buckets} AS bucket
           FROM (SELECT DISTINCT f FROM counted), bits),
sums AS (SELECT bucket, sum(CASE WHEN ours THEN n ELSE 0 END) AS s, sum(CASE WHEN ours THEN 0 ELSE n END) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + {buckets} AS DOUBLE)
           / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {buckets} AS DOUBLE)))) AS BIGINT) AS g FROM sums, total),
mean AS (SELECT rid, sum(n) AS n, sum(n * g) AS total FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE ours GROUP BY rid),
scored AS (SELECT doc_id, text_key, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM texts LEFT JOIN mean USING (rid) WHERE ours),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {min_words} AND place <= {percent} * enough // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= {min_words} ORDER BY score DESC, doc_id NULLS LAST, text_key) AS place,
             count(*) FILTER (WHERE n_words >= {min_words}) OVER () AS enough FROM drawn)
"""
