"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, linededup, minhash, quality, sharding, substring, warc
from .common import scratch, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts compared with full licence texts, headers, notices and tags."""
    return licenses.scan(_as_files(spark, sf_dir), whole=True).drop("own_score")


def op2_license_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_license_scan, with lines that have a cue compared with one-sentence notices, which SQL can express."""
    return licenses.scan(_as_files(spark, sf_dir)).drop("own_score")


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/thousand/hundred/name. Every 25th is a LICENSE file, of which every 8th stands a directory
    higher, and every 40th two."""
    n = F.col("doc_id")
    at = lambda k: F.floor(n / k).cast("string")
    name = F.when(n % 25 == 0, "LICENSE").otherwise(F.concat(F.lit("f"), n.cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(n % 1000 != 0, at(1000)), F.when(n % 200 != 0, at(100)), name).alias("path"), "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted shards hold, with a digest of each text."""
    _, found = sharding.store_and_read(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return found.select("doc_id", "lang", "source", "n_chars", "arrival", F.sha2("text", 256).alias("text_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, and lines and pairs of lines of over 50 words."""
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """``ranks``: the path of a rank file; by default the public 50k vocabulary."""
    import public_tokenizers

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.encode_decode(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_at")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_license_scan, op2_license_scan_lines, op3_language_id, op4_quality_rules, op5_substring_dedup, op6_sharding, op7_line_dedup, op8_bpe_roundtrip, op9_decontaminate, op10_warc)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_license_scan_lines": rf"""
WITH d AS (SELECT doc_id, coalesce(source, 'none') || CASE WHEN doc_id % 1000 <> 0 THEN '/' || (doc_id // 1000) ELSE '' END || CASE WHEN doc_id % 200 <> 0 THEN '/' || (doc_id // 100) ELSE '' END AS dir, CASE WHEN doc_id % 25 = 0 THEN 'LICENSE' ELSE 'f' || doc_id || '.txt' END AS name, text FROM documents),
t AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all({_LOW.format('about')}, '[a-z0-9]+')) AS term FROM (VALUES {_TEMPLATES}) AS v(template, about)) GROUP BY ALL),
c AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all({_LOW.format('text')}, '[a-z0-9]+'))) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY term),
i AS (SELECT DISTINCT term, 1 + ln((1.0::double + (SELECT count(*) FROM d)) / (1 + coalesce(df, 0))) AS idf FROM t LEFT JOIN c USING (term)),
w AS (SELECT template, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM t JOIN i USING (term)),
l AS (SELECT doc_id, k, lines[k] AS line FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL)) WHERE regexp_matches(lines[k], '{licenses.CUE}')),
u AS (SELECT doc_id, k, term, count(*) * coalesce(any_value(idf), 1 + ln(1.0::double + (SELECT count(*) FROM d))) AS u FROM (SELECT doc_id, k, unnest(regexp_extract_all({_LOW.format('line')}, '[a-z0-9]+')) AS term FROM l) LEFT JOIN i USING (term) GROUP BY doc_id, k, term),
n AS (SELECT doc_id, k, sqrt(sum(u * u)) AS length FROM u GROUP BY doc_id, k),
s AS (SELECT doc_id, template, round(sum(u * w / norm) / any_value(length), 9) AS score FROM u JOIN w USING (term) JOIN n USING (doc_id, k) GROUP BY doc_id, k, template),
o AS (SELECT doc_id, template AS own, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS rn FROM s WHERE score >= {licenses.LEAST}) WHERE rn = 1),
g AS (SELECT dir, own AS given FROM (SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) AS rn FROM d JOIN o USING (doc_id) WHERE name = 'LICENSE') WHERE rn = 1),
a AS (SELECT dir, n, array_to_string(parts[1:n], '/') AS above FROM (SELECT dir, parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM d))),
b AS (SELECT dir, above, given FROM (SELECT a.dir, above, given, row_number() OVER (PARTITION BY a.dir ORDER BY n DESC) AS rn FROM a JOIN g ON g.dir = above) WHERE rn = 1)
SELECT doc_id, dir || '/' || name AS path, own AS own_licence, coalesce(own, given) AS licence, CASE WHEN own IS NULL THEN above END AS licence_from, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN b USING (dir)""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS pos, w FROM d WHERE len(w) > 8),
h AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos:pos + 7], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(pos, pos + 7)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, source, unnest(l) AS line FROM d),
k AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM x),
c AS (SELECT source, h FROM (SELECT source, h, count(DISTINCT doc_id) AS n FROM k GROUP BY ALL) JOIN (SELECT source, count(*) AS host FROM documents GROUP BY source) USING (source) WHERE n >= 10 AND n >= 0.005 * host),
m AS (SELECT doc_id, sum(chars) AS lost FROM k JOIN c USING (source, h) GROUP BY doc_id),
o AS (SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars AS kept, lost::bigint AS removed_chars FROM o""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
f AS (SELECT doc_id, item_id, n, pos FROM dw JOIN iw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM f) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages), q AS (SELECT *, strlen(t) AS n, sha256(t) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM q)
SELECT page_id, n::bigint AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url, true AS has_request, true AS has_metadata FROM r""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS pos, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY array_to_string(w[pos:pos + 34], ' ')) AS n FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(pos, pos + 34)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, w, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM r) AS y USING (doc_id, p) WHERE y.p IS NULL GROUP BY x.doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_sharding": "SELECT doc_id, lang, source, n_chars, coalesce(((doc_id % 16) + 16) % 16, 0)::bigint AS arrival, sha256(text) AS text_sha256 FROM documents",
    "op7_line_dedup": rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS solid FROM l),
s AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM f WHERE solid),
b AS (SELECT *, len(string_split(h, ' ')) AS n, lead(h) OVER o AS h1, lead(h, 2) OVER o AS h2, lead(len(string_split(h, ' '))) OVER o AS n1 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, pos, 3 AS size, h || chr(10) || h1 || chr(10) || h2 AS k FROM b WHERE h2 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, h || chr(10) || h1 FROM b WHERE n + n1 > {linededup.WORDS}
  UNION ALL SELECT doc_id, pos, 1, h FROM b WHERE n > {linededup.WORDS}),
q AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, pos) AS n FROM w),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + size - 1)) AS pos FROM q WHERE n > 1),
y AS (SELECT s.doc_id, s.i FROM s JOIN g USING (doc_id, pos)),
k AS (SELECT f.doc_id, string_agg(line, chr(10) ORDER BY f.i) AS kept FROM f LEFT JOIN y ON f.doc_id = y.doc_id AND f.i = y.i WHERE y.i IS NULL GROUP BY f.doc_id),
c AS (SELECT f.doc_id, count(*) FILTER (WHERE solid) AS n_lines, count(y.i) AS n_deleted FROM f LEFT JOIN y ON f.doc_id = y.doc_id AND f.i = y.i GROUP BY f.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_deleted, 0)::bigint AS n_deleted, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
