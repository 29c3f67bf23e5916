"""The queries of the text operators and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog.registry import table
from . import (
    chains, decontaminate, exact_copies, languages, near_duplicates, packing, periodic, personal_data, repeats, resample, shards, topk, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# The words of a text: A-Z lower-cased, ASCII letters and digits and everything outside ASCII.
_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (
  SELECT p.doc_id, p.i, p.n, x.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places) p JOIN windows x ON p.n = x.n AND p.g = x.g
),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_benchmark_decontamination", DECONTAMINATE_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
    )


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return shards.interleave(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_report(table(spark, folder, "documents"))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(low, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@query("op8_minhash_near_duplicates", NEAR_DUPLICATES_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(table(spark, folder, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::bigint AS score
  FROM parts a JOIN parts b USING (i) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""


@query("op3_exact_top_k", TOP_K_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def _page_text_sql(html: str) -> str:
    """The steps of warc.without_markup, characters and narrowed as SQL."""
    t = f"regexp_replace(regexp_replace({html}, '{warc.GONE}', ' ', 'g'), '{warc.LINE}', chr(10), 'g')"
    t = _characters_sql(f"regexp_replace({t}, '{warc.TAG}', '', 'g')")
    t = f"regexp_replace(regexp_replace({t}, '{warc.BLANK}', ' ', 'g'), '{warc.BREAK}', chr(10), 'g')"
    return f"trim({t}, ' ' || chr(10))"


def _characters_sql(text: str) -> str:
    for name, char in warc.NAMED.items():
        quoted = char.replace("'", "''")
        text = f"replace({text}, '&{name};', '{quoted}')"
    return f"replace({text}, '&amp;', '&')"


def _uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"{h}[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32))) + " || '>'"


_LINE_SQL = "chr(13) || chr(10)"
_TITLE_SQL = "trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '[ \\t\\r\\n\\f\\x0B\\x{A0}]+', ' ', 'g'))"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, target_uri, {_uuid_sql("'response ' || coalesce(page_id::varchar, '') || ' ' || target_uri")} AS refers_to,
    'sha256:' || sha256(html) AS source_digest, {_page_text_sql("html")} AS text, {_characters_sql(_TITLE_SQL)} AS title,
    lower(regexp_extract(html, '(?i)<html\\b[^>]*?\\blang\\s*=\\s*"?([A-Za-z0-9-]+)', 1)) AS lang,
    list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1), lambda u: {_characters_sql("u")}) AS links
  FROM p
),
m AS (
  SELECT page_id, target_uri, refers_to, source_digest, 'metadata' AS kind,
    'title: ' || title || {_LINE_SQL} || 'language: ' || lang || {_LINE_SQL} || 'characters: ' || length(text) || {_LINE_SQL} || 'links: ' || len(links)
    || {_LINE_SQL} || coalesce(array_to_string(list_transform(links, lambda u: 'outlink: ' || u || {_LINE_SQL}), ''), '')
    || 'source-Content-Type: text/html; charset=utf-8' || {_LINE_SQL} AS block
  FROM r
  UNION ALL SELECT page_id, target_uri, refers_to, source_digest, 'conversion', text FROM r
)
SELECT page_id, kind, {_uuid_sql("kind || ' ' || refers_to || ' ' || target_uri || ' 2024-01-01T00:00:00Z'")} AS record_id, refers_to, target_uri,
  octet_length(encode(block))::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest
FROM m
"""


@query("op5_warc_derivatives", WARC_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    responses = warc.page_responses(table(spark, folder, "pages"))
    return warc.derive(responses, carry=["page_id"]).select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_digest",
    )


SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 100] AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
first AS (SELECT g, min(doc_id) AS holder FROM grams GROUP BY g),
hits AS (SELECT doc_id, p FROM grams JOIN first USING (g) WHERE holder < doc_id),
steps AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hits),
runs AS (SELECT doc_id, p, sum((q IS NULL OR p > q + 50)::int) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM steps),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS before FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1:] AS left_over
  FROM d JOIN gaps USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_suffix_array_dedup", SUFFIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), bodies=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_substring_chains")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return chains.fuzzy_passages(table(spark, folder, "documents"))


# CRC-32 as SQL: the table of its bytes, and the checksum of a text.
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
)"""


def _crc32_sql(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


PERIODIC_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc32_sql("doc_id::varchar")} AS h FROM documents, crc),
e AS (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
r AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE w END AS w FROM f
),
grams AS (SELECT doc_id, n, i, w[i + 1:i + 6] AS s FROM (SELECT doc_id, n, w, unnest(range(n - 5)) AS i FROM r)),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
wide AS (SELECT doc_id, q, min(i) AS a, max(i) + 6 + q AS b FROM islands GROUP BY doc_id, q, k HAVING max(i) + 6 + q - min(i) >= greatest(12, 2 * q)),
runs AS (SELECT * FROM wide x WHERE NOT EXISTS (SELECT 1 FROM wide y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.a <= x.a AND y.b >= x.b)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || (b - a) || ',' || q || chr(10), '' ORDER BY a, q) AS lines,
    arg_min({{'a': a, 'n': b - a, 'q': q}}, (a - b, a, q)) AS best
  FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, b)) AS i FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best.a::bigint AS start, best.n::bigint AS length, best.q::bigint AS period,
  (1000 * best.n // best.q)::bigint AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM r LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of about one text in ten repeated, as a checksum of its doc_id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    n, g = F.size(w), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rest = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    body = F.array_join(F.slice(F.concat(F.slice(w, 1, a), rest), 1, n), " ")
    some = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(some, body).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", PERIODIC_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(_made_periodic(table(spark, folder, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


COPIES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""


@query("op12_exact_dedup", COPIES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies.exact_duplicates(spark, f"{folder}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


RESAMPLE_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
source AS (SELECT doc_id, unnest(w) AS word FROM d),
target AS (SELECT unnest({_WORDS}) AS word FROM benchmark WHERE text IS NOT NULL),
known AS (SELECT word, {_crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM source UNION SELECT word FROM target), crc),
s AS (SELECT bucket, count(*) AS s FROM source JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN known USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM source) AS n, (SELECT count(*) FROM target) AS m),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (n + 10000) / ((s + 1)::double * (m + 10000))))::bigint AS gain
  FROM s LEFT JOIN t USING (bucket), total
),
sums AS (SELECT doc_id, sum(gain)::bigint AS total, count(*) AS n FROM source JOIN known USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, len(w)::bigint AS n_features, coalesce(floor(total::double / n), 0)::bigint AS weight,
    ('0x' || sha256('2024:' || d.doc_id)[1:8])::bigint AS h
  FROM d LEFT JOIN sums USING (doc_id)
),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint AS score FROM weighed),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN (SELECT doc_id, rank FROM able WHERE rank <= drawn) a ON s.doc_id = a.doc_id
"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
