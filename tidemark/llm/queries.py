"""Queries op1 to op13 over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._common import table
from tidemark.llm.audit import audit_filters
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_join import near_duplicates
from tidemark.llm.pieces import summarise
from tidemark.llm.pii import find_personal_data
from tidemark.llm.quality import quality_report
from tidemark.llm.recompress import remove_repeats
from tidemark.llm.sharding import shard_records
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.suffixes import remove_repeated_bytes
from tidemark.llm.urlfilter import filter_urls
from tidemark.llm.warc import archive_pages


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_personal_data": op2_personal_data,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filters": op10_url_filters,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
""",
    "op5_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS rn, source_size * 2e0 AS cap, sum(source_size) OVER () * 1.5e0 AS pool
  FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, rn) AS place,
    (pool - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
    coalesce(least(cap, (SELECT arg_min(level, place) FROM r WHERE level * w < cap) * w), cap) AS target
  FROM r),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE
    (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - ahead)) END AS taken
FROM p
""",
    "op6_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT row_number() OVER () AS r, doc_id, words, CAST(len(words) AS BIGINT) AS n_words FROM d),
x AS (SELECT r, unnest(range(1, n_words - 33)) AS pos FROM w WHERE n_words >= 35),
y AS (SELECT x.r, x.pos, sha256(array_to_string(w.words[x.pos : x.pos + 34], ' ')) AS h FROM x JOIN w USING (r)),
z AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY h) AS c FROM y) WHERE c > 1),
g AS (SELECT DISTINCT r, unnest(range(pos, pos + 35)) AS place FROM z),
p AS (SELECT r, unnest(words) AS word, unnest(range(1, n_words + 1)) AS place FROM w),
k AS (
  SELECT p.r, string_agg(word, ' ' ORDER BY p.place) AS kept, count(*) AS n_kept
  FROM p LEFT JOIN g ON p.r = g.r AND p.place = g.place WHERE g.r IS NULL GROUP BY p.r)
SELECT doc_id, n_words, n_words - CAST(coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
x AS (
  SELECT a.f || b.f || c.f || e.f || g.f AS filter_order, [a.i, b.i, c.i, e.i, g.i] AS places
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i) a,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i) b,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i) c,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i) e,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i) g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT filter_order, places, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM x),
m AS (
  SELECT part, good, toxic, fails, count(*) AS docs FROM f GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, places[step] AS filter, good, toxic, docs,
    fails[places[step]] AS fails_here,
    len(list_filter(places[1 : step - 1], lambda p: fails[p])) > 0 AS gone,
    len(list_filter(fails, lambda v: v)) AS n_fails
  FROM m, s),
c AS (
  SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(docs) FILTER (NOT gone AND NOT fails_here), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(docs) FILTER (NOT gone AND fails_here), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(docs) FILTER (gone AND fails_here), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(docs) FILTER (fails_here AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(docs) FILTER (NOT gone AND fails_here AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(docs) FILTER (NOT gone AND fails_here AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM c
""",
}
