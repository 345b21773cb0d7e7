"""The registered queries opN_<name>, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, packing, quality, sharding, simhash, substring_dedup, token_counts, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, as read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on over 5 % of their source's documents, and on ten at least."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary(), 4096, 1, {"ids_crc32": F.crc32("ids")}, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words that lie in 10-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits that follow from its own text: a
    replacement, an insertion and a removal at hashed places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long"))
    edit = lambda at, removed, put: F.struct(at.alias("at"), removed.cast("long").alias("removed"), put.alias("put"))
    edits = F.array(
        edit(place(1), F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(40)), F.lit("an edit, newly written ")),
        edit(place(3), F.lit(0), F.substring("text", 1, 25)),
        edit(place(4), F.lit(12), F.lit("")),
    )
    return token_counts.counted(docs.withColumn("edits", edits), vocabulary()).select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), F.length("text").cast("long").alias("n_chars"), "n_encoded")


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards by bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    return sharding.shard(docs, 8, size).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, repetition and the verdict for every document."""
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f.name for f in quality.FIELDS))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings of documents before it."""
    left = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.SITE_RULES + url_filter.PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest doc_id that links of 4 bits reach."""
    found = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits,
        op2_line_dedup,
        op3_best_fit_packing,
        op4_decontaminate,
        op5_edit_counts,
        op6_bounded_ring,
        op7_quality_rules,
        op8_suffix_dedup,
        op9_url_filter,
        op10_simhash,
    )
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BAD_NAMES = "|".join([*url_filter.BAD_WORDS, *(f"({'|'.join(a)})-?({'|'.join(b)})" for nouns, others in url_filter.FAMILIES for a, b in ((nouns, others), (others, nouns)))])

ORACLES = {
    "op4_decontaminate": f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents), iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, lens.n AS n, unnest(range(1, len(w) - lens.n + 2)) AS i FROM dw, lens WHERE len(w) >= lens.n)),
hit AS (SELECT d.doc_id, win.item, d.i, d.n FROM dwin d JOIN win ON win.n = d.n AND win.s = d.s),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
""",
    "op1_warc_revisits": r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p JOIN m ON m.payload_digest = p.payload_digest
""",
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), f AS (SELECT *, trim(line) <> '' AS filled FROM l),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM f WHERE filled GROUP BY source, line) c
  JOIN totals t ON t.source = c.source WHERE c.n >= 10 AND c.n > 0.05 * t.pages
), j AS (
  SELECT f.*, b.line IS NOT NULL AS hit FROM f LEFT JOIN boiler b ON b.source = f.source AND b.line = f.line AND f.filled
)
SELECT doc_id, any_value(source) AS source, CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text
FROM j GROUP BY doc_id
""",
    "op9_url_filter": r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), s AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[.\-])(BAD_NAMES)([.\-]|/|$)') OR regexp_matches(host || path, '/(wp-login|xmlrpc)\.php$') OR regexp_matches(host || path, '/cgi-bin/.*\.cgi$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM s
""".replace("BAD_NAMES", BAD_NAMES),
}
