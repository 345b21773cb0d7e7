"""The registered queries of the engine's own operators, and their SQL.

The tables hold no documents of the layouts that the parser knows, so operators run on columns where
they have an effect, or on markup that the query derives from a table; the SQL derives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import normalize
from pagewright.functions import text as tx
from pagewright.operators import fold, html_tokens, notes, segment, validate
from pagewright.plans import anonymise, overrides, parse
from pagewright.sources import corpus, html_files, typst

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line of every document's lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


LINES = "(SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


# ---- sources and structure ----


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_paragraphs FROM pages")
def paragraph_count_per_page(spark, sf_dir):
    """Tokenise every page and count its paragraphs."""
    found = html_tokens.tokens(table(spark, sf_dir, "pages"), "page_id", container_class=None, container_tag="article", reopen=False)
    return found.groupBy("page_id").agg(F.count("pos").alias("n_paragraphs"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def anchor_hrefs(spark, sf_dir):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", hrefs.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading, CAST(strpos(html, '<article>') AS INTEGER) AS body_at FROM pages")
def first_heading_and_body(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("heading"), F.instr("html", "<article>").alias("body_at"))


@query("SELECT page_id, url AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    """The canonical link of pages that carry their own url in one form or another."""
    k = F.col("page_id") % 3
    head = F.when(k == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).when(k == 1, F.concat(F.lit('<LINK href="'), "url", F.lit('" rel="canonical">'))).otherwise(F.concat(F.lit('<meta property="og:url" content="'), "url", F.lit('">')))
    return table(spark, sf_dir, "pages").select("page_id", tx.source_url(F.concat(head, "html")).alias("canonical"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1) AS last FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(last, '\.html$', ''), '\.htm$', '') AS stem FROM p)
SELECT page_id, stem AS slug FROM s
""")
def url_stem(spark, sf_dir):
    return html_files.slugs(table(spark, sf_dir, "pages")).select("page_id", "slug")


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, host FROM h WHERE NOT (regexp_matches(host, '^m\.') AND regexp_matches(host, 'net$'))
""")
def robots_filter(spark, sf_dir):
    """Pages of hosts that don't forbid; only .net hosts have answered."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    robots = urls.where(F.col("host").endswith("net")).select("host").distinct().withColumn("allowed", ~F.startswith("host", F.lit("m.")))
    return html_files.allowed(urls, robots).select("page_id", "host")


@query("SELECT c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'input ' || c_name ELSE 'fixture ' || c_name END AS html FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def source_precedence(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), "c_name")
    first = rows.where("slug % 2 = 0").select("slug", F.concat(F.lit("input "), "c_name").alias("html"))
    second = rows.where("slug % 3 = 0").select("slug", F.concat(F.lit("fixture "), "c_name").alias("html"))
    return html_files.preferred(first, second)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def no_clobber(spark, sf_dir):
    """Outputs that aren't there yet."""
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("corpus/"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "p_name")
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("corpus/"), F.col("l_partkey").cast("string")).alias("path"))
    return corpus.new_only(wanted, there).drop("path")


@query(f"SELECT doc_id, pos, line FROM {LINES}")
def line_blocks(spark, sf_dir):
    return lines(spark, sf_dir)


# ---- segmentation ----


@query("""
WITH n AS (SELECT l_orderkey, CAST(l_linenumber % 3 AS INTEGER) AS c, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, c AS body FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, c) AS r FROM n) WHERE r = 1
""")
def top_container(spark, sf_dir):
    """The container with most rows, the first of equals."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array((F.col("l_linenumber") % 3).cast("int")).alias("containers"))
    return segment.body_containers(rows, "l_orderkey")


def line_tokens(spark, sf_dir) -> DataFrame:
    """Lines as tokens: some numbered, some note definitions, some blank."""
    text = F.when(F.col("pos") % 5 == 3, F.concat((F.col("pos") + 1).cast("string"), F.lit(". Text"))).when(F.col("pos") % 7 == 2, "").when(F.col("pos") % 9 == 7, "Given in Rome").otherwise(F.concat(F.lit("line "), F.col("pos").cast("string")))
    names = F.when(F.col("pos") >= 20, F.array(F.concat(F.lit("_ftn"), F.col("pos").cast("string")))).otherwise(F.array(F.lit("_ftnref1")))
    return lines(spark, sf_dir).select("doc_id", "pos", F.array(F.lit(0)).alias("containers"), F.lit(0).alias("parent_container"), F.lit("").alias("css_class"), text.alias("text_stripped"), names.alias("anchor_names"))


LINE_TOKENS = f"(SELECT doc_id, pos, CASE WHEN pos % 5 = 3 THEN CAST(pos + 1 AS VARCHAR) || '. Text' WHEN pos % 7 = 2 THEN '' WHEN pos % 9 = 7 THEN 'Given in Rome' ELSE 'line ' || CAST(pos AS VARCHAR) END AS t FROM {LINES})"


@query(f"SELECT doc_id, CAST(count(*) FILTER (WHERE pos < 20) AS BIGINT) AS n_body, CAST(count(*) FILTER (WHERE pos >= 20) AS BIGINT) AS n_notes, CAST(min(pos) FILTER (WHERE t <> '') AS INTEGER) AS title_pos FROM {LINE_TOKENS} GROUP BY doc_id")
def body_footnote_split(spark, sf_dir):
    rows = segment.split(line_tokens(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id").agg(F.count_if("is_body").alias("n_body"), F.count_if("is_note").alias("n_notes"), F.max("title_pos").alias("title_pos"))


@query(f"""
WITH t AS (SELECT * FROM {LINE_TOKENS} WHERE pos < 20), n AS (SELECT doc_id, min(pos) FILTER (WHERE t LIKE '%. Text') AS fn FROM t GROUP BY doc_id),
s AS (SELECT t.doc_id, any_value(fn) AS fn, max(pos) FILTER (WHERE t <> '' AND pos < fn) AS above FROM t JOIN n USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, CAST(coalesce(above, fn) AS INTEGER) AS start FROM s
""")
def contents_drop(spark, sf_dir):
    """Where the body starts once a table of contents is gone."""
    rows = segment.split(line_tokens(spark, sf_dir), "doc_id").withColumn("in_body", F.col("is_body"))
    return segment.drop_contents(rows, "doc_id").groupBy("doc_id").agg(F.max("start").alias("start"))


@query(f"SELECT doc_id, max(pos) FILTER (WHERE t LIKE 'Given in%') AS dateline FROM {LINE_TOKENS} GROUP BY doc_id")
def last_match(spark, sf_dir):
    rows = line_tokens(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.max(F.when(segment.is_dateline(F.col("text_stripped")), F.col("pos"))).alias("dateline"))


# ---- the fold ----

KIND = "CASE CAST(pos % 11 AS INTEGER) WHEN 0 THEN 'preamble' WHEN 1 THEN 'head' WHEN 4 THEN 'roman' WHEN 5 THEN 'headnum' WHEN 7 THEN 'head' WHEN 3 THEN 'num' ELSE 'prose' END"


@query(f"""
WITH r AS (SELECT doc_id, pos, {KIND} AS kind, 'Heading ' || CAST(pos AS VARCHAR) AS heading FROM {LINES}),
b AS (SELECT *, kind IN ('preamble', 'num', 'prose') AS boundary FROM r),
p AS (SELECT *, NOT boundary AND coalesce(last_value(CASE WHEN boundary THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'preamble', FALSE) AS pending,
  sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
t AS (SELECT doc_id, island, string_agg(heading, ' ' ORDER BY pos) FILTER (WHERE pending) AS title FROM p GROUP BY doc_id, island),
e AS (SELECT p.*, CASE WHEN kind = 'preamble' THEN concat_ws(' ', 'IV.', title) WHEN kind = 'roman' AND NOT pending THEN 'II. Part' END AS ch FROM p JOIN t USING (doc_id, island)),
f AS (SELECT *, CASE WHEN ch IS NOT NULL THEN '-' WHEN kind = 'head' AND NOT pending THEN '+' || heading WHEN kind = 'headnum' AND NOT pending THEN '+' || heading END AS se,
  CASE WHEN kind IN ('num', 'prose') THEN -1 WHEN kind = 'headnum' AND NOT pending THEN pos END AS nu FROM e),
g AS (SELECT doc_id, pos, kind, last_value(ch IGNORE NULLS) OVER w AS chapter, last_value(se IGNORE NULLS) OVER w AS se,
  last_value(nu IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nu FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, pos, CAST(CASE WHEN kind = 'num' THEN pos WHEN nu >= 0 THEN nu END AS INTEGER) AS number, chapter, CASE WHEN se[1] = '+' THEN se[2:] END AS section FROM g WHERE kind IN ('num', 'prose')
""")
def body_fold(spark, sf_dir):
    """Chapters, sections and numbers carried over lines whose kinds follow from their places."""
    rows = lines(spark, sf_dir).withColumns(
        {
            "kind": F.expr(KIND.replace("INTEGER", "INT")),
            "heading": F.concat(F.lit("Heading "), F.col("pos").cast("string")),
            "numeral": F.lit("IV"),
            "roman_title": F.lit("II. Part"),
            "head_number": F.col("pos"),
            "own_number": F.when(F.col("pos") % 11 == 3, F.col("pos")),
            "md": F.col("line"),
        }
    )
    return fold.carry(rows, ["doc_id"]).drop("text")


@query(f"""
WITH r AS (SELECT doc_id, pos, CASE WHEN pos % 6 < 4 THEN 'C' || CAST(pos // 8 AS VARCHAR) END AS chapter, CASE WHEN pos % 5 < 3 THEN 'S' || CAST(pos // 4 AS VARCHAR) END AS section FROM {LINES}),
c AS (SELECT *, chapter IS NOT NULL AND chapter IS DISTINCT FROM last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_chapter FROM r),
d AS (SELECT *, sum(CAST(new_chapter AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
SELECT doc_id, pos, new_chapter, section IS NOT NULL AND section IS DISTINCT FROM last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_section FROM d
""")
def section_change(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "pos", F.expr("CASE WHEN pos % 6 < 4 THEN concat('C', pos div 8) END").alias("chapter"), F.expr("CASE WHEN pos % 5 < 3 THEN concat('S', pos div 4) END").alias("section"))
    return corpus.changes(rows, ["doc_id"]).select("doc_id", "pos", "new_chapter", "new_section")


@query(f"""
WITH k AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN 'section' WHEN pos % 3 = 0 THEN 'continuation' ELSE 'paragraph' END AS kind FROM {LINES}),
r AS (SELECT *, sum(CAST(kind = 'section' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k)
SELECT doc_id, pos, kind = 'paragraph' AND sum(CAST(kind = 'paragraph' AS INTEGER)) OVER (PARTITION BY doc_id, run ORDER BY pos) = 1 AS opens FROM r
""")
def first_in_section(spark, sf_dir):
    kind = F.when(F.col("pos") % 7 == 0, "section").when(F.col("pos") % 3 == 0, "continuation").otherwise("paragraph")
    return typst.first_flags(lines(spark, sf_dir).withColumn("kind", kind), ["doc_id"], "pos").select("doc_id", "pos", "opens")


# ---- numbers, notes, validation ----


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), p AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM d)
SELECT l_orderkey, before, l_linenumber AS after FROM p WHERE before IS NOT NULL AND l_linenumber <> before + 1
""")
def number_gaps(spark, sf_dir):
    """Neighbouring line numbers of an order that don't follow each other."""
    numbers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    return numbers.select("l_orderkey", F.explode(validate.gaps(F.col("numbers"))).alias("g")).select("l_orderkey", "g.before", "g.after")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def defs_without_refs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def refs_without_defs(spark, sf_dir):
    defs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(defs, "l_orderkey", "left_anti")


@query(f"SELECT doc_id, n AS ref, count(*) AS lines FROM (SELECT DISTINCT doc_id, CAST(length(line) % 13 AS INTEGER) AS n, pos FROM {LINES}) GROUP BY doc_id, n")
def note_references(spark, sf_dir):
    """References in text with a mark at the end of each line."""
    marked = F.concat("line", F.lit("[^"), (F.length("line") % 13).cast("string"), F.lit("]"))
    return lines(spark, sf_dir).select("doc_id", F.explode(notes.references(marked)).alias("ref")).groupBy("doc_id", "ref").agg(F.count("*").alias("lines"))


@query("""
WITH r AS (SELECT DISTINCT l_suppkey % 7 AS doc, CAST(l_partkey % 200 AS INTEGER) AS number FROM lineitem), d AS (SELECT CAST(s_suppkey % 7 AS BIGINT) AS doc, CAST(s_suppkey AS INTEGER) AS number, min(s_name) AS text FROM supplier GROUP BY ALL)
SELECT r.doc, r.number, coalesce(text, '[footnote ' || CAST(r.number AS VARCHAR) || ' missing from corpus]') AS text FROM r LEFT JOIN d ON d.doc = r.doc AND d.number = r.number
""")
def notes_resolved(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("doc"), (F.col("l_partkey") % 200).cast("int").alias("number")).distinct()
    defs = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 7).alias("doc"), F.col("s_suppkey").cast("int").alias("number")).agg(F.min("s_name").alias("text"))
    return notes.resolve(refs, defs, ["doc"])


@query("SELECT s_suppkey, unnest([CAST(s_suppkey AS INTEGER), CAST(s_suppkey + 1 AS INTEGER)]) AS number, unnest(['Of ' || s_name, 'And more']) AS text FROM supplier")
def packed_notes(spark, sf_dir):
    """Two definitions in one paragraph."""
    key = F.col("s_suppkey")
    md = F.concat(F.lit("["), key.cast("string"), F.lit("] Of "), F.col("s_name"), F.lit(" ["), (key + 1).cast("string"), F.lit("] And more"))
    names = F.array(F.concat(F.lit("_ftn"), key.cast("string")), F.concat(F.lit("_ftn"), (key + 1).cast("string")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0).alias("pos"), md.alias("md"), md.alias("text_stripped"), names.alias("anchor_names"))
    return notes.definitions(rows, ["s_suppkey"]).drop("pos")


@query("""
WITH n AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS INTEGER)))) AS ns FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(',', CASE WHEN l_orderkey % 10 = 0 THEN 'missing-title' END, CASE WHEN l_orderkey % 7 = 0 THEN 'missing-pope' END,
  CASE WHEN ns[1] <> 1 THEN 'first-paragraph-not-1' END, CASE WHEN ns[len(ns)] - ns[1] + 1 <> len(ns) THEN 'paragraph-number-gap' END,
  CASE WHEN l_orderkey % 3 = 0 THEN 'no-footnote-definitions' WHEN ns <> [1] THEN 'footnote-mismatch' END, CASE WHEN l_orderkey % 5 = 0 THEN 'missing-date' END) AS codes,
  l_orderkey % 10 = 0 OR l_orderkey % 7 = 0 OR l_orderkey % 3 = 0 OR l_orderkey % 5 = 0 AS errors FROM n
""")
def validation_warnings(spark, sf_dir):
    """Orders as documents: line numbers are paragraphs that refer to notes of the same number."""
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("ns"))
    paragraphs = F.transform("ns", lambda n: F.struct(n.alias("number"), F.concat(F.lit("x[^"), n.cast("string"), F.lit("]")).alias("text")))
    footnotes = F.when(key % 3 == 0, F.array().cast(parse.FOOTNOTES)).otherwise(F.array(F.struct(F.lit(1).alias("number"), F.lit("note").alias("text"))))
    document = F.struct(F.when(key % 10 == 0, " ").otherwise("T").alias("title"), F.when(key % 7 == 0, "").otherwise("P").alias("pope"), F.when(key % 5 != 0, F.lit("2001-01-01").cast("date")).alias("promulgated"), paragraphs.alias("paragraphs"), footnotes.alias("footnotes"))
    found = rows.select("l_orderkey", document.alias("d")).select("l_orderkey", validate.checks(F.col("d")).alias("w"))
    return found.select("l_orderkey", F.array_join(F.transform("w", lambda w: w["code"]), ",").alias("codes"), validate.has_errors(F.col("w")).alias("errors"))


@query("""
WITH a AS (SELECT o_orderkey, k, (o_orderkey + k) % 3 = 0 AS clean FROM orders, (SELECT unnest([0, 1, 2]) AS k))
SELECT o_orderkey, CAST(coalesce(min(k) FILTER (WHERE clean), max(k)) AS INTEGER) AS strategy_ord FROM a WHERE k < 2 OR o_orderkey % 2 = 0 GROUP BY o_orderkey
""")
def pick_attempt(spark, sf_dir):
    """The first clean attempt, else the last, of two or three for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("strategy_ord")).where("strategy_ord < 2 OR o_orderkey % 2 = 0")
    clean = (F.col("o_orderkey") + F.col("strategy_ord")) % 3 == 0
    warnings = F.when(clean, F.array().cast(f"array<{validate.WARNING}>")).otherwise(F.array(validate.warning("missing-title", F.lit("title is empty"), "error")))
    found = rows.withColumns({"document": F.struct(F.lit("x").alias("title")), "warnings": warnings})
    return parse.pick(found, "o_orderkey").select("o_orderkey", "strategy_ord")


@query(f"""
WITH s AS (SELECT unnest({[x[0] for x in overrides.SHIPPED]}) AS slug, unnest({[x[1] for x in overrides.SHIPPED]}) AS pope, unnest({[x[1].lower().replace(" ", "-") for x in overrides.SHIPPED]}) AS author),
d AS (SELECT doc_id, CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'veritatis-splendor' WHEN 1 THEN 'mysterium-fidei' ELSE 'other-' || CAST(doc_id AS VARCHAR) END AS title_slug FROM documents)
SELECT doc_id, title_slug, coalesce(author, 'someone') AS author_slug, CASE WHEN title_slug = 'mysterium-fidei' THEN 'Mysterium Fidei' ELSE 'Title' END AS title, coalesce(pope, 'Someone') AS pope FROM d LEFT JOIN s ON slug = title_slug
""")
def override_patch(spark, sf_dir):
    k = F.col("doc_id") % 4
    slug = F.when(k == 0, "veritatis-splendor").when(k == 1, "mysterium-fidei").otherwise(F.concat(F.lit("other-"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", slug.alias("title_slug"), F.lit("someone").alias("author_slug"), F.lit("Title").alias("title"), F.lit("Someone").alias("pope"))
    return overrides.apply(docs, overrides.table(spark))


# ---- text functions ----


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query(rf"""
WITH h AS (SELECT doc_id, pos, regexp_replace(line, '[*]', '', 'g') AS t, regexp_replace(regexp_replace(regexp_replace(line, '[*]', '', 'g'), '^\s+', ''), '\s+$', '') AS plain FROM {LINES}),
c AS (SELECT doc_id, pos, length(plain) AS n, CAST(length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS INTEGER) AS n_upper, CAST(length(regexp_replace(t, '\P{{L}}', '', 'g')) AS INTEGER) AS n_letters FROM h)
SELECT doc_id, pos, n_upper, n_letters, n <= 60 AND n_letters > 0 AND n_upper / n_letters > 0.7 AS signature FROM c
""")
def signature_like(spark, sf_dir):
    """Which whole lines read like a signature, and what the ratio of their letters comes from."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.length(tx.folded(F.col("line"), r"\P{Lu}")).alias("n_upper"), F.length(tx.folded(F.col("line"), r"\P{L}")).alias("n_letters"), tx.is_signature(F.col("line")).alias("signature"))


@query(f"""SELECT doc_id, pos, CASE WHEN pos % 3 = 0 OR regexp_matches(line, '^\\s*[A-Za-z“”"‘’''(\\[*]') THEN CAST(pos % 1200 AS INTEGER) END AS number FROM {LINES}""")
def paragraph_numbers(spark, sf_dir):
    """Numbers of lines that were given one, bold or plain, with or without a space. A plain number needs a
    letter, quote or bracket after it; a bold one has its asterisks there."""
    n = (F.col("pos") % 1200).cast("string")
    marked = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("**"), n, F.lit(".** "), "line")).when(F.col("pos") % 3 == 1, F.concat(n, F.lit("."), "line")).otherwise(F.concat(F.lit("  "), n, F.lit(". "), "line"))
    return lines(spark, sf_dir).select("doc_id", "pos", tx.paragraph_number(marked).alias("number"))


@query("SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN (['I','II','III','IV','V','VI','VII','VIII','IX','X'])[CAST(s_suppkey // 4 % 10 AS INTEGER) + 1] WHEN 1 THEN CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'XIV' END AS numeral FROM supplier")
def chapter_numerals(spark, sf_dir):
    key = F.col("s_suppkey")
    words = F.array(*map(F.lit, tx.CHAPTER_WORDS))
    word = F.element_at(words, (F.floor(key / 4) % 10 + 1).cast("int"))
    text = F.when(key % 4 == 0, F.concat(F.lit("Chapter "), word, F.lit("."))).when(key % 4 == 1, F.concat(F.lit("PART "), key.cast("string"))).when(key % 4 == 2, "CHAPTER XIV:").otherwise("Chapters")
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.chapter_numeral(text).alias("numeral"))


TITLE_WORDS = ", ".join(f"'{w}'" for w in tx.SMALL_WORDS)


@query(rf"""
WITH w AS (SELECT page_id, list_filter(string_split_regex(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), 'ß', 'ss'), '\s+'), lambda x: x <> '') AS ws FROM pages),
e AS (SELECT page_id, len(ws) AS n, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
c AS (SELECT page_id, i, CASE WHEN regexp_matches(w, '^[IVXLCDM]+\.?$') THEN w WHEN i > 1 AND i < n AND lower(regexp_replace(w, '\P{{L}}', '', 'g')) IN ({TITLE_WORDS}) THEN lower(w)
  ELSE regexp_extract(lower(w), '^(\P{{L}}*)', 1) || upper(substr(lower(w), length(regexp_extract(lower(w), '^(\P{{L}}*)', 1)) + 1, 1)) || substr(lower(w), length(regexp_extract(lower(w), '^(\P{{L}}*)', 1)) + 2) END AS x FROM e)
SELECT page_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS title FROM c GROUP BY page_id
""")
def title_case_text(spark, sf_dir):
    """Titles of pages, without the one letter whose capital the two engines write differently."""
    head = F.replace(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("ß"), F.lit("ss"))
    return table(spark, sf_dir, "pages").select("page_id", tx.title_case(head).alias("title"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def parse_dateline(spark, sf_dir):
    """Dates written in three forms and read again."""
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    year, month = F.date_format(date, "yyyy"), F.date_format(date, "MMMM")
    ordinal = F.element_at(F.array(*map(F.lit, tx.ORDINALS)), F.day(date))
    text = (
        F.when(k == 0, F.concat(F.lit("*Given in Rome, on the "), F.day(date).cast("string"), F.lit("th day of "), month, F.lit(", in the year "), year, F.lit("*")))
        .when(k == 1, F.concat(F.lit("Rome, "), month, F.lit(" "), F.day(date).cast("string"), F.lit(", "), year))
        .otherwise(F.concat(F.lit("Given at Rome, the "), ordinal, F.lit(" day of "), month, F.lit(", the year "), year))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.dateline_date(text).alias("date"))


@query("""
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) + k AS y FROM orders, (SELECT unnest([0, 50, 400, 777]) AS k))
SELECT CAST(y AS INTEGER) AS year, (['', 'M', 'MM', 'MMM'])[y // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[y // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[y // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[y % 10 + 1] AS roman FROM y
""")
def roman_year(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.explode(F.array(*(F.year("o_orderdate") + k for k in (0, 50, 400, 777)))).alias("year")).distinct()
    return years.select("year", tx.roman(F.col("year")).alias("roman"))


@query("""
SELECT c_custkey, 'The ' || c_mktsegment[1] || lower(c_mktsegment[2:]) || ' of Hope' AS title, 'On Number ' || CAST(c_custkey AS VARCHAR) AS subtitle,
  CASE WHEN c_custkey % 2 = 0 THEN 'Leo XIV' ELSE 'Francis' END AS pope, CASE WHEN c_custkey % 3 = 0 THEN 'To the People' ELSE '' END AS salutation FROM customer
""")
def title_blocks(spark, sf_dir):
    """Title lines in three layouts: the author by numeral first, or as a single name after."""
    key = F.col("c_custkey")
    title, last = F.concat(F.lit("«THE "), F.col("c_mktsegment"), F.lit(" OF HOPE»")), F.concat(F.lit("ON NUMBER "), key.cast("string"))
    greeting = F.when(key % 3 == 0, F.array(F.lit("TO THE PEOPLE"))).otherwise(F.array().cast("array<string>"))
    named = F.concat(F.array(F.lit("POPE LEO XIV"), F.lit("ENCYCLICAL LETTER"), title), greeting, F.array(last))
    single = F.concat(F.array(F.lit("**ENCYCLICAL LETTER**"), title, F.lit("OF HIS HOLINESS"), F.lit("Pope FRANCIS")), greeting, F.array(last))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.title_block(F.when(key % 2 == 0, named).otherwise(single)).alias("b")).select("c_custkey", "b.*")


@query("SELECT c_custkey, CASE CAST(c_custkey % 3 AS INTEGER) WHEN 0 THEN 'Spes Nova et Viva' ELSE 'Spes Nova' END AS incipit FROM customer")
def incipits(spark, sf_dir):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "*1 Jn* and *spes nova et viva,* we").when(k == 1, "*Spes* is one word").otherwise("no italics")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.incipit(text, F.lit("Spes Nova")).alias("incipit"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || CASE WHEN o_orderkey % 2 = 0 THEN 'author-' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'stem' ELSE 'title' END AS name FROM orders")
def output_basename(spark, sf_dir):
    key = F.col("o_orderkey")
    name = tx.output_name(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 2 == 0, "author").otherwise(""), F.when(key % 3 != 0, "title"), F.lit("stem"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(CAST(l_quantity AS INTEGER) // 7 + CASE WHEN l_linenumber % 7 < CAST(l_quantity AS INTEGER) % 7 THEN 1 ELSE 0 END, 3) AS INTEGER) AS words FROM lineitem")
def word_portions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.portion(F.col("l_quantity").cast("int"), F.col("l_linenumber") % 7, F.lit(7)).alias("words"))


# ---- normalisation ----


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(\d)-(\d)', '\1–\2', 'g'), '(\d)-(\d)', '\1–\2', 'g') AS text FROM documents")
def numeric_dash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", normalize.DIGIT_DASH, "–").alias("text"))


@query(r"""SELECT doc_id, replace(regexp_replace(replace(regexp_replace(text, '(^|[\s(\[{])"', '\1“', 'g'), '"', '”'), '(^|[\s(\[{])''', '\1‘', 'g'), '''', '’') AS text FROM documents""")
def smart_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize.smart_quotes(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769) || 'A' || chr(778)) AS text FROM documents")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize.nfc(F.concat("text", F.lit("éÅ"))).alias("text"))


@query(r"""
WITH a AS (SELECT doc_id, translate(nfc_normalize('a -- b ... 1-2  "q" [^3] ' || text), chr(160) || chr(8232) || chr(8233), '   ') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\.{3,}', '…', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\pL\pN_]) -- ([\pL\pN_])', '\1—\2', 'g'), '([\pL\pN_])---([\pL\pN_])', '\1—\2', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\d)-(\d)', '\1–\2', 'g'), '(\d)-(\d)', '\1–\2', 'g') AS t FROM c),
e AS (SELECT doc_id, replace(regexp_replace(replace(regexp_replace(t, '(^|[\s(\[{])"', '\1“', 'g'), '"', '”'), '(^|[\s(\[{])''', '\1‘', 'g'), '''', '’') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+\[\^(\d+)\]', '[^\1]', 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM e)
SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS text FROM f
""")
def clean_text(spark, sf_dir):
    """The whole chain, over text that has something for every step."""
    return table(spark, sf_dir, "documents").select("doc_id", normalize.clean(F.concat(F.lit('a -- b ... 1-2  "q" [^3] '), "text")).alias("text"))


# ---- corpus files and Typst ----


@query(rf"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_pos, CASE WHEN pos % 4 = 3 THEN 'continuation' ELSE 'paragraph' END AS kind, t AS text, CASE WHEN pos % 4 <> 3 THEN pos END AS number
FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS t FROM {LINES}) WHERE t <> '' AND NOT regexp_matches(t, '^(##|:::|\*Given)')
  AND NOT (pos % 4 = 3 AND length(regexp_replace(t, '^\*+|\*+$', '', 'g')) <= 60 AND length(regexp_replace(t, '\P{{L}}', '', 'g')) > 0 AND length(regexp_replace(t, '\P{{Lu}}', '', 'g')) / length(regexp_replace(t, '\P{{L}}', '', 'g')) > 0.7)
""")
def corpus_round_trip(spark, sf_dir):
    """Lines written as numbered and continuing paragraphs and read back as blocks."""
    text = tx.strip(F.col("line"))
    rows = lines(spark, sf_dir).withColumn("t", text).where((F.col("t") != "") & ~F.rlike("t", F.lit(r"^(##|:::|\*Given)")))
    rows = rows.withColumn("number", F.when(F.col("pos") % 4 != 3, F.col("pos"))).where(F.col("number").isNotNull() | ~tx.is_written_signature(F.col("t")))
    chunks = F.sort_array(F.collect_list(F.struct("pos", corpus.paragraph(F.col("number"), F.col("t")).alias("c"))))
    files = rows.groupBy("doc_id").agg(F.array_join(F.transform(chunks, lambda x: x["c"]), "").alias("body"))
    return corpus.blocks(files, ["doc_id"]).drop("numeral")


@query(f"""
WITH l AS (SELECT doc_id, pos, CAST(pos % 10 AS INTEGER) AS number, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS t FROM {LINES})
SELECT doc_id, number, max_by(t, pos) AS text FROM l GROUP BY doc_id, number
""")
def corpus_footnotes(spark, sf_dir):
    """Notes with numbers that come again: the last counts."""
    rows = lines(spark, sf_dir).withColumn("n", F.concat(F.lit("[^"), (F.col("pos") % 10).cast("string"), F.lit("]: "), tx.strip(F.col("line"))))
    files = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]), "\n\n").alias("notes_text"))
    return corpus.footnotes(files, ["doc_id"])


@query(r"SELECT doc_id, regexp_replace(text, '([\\#@$<>*_`\[\]])', '\\\1', 'g') AS text FROM documents")
def typst_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", typst.escape(F.col("text")).alias("text"))


@query("SELECT s_suppkey, '#strong[' || replace(s_name, '#', '') || ']' || chr(8203) || '(x) \\* #footnote[note ' || CAST(s_suppkey AS VARCHAR) || '] #link(\"http://a.b/' || CAST(s_suppkey AS VARCHAR) || '\")[at]' AS typst FROM supplier")
def typst_inline(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("**"), F.replace(F.col("s_name"), F.lit("#"), F.lit("")), F.lit("**(x) * [^"), n, F.lit("] [at](http://a.b/"), n, F.lit(")"))
    found = F.create_map(F.col("s_suppkey").cast("int"), F.concat(F.lit("note "), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", typst.inline(text, found, F.lit(False)).alias("typst"))


def known_pages(spark, sf_dir) -> DataFrame:
    """Pages in a layout that the parser knows."""
    k = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<div class="vaticanrichtext"><p><b>ENCYCLICAL LETTER<br>SPES '), k, F.lit("<br>LEO XIV<br>ON HOPE</b></p><p><b>CHAPTER ONE</b></p><p><b>THE WAY</b></p><p>1. <i>Spes</i> first"),
        F.lit('<a href="#_ftn1" name="_ftnref1">[1]</a>.</p><p>More of it.</p><p>2. Second.</p><p><i>Given in Rome, on 3 May, in the year 2001.</i></p><p><b>LEO PP. XIV</b></p><hr><p><a href="#_ftnref1" name="_ftn1">[1]</a> A note.</p></div>'),
    )
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("spes-"), k).alias("slug"), html.alias("html"), F.col("url").alias("source_url"))


@query("SELECT 'spes-' || CAST(page_id AS VARCHAR) AS title_slug, 'Spes ' || CAST(page_id AS VARCHAR) AS title, 'Leo XIV' AS pope, DATE '2001-05-03' AS promulgated, CAST(5 AS INTEGER) AS n_paragraphs, CAST(1 AS INTEGER) AS n_footnotes, url AS source_url FROM pages")
def parse_end_to_end(spark, sf_dir):
    """Documents in a known layout, made from pages' numbers, through the whole plan."""
    return parse.parse(known_pages(spark, sf_dir)).select("title_slug", "title", "pope", "promulgated", F.size("paragraphs").alias("n_paragraphs"), F.size("footnotes").alias("n_footnotes"), "source_url")


@query("""
SELECT 'spes-' || CAST(page_id AS VARCHAR) AS slug, CAST(page_id % 4 <> 0 AS INTEGER) AS strategy_ord, page_id % 4 IN (0, 3) AS parsed, CASE CAST(page_id % 4 AS INTEGER)
  WHEN 1 THEN '[error] strategy-crashed: permissive: could not extract promulgation date from body'
  WHEN 2 THEN '[error] strategy-crashed: permissive: body container not found'
  WHEN 3 THEN '[error] no-footnote-definitions: 1 footnote references in body but no definitions parsed' ELSE '' END AS messages FROM pages
""")
def parse_outcomes(spark, sf_dir):
    """The picked attempts at pages of which some have no date, no container or no notes, with their
    messages: what is rejected has gone through both strategies."""
    k = F.substring_index("slug", "-", -1).cast("long") % 4
    html = F.when(k == 1, F.replace("html", F.lit("Given in"), F.lit("Written in"))).when(k == 2, F.replace("html", F.lit("vaticanrichtext"), F.lit("x"))).when(k == 3, F.regexp_replace("html", "<hr>.*", "</div>")).otherwise(F.col("html"))
    found = parse.pick(parse.attempts(known_pages(spark, sf_dir).withColumn("html", html)))
    return found.select("slug", "strategy_ord", F.col("document").isNotNull().alias("parsed"), F.array_join(F.transform("warnings", validate.shown), "; ").alias("messages"))


@query("""
SELECT page_id, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS pos, unnest(['a[^' || CAST(page_id AS VARCHAR) || '].', '*Corpus* VI **bold**', '[at](http://a.b/' || CAST(page_id AS VARCHAR) || ')', 'one two & international ' || CAST(page_id AS VARCHAR), '*x y* z']) AS md,
  unnest(['a[' || CAST(page_id AS VARCHAR) || '].', 'Corpus VI  bold', 'at', 'one|two &amp; inter- national ' || CAST(page_id AS VARCHAR), 'x y z']) AS lines FROM pages
""")
def paragraph_markdown(spark, sf_dir):
    """Inline markup of every kind as Markdown: notes, emphasis with blanks at its edges, links, line
    breaks, entities written twice, words broken over lines, emphasis inside other elements."""
    k = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<div class="vaticanrichtext"><p>a<a href="http://x.y/d.html#_ftn'), k, F.lit('" name="_ftnref'), k, F.lit('">['), k, F.lit("]</a>.</p><p><i>Corpus </i>VI <b> bold</b></p>"),
        F.lit('<p><a href="http://a.b/'), k, F.lit('">at</a><a href="x"></a></p><p>one<br>two &amp;amp; inter- national '), k, F.lit("</p><p><span><i>x<span> y</span></i></span> z</p></div>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return html_tokens.tokens(pages, "page_id").select("page_id", "pos", "md", F.array_join("lines", "|").alias("lines"))


@query()
def corpus_text(spark, sf_dir):
    """Parsed documents as corpus files; YAML has no SQL form."""
    return corpus.render(normalize.normalize(parse.parse(known_pages(spark, sf_dir)))).select("title_slug", "path", "text")


@query()
def typst_source(spark, sf_dir):
    """Corpus files read again and written as Typst source."""
    files = corpus_text(spark, sf_dir).select("path", F.col("text").alias("raw")).persist()
    return typst.emit(corpus.read(files), F.lit("2020-01-01").cast("date"))


@query(f"SELECT doc_id, pos, part FROM (SELECT doc_id, pos, CASE WHEN t = '' THEN 'other' WHEN pos >= 20 THEN 'note' WHEN t LIKE 'Given in%' THEN 'dateline' WHEN t LIKE '%. Text' THEN 'numbered' ELSE 'other' END AS part FROM {LINE_TOKENS})")
def stand_in_parts(spark, sf_dir):
    """What each paragraph is to the stand-in prose."""
    rows = line_tokens(spark, sf_dir).withColumns({"has_own_text": F.lit(True), "text_raw": F.col("text_stripped"), "md": F.col("text_stripped")})
    return anonymise.anonymise(rows, "doc_id").select("doc_id", "pos", "part")
