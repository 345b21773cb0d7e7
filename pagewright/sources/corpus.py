"""The corpus text format: annotated Markdown with YAML frontmatter, written and read again."""

from __future__ import annotations

import functools
import re
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from pagewright.functions import text as tx

# The fields of the frontmatter and the kinds of fences, in their order.
META = ("title_slug", "author_slug", "publication_date_slug", "title", "subtitle", "pope", "promulgated", "incipit", "salutation", "source_url")
FENCES = ("salutation", "dateline", "signature", "paragraph", "chapter-divider")
OPEN = r"(?U)^:::\s*\{\.(" + "|".join(FENCES) + r")(?:\s+n=(\d+))?(?:\s+numeral=([IVXLCDM]+))?\}\s*$"
CLOSE = r"(?U)^:::\s*$"
HEADING = r"(?U)^##\s+(.+?)\s*$"
CHAPTER = r"^([IVXLCDM]+)\.\s*(.*)$"


# ---- writing ----


#: Words and URLs that YAML writes as they are, unless they are WORDS of its own or the line is longer
#: than LINE; dates it quotes.
BARE = re.compile(r"[A-Za-z][A-Za-z0-9/_.-]*(?::[A-Za-z0-9/_.?=&%+-]+)*(?: [A-Za-z0-9][A-Za-z0-9/_.-]*)*")
WORDS, LINE = frozenset("yes no true false on off null".split()), 80
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


@functools.lru_cache(4096)
def dumped(name: str, value: str | None) -> str:
    """What YAML itself makes of a field: its quoting and wrapping are its own."""
    import yaml

    return yaml.safe_dump({name: value}, sort_keys=False, allow_unicode=True, default_flow_style=False)


def field(name: str, value: str | None) -> str:
    """A field's lines, without the emitter where its result is plain."""
    if value is not None and len(name) + 2 + len(value) <= LINE:
        if BARE.fullmatch(value) and value.lower() not in WORDS:
            return f"{name}: {value}\n"
        if DATE.fullmatch(value):
            return f"{name}: '{value}'\n"
    return dumped(name, value)


@pandas_udf(T.StringType())
def frontmatter(meta: pd.DataFrame) -> pd.Series:
    """A mapping in block style is its fields one after another: one Arrow pass."""
    columns = [[field(name, None if pd.isna(v) else v) for v in meta[name]] for name in meta.columns]
    return pd.Series(["---\n" + "".join(row) + "---\n" for row in zip(*columns)], dtype=object)


def fence(head: Column, text: Column) -> Column:
    return F.concat(F.lit("::: {."), head, F.lit("}\n"), text, F.lit("\n:::\n\n"))


def chapter_divider(chapter: Column) -> Column:
    """A fence with the numeral; a chapter without a Roman numeral becomes a section heading."""
    numeral, title = F.regexp_extract(chapter, CHAPTER, 1), tx.strip(F.regexp_extract(chapter, CHAPTER, 2))
    head = F.concat(F.lit("chapter-divider numeral="), numeral)
    bare = F.concat(F.lit("::: {."), head, F.lit("}\n:::\n\n"))
    return F.when(~F.rlike(chapter, F.lit(CHAPTER)), F.concat(F.lit("## "), chapter, F.lit("\n\n"))).when(title == "", bare).otherwise(fence(head, title))


def paragraph(number: Column, text: Column) -> Column:
    dated = F.startswith(text, F.lit("*Given in")) | F.startswith(text, F.lit("*Given at"))
    return (
        F.when(number.isNotNull(), fence(F.concat(F.lit("paragraph n="), number.cast("string")), text))
        .when(dated, fence(F.lit("dateline"), text))
        .when(tx.is_written_signature(text), fence(F.lit("signature"), F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")))
        .otherwise(F.concat(text, F.lit("\n\n")))
    )


def changes(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Adds new_chapter and new_section: where they differ from the last that isn't null; a new
    chapter forgets the section."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new_chapter", F.col("chapter").isNotNull() & ~F.col("chapter").eqNullSafe(F.last("chapter", True).over(before)))
    told = F.when(F.col("new_chapter") | F.col("section").isNotNull(), F.struct(F.col("section").alias("value")))
    last = F.when(~F.col("new_chapter"), F.last(told, True).over(before)["value"])
    return rows.withColumn("new_section", F.col("section").isNotNull() & ~F.col("section").eqNullSafe(last))


def render(documents: DataFrame, key: str = "title_slug") -> DataFrame:
    """key, path and text of every document's corpus file."""
    rows = changes(documents.select(key, F.posexplode("paragraphs").alias("pos", "p")).select(key, "pos", "p.*"), [key])
    text = F.concat(F.when(F.col("new_chapter"), chapter_divider(F.col("chapter"))).otherwise(""), F.when(F.col("new_section"), F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"))).otherwise(""), paragraph(F.col("number"), F.col("text")))
    bodies = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "").alias("body"))
    meta = frontmatter(F.struct(*(F.col(c).cast("string").alias(c) for c in META)))
    greeting = F.when(F.coalesce("salutation", F.lit("")) == "", "").otherwise(fence(F.lit("salutation"), F.col("salutation")))
    tail = F.when(F.size("footnotes") == 0, "").otherwise(F.concat(F.lit("\n## Footnotes\n\n"), F.array_join(F.transform("footnotes", lambda f: F.concat(F.lit("[^"), f["number"].cast("string"), F.lit("]: "), f["text"], F.lit("\n\n"))), "")))
    path = F.concat_ws("/", F.lit("corpus"), "author_slug", F.concat(F.col(key), F.lit(".md")))
    return documents.join(bodies, key, "left").select(key, "author_slug", path.alias("path"), F.concat(meta, F.lit("\n"), greeting, F.coalesce("body", F.lit("")), tail).alias("text"))


def new_only(rendered: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Files that aren't there yet, or all by force. existing has their paths."""
    return rendered if force else rendered.join(existing.select("path"), "path", "left_anti")


def write(rendered: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """A folder for each author, by Spark's text writer; a row is a whole file's text."""
    rendered.select("author_slug", F.col("text").alias("value")).write.mode(mode).option("lineSep", "\x00").partitionBy("author_slug").text(folder)


def write_files(rows: DataFrame, root: str) -> None:
    """A file for each row of path and text, under a folder that all executors share. Files are
    put in place by renaming, so a task that runs twice leaves the same files."""

    def put(part) -> None:
        for r in part:
            target = Path(root, r["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            draft = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            draft.write_text(r["text"], encoding="utf-8", newline="\n")
            draft.replace(target)

    rows.select("path", "text").foreachPartition(put)


# ---- reading ----


def scan(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """path and raw text of each file, in no order; sort by path for a listing."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def split(raw: DataFrame) -> DataFrame:
    """Adds meta_text, body, notes_text and error. Frontmatter must open the file and end; notes
    start at the first '## Footnotes' line."""
    text = F.col("raw")
    opened = F.startswith(text, F.lit("---\n"))
    end = F.locate("\n---\n", text, 5)
    error = F.when(~opened, "corpus file missing YAML frontmatter").when(end == 0, "corpus frontmatter is not terminated")
    whole = F.when(error.isNull(), F.substring(text, end + 5, F.length(text)))
    mark = "\n## Footnotes\n"
    at = F.locate(mark, F.col("_whole"))
    return (
        raw.withColumns({"error": error, "meta_text": F.when(error.isNull(), F.substring(text, F.lit(5), end - 4)), "_whole": whole})
        .withColumns({"body": F.when(at > 0, F.substring("_whole", F.lit(1), at - 1)).otherwise(F.col("_whole")), "notes_text": F.when(at > 0, F.substring("_whole", at + len(mark), F.length("_whole")))})
        .drop("_whole")
    )


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def meta_of(text: pd.Series) -> pd.Series:
    import yaml

    return text.map(lambda t: {str(k): None if v is None else str(v) for k, v in (yaml.safe_load(t) or {}).items()}, na_action="ignore")


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RIGHT = rf"(?U){tx.BLANK}+$"


def numbered_lines(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    return files.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, LINE_END)).alias("pos", "line"))


def footnotes(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, text: lines after a definition go on with it, the last of a number counts."""
    pattern = r"(?U)^\[\^(\d+)\]:\s*(.*)$"
    rows = numbered_lines(files, keys, "notes_text").withColumn("n", tx.matched(F.col("line"), pattern).try_cast("int"))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"island": F.count("n").over(run), "piece": F.when(F.col("n").isNotNull(), F.regexp_extract("line", pattern, 2)).otherwise(tx.strip(F.col("line")))})
    rows = rows.where((F.col("island") > 0) & (F.col("n").isNotNull() | (F.col("piece") != "")))
    held = rows.groupBy(*keys, "island").agg(F.max("n").alias("number"), tx.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")).alias("text"))
    return held.groupBy(*keys, "number").agg(F.max_by("text", "island").alias("text"))


def blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_pos, kind, text, number, numeral of every block of a body.

    Whether a line is in a fence follows from the last line that opens or closes one; islands of
    lines are blocks. A fence without an end is lost."""
    rows = numbered_lines(files, keys, "body").withColumn("line", F.regexp_replace("line", RIGHT, ""))
    run = Window.partitionBy(*keys).orderBy("pos")
    before, so_far = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_open, is_close = F.rlike("line", F.lit(OPEN)), F.rlike("line", F.lit(CLOSE))
    rows = rows.withColumn("inside", F.coalesce(F.last(F.when(is_open, True).when(is_close, False), True).over(before), F.lit(False)))
    mark = (
        F.when(is_open & ~F.col("inside"), "open")
        .when(is_close & F.col("inside"), "close")
        .when(~F.col("inside") & F.rlike("line", F.lit(HEADING)), "heading")
        .when(~F.col("inside") & (F.col("line") == ""), "blank")
    )
    rows = rows.withColumn("mark", mark)
    ended = F.coalesce(F.count(F.when(F.col("mark").isin("heading", "close"), 1)).over(before), F.lit(0))
    rows = rows.withColumn("island", F.count("mark").over(so_far) + ended)
    opened = F.max(F.when(F.col("mark") == "open", F.col("line")))
    rows = rows.withColumn("closed", F.max(F.when(F.col("mark") == "close", F.col("pos"))).over(Window.partitionBy(*keys)))
    content = F.transform(F.sort_array(F.collect_list(F.when(F.col("mark").isNull(), F.struct("pos", "line")))), lambda x: x["line"])
    held = rows.groupBy(*keys, "island").agg(
        F.min("pos").alias("first"), F.max("closed").alias("closed"), opened.alias("opened"), F.max(F.when(F.col("mark") == "heading", F.regexp_extract("line", HEADING, 1))).alias("heading"), tx.strip(F.array_join(content, " ")).alias("text")
    )
    fenced = F.regexp_extract("opened", OPEN, 1)
    kind = F.when(F.col("opened").isNotNull(), fenced).when(F.col("heading").isNotNull(), "section").when(F.col("text") != "", "continuation")
    held = held.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("opened").isNull() | (F.col("closed") > F.col("first"))))
    number = F.when(F.col("kind") == "paragraph", F.regexp_extract("opened", OPEN, 2).try_cast("int"))
    numeral = F.when(F.col("kind") == "chapter-divider", F.nullif(F.regexp_extract("opened", OPEN, 3), F.lit("")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return held.select(*keys, place.alias("block_pos"), "kind", F.coalesce("heading", "text").alias("text"), number.alias("number"), numeral.alias("numeral"))


def read(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, error, meta, blocks and footnotes of files(keys, raw)."""
    keys = keys or ["path"]
    parts = split(files)
    held = blocks(parts, keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_pos", "kind", "text", "number", "numeral"))), lambda b: b.dropFields("block_pos")).alias("blocks"))
    notes = footnotes(parts, keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("number", "text")))).alias("footnotes"))
    return parts.select(*keys, "error", meta_of(F.col("meta_text")).alias("meta")).join(held, keys, "left").join(notes, keys, "left")
