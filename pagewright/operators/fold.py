"""The body fold: chapters, sections and numbers carried from headings to paragraphs.

The state that a sequential reader would keep is written as windows in document order. A row's kind
is decided alone; what a heading means depends on the last boundary (a paragraph or a preamble)
before it; chapters, sections and numbers are the last events before a paragraph, as structs, so
that an event that clears a value is told from no event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx


def classify(rows: DataFrame, heading: Callable[[Column], Column] | None = None, numeral: Callable[[Column], Column] = tx.chapter_numeral) -> DataFrame:
    """Adds kind: num, preamble, roman, headnum, head or prose, in this precedence, and the parts
    that each needs. rows have md and has_own_text."""
    head = heading(F.col("has_own_text")) if heading else ~F.col("has_own_text")
    rows = rows.withColumns({"own_number": tx.paragraph_number(F.col("md")), "heading": tx.clean_heading(F.col("md"))})
    rows = rows.withColumns({"numeral": numeral(F.col("heading")), "roman_title": tx.roman_heading(F.col("heading")), "head_number": tx.paragraph_number(F.col("heading"))})
    kind = (
        F.when(F.col("own_number").isNotNull(), "num")
        .when(~head, "prose")
        .when(F.col("numeral").isNotNull(), "preamble")
        .when(F.col("roman_title").isNotNull(), "roman")
        .when(F.col("head_number").isNotNull(), "headnum")
        .otherwise("head")
    )
    return rows.withColumn("kind", kind)


def carried(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """All rows, with number, chapter and section from the rows before. Rows whose kind is null stand
    apart: they neither change nor end anything.

    rows have kind, own_number, heading, numeral, roman_title, head_number and md."""
    run = Window.partitionBy(*keys).orderBy(order)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    boundary = F.col("kind").isin("preamble", "num", "prose")
    rows = rows.withColumns(
        {
            "pending": F.coalesce(F.last(F.when(boundary, F.col("kind")), True).over(before) == "preamble", F.lit(False)) & ~boundary,
            "island": F.sum(boundary.cast("int")).over(so_far),
        }
    )
    part = F.when(F.col("pending"), F.regexp_replace(tx.title_case(F.col("heading")), r"\.+$", ""))
    island = Window.partitionBy(*keys, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("chapter_title", F.when(F.col("kind") == "preamble", F.array_join(F.collect_list(part).over(island), " ")))
    full = F.concat_ws(" ", F.concat("numeral", F.lit(".")), F.nullif("chapter_title", F.lit("")))
    chapter = F.when(F.col("kind") == "preamble", full).when((F.col("kind") == "roman") & ~F.col("pending"), F.col("roman_title"))
    rest = F.nullif(tx.paragraph_rest(F.col("heading")), F.lit(""))
    nothing = F.lit(None).cast("string")
    section = (
        F.when(chapter.isNotNull(), F.struct(nothing.alias("value")))
        .when((F.col("kind") == "head") & ~F.col("pending"), F.struct(F.col("heading").alias("value")))
        .when((F.col("kind") == "headnum") & ~F.col("pending"), F.struct(rest.alias("value")))
    )
    number = F.when(F.col("kind").isin("num", "prose"), F.struct(F.lit(None).cast("int").alias("value"))).when((F.col("kind") == "headnum") & ~F.col("pending"), F.struct(F.col("head_number").alias("value")))
    return rows.withColumns(
        {
            "chapter": F.last(chapter, True).over(so_far),
            "section": F.last(section, True).over(so_far)["value"],
            "number": F.coalesce(F.col("own_number"), F.last(number, True).over(before)["value"]),
        }
    )


def told() -> Column:
    """Whether a row is a paragraph, which keeps its text: others only change what follows."""
    return F.col("kind").isin("num", "prose")


def text() -> Column:
    """A paragraph's text, without its own number."""
    return F.when(F.col("kind") == "num", tx.paragraph_rest(F.col("md"))).otherwise(F.col("md"))


def carry(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The paragraphs of carried rows."""
    return carried(rows, keys, order).where(told()).select(*keys, order, "number", "chapter", "section", text().alias("text"))
