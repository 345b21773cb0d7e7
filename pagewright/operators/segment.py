"""Segmentation: body, title, notes, preamble, dateline and signature of tokenised documents.

All of it is windows over one hash partitioning by document; the count of paragraphs per container
groups within the same partitioning, so one exchange serves every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx

EMPTY = ("", "\u00a0")


def empty(stripped: Column) -> Column:
    return stripped.isin(*EMPTY)


def body_containers(tokens: DataFrame, key: str) -> DataFrame:
    """key, body: the container with most paragraphs, the first of equals. Documents without any
    container are absent."""
    counts = tokens.select(key, F.explode("containers").alias("c")).groupBy(key, "c").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("top")).select(key, (-F.col("top.c")).alias("body"))


def is_definition(anchors: Column) -> Column:
    return F.coalesce(F.exists(anchors, lambda a: F.rlike(a, F.lit(r"^_ftn\d+$"))), F.lit(False))


def is_rubric(stripped: Column) -> Column:
    """The rubric in any case, in a paragraph of a title's length; only those that can hold it are folded."""
    long_enough = F.length(stripped).between(len(tx.RUBRIC), tx.TITLE_LENGTH - 1)
    return long_enough & F.contains(F.upper(stripped), F.lit(tx.RUBRIC))


def find_body(tokens: DataFrame, key: str) -> DataFrame:
    """Adds body, the document's body container, and inside: whether a row stands in it."""
    rows = tokens.join(body_containers(tokens, key), key, "left")
    return rows.withColumn("inside", F.coalesce(F.array_contains("containers", F.col("body")), F.lit(False)))


def find_title(rows: DataFrame, key: str) -> DataFrame:
    """Adds title_pos: the first rubric, else the first filled paragraph right in the body."""
    whole = Window.partitionBy(key)
    rubric = F.min(F.when((F.size("containers") > 0) & is_rubric(F.col("text_stripped")), F.col("pos"))).over(whole)
    direct = F.min(F.when((F.col("parent_container") == F.col("body")) & ~empty(F.col("text_stripped")), F.col("pos"))).over(whole)
    return rows.withColumn("title_pos", F.coalesce(rubric, direct))


def split_notes(rows: DataFrame, key: str) -> DataFrame:
    """Adds is_body and is_note: the body ends before its first note definition."""
    whole = Window.partitionBy(key)
    rows = rows.withColumn("is_def", is_definition(F.col("anchor_names")))
    rows = rows.withColumn("first_def", F.min(F.when(F.col("inside") & F.col("is_def"), F.col("pos"))).over(whole))
    apart = F.array_contains(F.split(F.coalesce("css_class", F.lit("")), r"\s+"), "MsoFootnoteText")
    rows = rows.withColumns(
        {
            "is_body": F.col("inside") & ~F.col("is_def") & (F.col("first_def").isNull() | (F.col("pos") < F.col("first_def"))),
            "is_note": F.col("is_def") & F.when(F.col("first_def").isNotNull(), F.col("inside")).otherwise(apart),
        }
    )
    return rows.drop("is_def", "first_def")


def split(tokens: DataFrame, key: str) -> DataFrame:
    """All three, one after another."""
    return split_notes(find_title(find_body(tokens, key), key), key)


def drop_contents(rows: DataFrame, key: str) -> DataFrame:
    """Adds start: the paragraph before the first numbered one, so that a table of contents goes
    and one heading stays. Null, which keeps all, without a numbered paragraph."""
    whole = Window.partitionBy(key)
    filled = F.col("in_body") & ~empty(F.col("text_stripped"))
    rows = rows.withColumn("first_number", F.min(F.when(filled & F.rlike("text_stripped", F.lit(tx.NUMBERED)), F.col("pos"))).over(whole))
    above = F.max(F.when(filled & (F.col("pos") < F.col("first_number")), F.col("pos"))).over(whole)
    return rows.withColumn("start", F.coalesce(above, F.col("first_number"))).drop("first_number")


def keep_all(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("start", F.lit(None).cast("int"))


def is_heading(rows_own_text: Column) -> Column:
    """A paragraph without text of its own: all of it stands in inline elements."""
    return ~rows_own_text


def is_dateline(stripped: Column) -> Column:
    return F.startswith(stripped, F.lit("Given in")) | F.startswith(stripped, F.lit("Given at"))
