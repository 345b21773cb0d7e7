"""Footnotes: definitions from paragraphs, and references resolved against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import strip


def definition_numbers(anchors: Column) -> Column:
    hits = F.filter(anchors, lambda a: F.rlike(a, F.lit(r"^_ftn\d+$")))
    return F.transform(hits, lambda a: F.regexp_extract(a, r"(\d+)$", 1).cast("int"))


def unmarked(md: Column) -> Column:
    """A definition's text without its leading [N] or N]."""
    return strip(F.regexp_replace(strip(md), r"^\[?\d+\]", ""))


def packed(md: Column, numbers: Column) -> Column:
    """array<struct(number, text)> of a paragraph that holds several definitions: it is cut after
    each anchor's N], from left to right; numbers whose mark isn't found are passed over."""

    def step(state: Column, n: Column) -> Column:
        mark = F.concat(F.lit(r"\b"), n.cast("string"), F.lit(r"\]"))
        rest = state["rest"]
        at = F.regexp_instr(rest, mark)
        piece = F.substring(rest, F.lit(1), at - 1)
        after = F.substring(rest, at + F.length(n.cast("string")) + 1, F.length(rest))
        closed = F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(state["open"].alias("number"), strip(F.regexp_replace(strip(piece), r"\[+$", "")).alias("text")))))
        moved = F.struct(after.alias("rest"), n.alias("open"), closed.alias("done"))
        return F.when(at > 0, moved).otherwise(state)

    none = F.from_json(F.lit("[]"), "array<struct<number:int,text:string>>")
    start = F.struct(md.alias("rest"), F.lit(None).cast("int").alias("open"), none.alias("done"))
    finish = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["open"].alias("number"), strip(s["rest"]).alias("text")))))
    return F.aggregate(numbers, start, step, finish)


def defined() -> Column:
    """array<struct(number, text)> of a note paragraph (with md, anchor_names)."""
    numbers = definition_numbers(F.col("anchor_names"))
    lead = F.regexp_extract(F.substring("md", 1, 20), r"\[(\d+)\]", 1).try_cast("int")
    one = F.array(F.struct(F.coalesce(lead, F.try_element_at(numbers, F.lit(1))).alias("number"), unmarked(F.col("md")).alias("text")))
    return F.when(F.size(numbers) <= 1, one).otherwise(packed(F.col("md"), numbers))


def definitions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, number, text of the note paragraphs (with md, anchor_names, text_stripped)."""
    held = rows.where(~F.col("text_stripped").isin("", "\u00a0")).withColumn("note", F.explode(defined()))
    return held.select(*keys, "pos", F.col("note.number").alias("number"), F.col("note.text").alias("text")).where(F.col("number").isNotNull())


def references(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))


def resolve(refs: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """refs(keys, number) with the text of their definition, or a note that it is missing."""
    missing = F.concat(F.lit("[footnote "), F.col("number").cast("string"), F.lit(" missing from corpus]"))
    return refs.join(defs.select(*keys, "number", "text"), [*keys, "number"], "left").withColumn("text", F.coalesce("text", missing))
