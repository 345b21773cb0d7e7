"""Stand-in prose for documents: structure stays, prose is replaced by hashed words of as many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import segment

WORDS = ("lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "eiusmod", "tempor", "magna", "aliqua", "enim", "minim", "veniam", "quis")

#: A paragraph without a number is prose if it is longer.
PROSE = 60


def anonymise(tokens: DataFrame, key: str = "slug") -> DataFrame:
    """Adds part (title, heading, dateline, signature, note, numbered, continuation or other) and
    stand_in: the text with its prose replaced, the same whenever it is made for the same key."""
    text = F.col("text_stripped")
    part = (
        F.when(segment.empty(text), "other")
        .when(segment.is_definition(F.col("anchor_names")), "note")
        .when(segment.is_rubric(text), "title")
        .when(segment.is_dateline(text), "dateline")
        .when(tx.paragraph_number(text).isNotNull(), "numbered")
        .when(tx.is_signature(text), "signature")
        .when(~F.col("has_own_text"), "heading")
        .when(F.length(text) > PROSE, "continuation")
        .otherwise("other")
    )
    seed = F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string"))
    prose = tx.stand_in(seed, tx.word_count(F.col("text_raw")), WORDS)
    lead = F.when(F.col("part") == "numbered", F.concat(tx.paragraph_number(text).cast("string"), F.lit(". "))).when(F.col("part") == "note", F.concat(F.regexp_extract("md", r"^(\[?\d+\])", 1), F.lit(" "))).otherwise("")
    changed = F.when(F.col("part").isin("numbered", "note", "continuation"), F.concat(lead, prose)).otherwise(F.col("text_raw"))
    return tokens.withColumn("part", part).withColumn("stand_in", changed)
