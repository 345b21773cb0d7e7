"""Typographic normalisation of text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import strip


@pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function; texts within Latin-1 are in NFC already and pass by
    the Arrow function, which still sees their rows but finds nulls in them."""
    plain = F.rlike(text, F.lit(r"^[\x00-\xff]*$"))
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


DIGIT_DASH = r"(?U)(?<=\d)-(?=\d)"


def smart_quotes(text: Column) -> Column:
    """Straight quotes at the start, after white space or an opening bracket open; others close."""
    for straight, opening, closing in (('"', "“", "”"), ("'", "‘", "’")):
        text = F.replace(F.regexp_replace(text, rf"(?U)(^|[\s(\[{{]){straight}", f"$1{opening}"), F.lit(straight), F.lit(closing))
    return text


def clean_composed(text: Column) -> Column:
    """All steps after NFC, in their order."""
    text = F.translate(text, "\u00a0\u2028\u2029", "   ")
    text = F.regexp_replace(text, r"\.{3,}", "…")
    text = F.regexp_replace(text, r"(?U)(?<=\w) -- (?=\w)|(?<=\w)---(?=\w)", "—")
    text = F.regexp_replace(text, DIGIT_DASH, "–")
    text = smart_quotes(text)
    text = F.regexp_replace(text, r"(?U)\s+\[\^(\d+)\]", "[^$1]")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(text)


def clean(text: Column) -> Column:
    return clean_composed(nfc(text))


def normalize(parsed: DataFrame) -> DataFrame:
    """Cleans salutation, incipit, paragraphs' section and text, and footnotes' text of parsed
    documents; titles, names and chapters stay as they are. Nested texts are composed (NFC) by the
    tokeniser before they are nested."""
    paragraphs = F.transform("paragraphs", lambda p: p.withField("section", F.when(p["section"] == "", p["section"]).otherwise(clean_composed(p["section"]))).withField("text", clean_composed(p["text"])))
    footnotes = F.transform("footnotes", lambda f: f.withField("text", clean_composed(f["text"])))
    return parsed.withColumns({"salutation": clean(F.col("salutation")), "incipit": clean(F.col("incipit")), "paragraphs": paragraphs, "footnotes": footnotes})
