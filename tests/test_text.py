import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.functions import normalize
from pagewright.functions import text as tx


def over(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_slugs(spark):
    assert over(spark, tx.slugify, "John Paul II", "Évêque & co", "--a--", "") == ["john-paul-ii", "v-que-co", "a", ""]
    urls = [
        ("https://x.example/en/hf_ben-xvi_enc_20071130_spes-nova.html", "spes-nova"),
        ("https://x.example/papa-francesco_20150524_enciclica-laus.html?x=1", "laus"),
        ("https://x.example/20200101-enciclica-fratres.htm", "fratres"),
        ("https://x.example/20260515-magna.html#top", "magna"),
        ("https://x.example/other.html", "other"),
        ("plain", "plain"),
    ]
    assert over(spark, tx.derive_slug, *(u for u, _ in urls)) == [s for _, s in urls]


@pytest.mark.parametrize(
    ("text", "number", "rest"),
    [
        ("12. Text", 12, "Text"),
        ("131.Later", 131, "Later"),
        ("  7. “Quoted”", 7, "“Quoted”"),
        ("**2.** Bold", 2, "Bold"),
        ("3. *Italic* text", 3, "*Italic* text"),
        ("1.5 metres", None, "1.5 metres"),
        ("100.000 people", None, "100.000 people"),
        ("see 4. Text", None, "see 4. Text"),
        ("", None, ""),
        ("none", None, "none"),
    ],
)
def test_paragraph_numbers(spark, text, number, rest):
    assert over(spark, tx.paragraph_number, text) == [number]
    assert over(spark, tx.paragraph_rest, text) == [rest]


def test_title_case(spark):
    cases = {"“LAUS TIBI": "“Laus Tibi", "'on hope": "'On Hope", "(FOO) OF BAR": "(Foo) of Bar", "JOHN PAUL II": "John Paul II", "THE WAY TO": "The Way To", "FIDES ET RATIO": "Fides et Ratio", "": ""}
    assert over(spark, tx.title_case, *cases) == list(cases.values())


def test_datelines(spark):
    day = datetime.date
    cases = {
        "*Given in Rome, on 30 November, the Feast, in the year 2007, the third*": day(2007, 11, 30),
        "on the 25th day of July, feast of someone, 1968": day(1968, 7, 25),
        "Rome, April 29, 1965": day(1965, 4, 29),
        "the twenty-first day of June 1999": day(1999, 6, 21),
        "the umpteenth day of June, or 3 June 1999": day(1999, 6, 3),
        "on 31 February 2001": None,
        "no date": None,
    }
    assert over(spark, tx.dateline_date, *cases) == list(cases.values())


def test_chapters_and_signatures(spark):
    assert over(spark, tx.chapter_numeral, "CHAPTER ONE", "Part two.", "CHAPTER 3:", "CHAPTER IV", "CHAPTER X Y", "CHAPTERS") == ["I", "II", "3", "IV", None, None]
    assert over(spark, tx.roman_heading, "IV. The way..", "iv. no", "I.") == ["IV. The way", None, None]
    assert over(spark, tx.is_signature, "**BENEDICTUS PP. XVI**", "Plain words", "", "A" * 61, "123", None) == [True, False, False, False, False, False]
    assert over(spark, tx.roman, 1999, 2024, 0, 4000, kind="int") == ["MCMXCIX", "MMXXIV", None, None]


def test_title_blocks(spark):
    def block(*lines):
        return tuple(over(spark, tx.title_block, list(lines), kind="array<string>")[0])

    assert block("ENCYCLICAL LETTER", "SPES NOVA", "OF THE SUPREME PONTIFF", "BENEDICT XVI", "ON HOPE") == ("Spes Nova", "On Hope", "Benedict XVI", "")
    assert block("SPES NOVA", "OF THE HOLY FATHER", "FRANCIS", "ON CARE", "FOR ALL") == ("Spes Nova", "On Care for All", "Francis", "")
    assert block("POPE JOHN PAUL II", "«SPES NOVA»") == ("Spes Nova", None, "John Paul II", "")
    assert block("SPES NOVA", "LEO XIV", "TO THE BISHOPS", "PRIESTS", "ON HOPE") == ("Spes Nova", "On Hope", "Leo XIV", "To the Bishops, Priests")
    assert block() == ("", None, "", "")


def test_incipit(spark):
    f = lambda title: lambda c: tx.incipit(c, F.lit(title))
    assert over(spark, f("Spes Nova"), "*1 Jn* and *spes nova, we say,* text", "*Spes* is one", "none", None) == ["Spes Nova, We Say", "Spes Nova", "Spes Nova", "Spes Nova"]


def test_clean(spark):
    cases = {
        "wait....": "wait…",
        'he said "so" and \'no\'': "he said “so” and ‘no’",
        "a -- b---c": "a—b—c",
        "1-2-3": "1–2–3",
        "a b c": "a b c",
        "text [^3].": "text[^3].",
        "  x   y ": "x y",
        "é": "é",
        "“kept”": "“kept”",
    }
    assert over(spark, normalize.clean, *cases) == list(cases.values())
    assert over(spark, normalize.clean, None) == [None]


def test_summaries(spark):
    assert over(spark, tx.short_list, [1, 2], [1, 2, 3, 4, 5, 6, 7], kind="array<int>") == ["[1, 2]", "[1, 2, 3, 4, 5] (+2 more)"]
    words = over(spark, lambda c: tx.stand_in(c, F.lit(9), ("a", "b", "c")), "k", "k", "j")
    assert words[0] == words[1] != words[2] and words[0].endswith(".") and words[0].count(",") == 1
