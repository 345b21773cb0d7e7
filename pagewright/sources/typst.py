"""Typst source text from re-read corpus files. Compiling it to PDF is left to other programs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from pagewright.functions.text import strip

# The four inline tokens, the characters that have a meaning in Typst, the head of a
# file, the text for a missing note.
TOKEN = re.compile(r"\[\^(?P<note>\d+)\]|\*\*(?P<bold>[^*]+)\*\*|\*(?P<italic>[^*\n]+?)\*|\[(?P<label>[^\]]+)\]\((?P<url>[^)\s]+)\)")
SPECIAL = r"[\\#@$<>*_`\[\]]"
HEAD = '#import "/templates/lib/typography.typ": paragraph-num, section-heading, chapter-divider, salutation, dateline, signature\n\n#import "/templates/default.typ": edition, section-opening\n\n#show: edition.with('
MISSING = "[footnote {} missing from corpus]"

# Fixed value: a call whose label doesn't count among a section's first words.
LINK = re.compile(r"#[a-zA-Z][\w-]*\([^)]*\)\[[^\]]*\]")

#: Words of a section that are set in small capitals.
OPENING_WORDS = 4

NO_BREAK = "\u200b"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({SPECIAL})", r"\\$1")


def escaped(text: str) -> str:
    return re.sub(SPECIAL, lambda m: "\\" + m[0], text)


def quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def quote_optional(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "none").otherwise(quote(text))


def typst_date(date: Column) -> Column:
    return F.coalesce(F.concat(F.lit("datetime(year: "), F.year(date).cast("string"), F.lit(", month: "), F.month(date).cast("string"), F.lit(", day: "), F.day(date).cast("string"), F.lit(")")), F.lit("none"))


def markup(text: str, notes: dict[int, str]) -> str:
    """Inline Markdown to Typst markup. A call before an opening bracket is ended by a character of
    no width, so that the bracket isn't taken for more arguments. Footnotes that cite footnotes are
    followed to their end; a note that is open already is a missing one there, which ends cycles."""
    found, at_note = [], []  # at_note: the notes that are open
    # What is open, innermost last: text, where it goes on, its note, and what stands behind its call.
    stack: list[list] = [[text, 0, None, ""]]
    while stack:
        top = stack[-1]
        text, at, note, after = top
        m = TOKEN.search(text, at)
        found.append(escaped(text[at : m.start() if m else len(text)]))
        if not m:
            stack.pop()
            found.append(after)
            if note is not None:
                at_note.pop()
            continue
        top[1] = m.end()
        end = NO_BREAK * (text[m.end() : m.end() + 1] in ("(", "["))
        if m["note"]:
            n = int(m["note"])
            found.append("#footnote[")
            if n in notes and notes[n] is not None and n not in at_note:
                at_note.append(n)
                stack.append([notes[n], 0, n, "]" + end])
            else:
                found.append(escaped(MISSING.format(n)) + "]" + end)
        elif m["bold"]:
            found.append(f"#strong[{escaped(m['bold'])}]" + end)
        elif m["italic"]:
            found.append(f"#emph[{escaped(m['italic'])}]" + end)
        else:
            found.append(f'#link("{m["url"]}")[')
            stack.append([m["label"], 0, None, "]" + end])
    return "".join(found)


def opening(source: str) -> str:
    """The first four words of a section in small capitals, where they stand in the markup as they
    read; else unchanged."""
    words = "".join(LINK.split(source)).translate({ord(c): None for c in "_*"}).split()
    lead = " ".join(words[:OPENING_WORDS])
    before, found, after = source.partition(lead) if lead else (source, "", "")
    return f"{before}#smallcaps[#lower[{found}]]{after}" if found else source


@pandas_udf(T.StringType())
def inline(text: pd.Series, notes: pd.Series, first: pd.Series) -> pd.Series:
    def one(t: str | None, n, f: bool) -> str | None:
        if t is None:
            return None
        found = markup(t, dict(n) if n is not None else {})
        return opening(found) if f else found

    return pd.Series([one(t, n, f) for t, n, f in zip(text, notes, first)])


def first_flags(blocks: DataFrame, keys: list[str], order: str = "block_pos") -> DataFrame:
    """Adds opens: the first paragraph block after a section, a chapter or the start."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("_run", F.sum(F.col("kind").isin("section", "chapter-divider").cast("int")).over(run))
    paragraph = F.sum((F.col("kind") == "paragraph").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("opens", (F.col("kind") == "paragraph") & (paragraph == 1)).drop("_run")


def emit(parsed: DataFrame, today: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys and typst_source of re-read corpus files."""
    keys = keys or ["path"]
    today = F.date_format(F.current_date() if today is None else today, "yyyy-MM-dd")
    rows = parsed.select(*keys, "footnotes", F.posexplode("blocks").alias("block_pos", "b")).select(*keys, "footnotes", "block_pos", "b.*")
    rows = first_flags(rows, keys).withColumn("inner", inline(F.col("text"), F.col("footnotes"), F.col("opens")))
    kind = F.col("kind")
    line = (
        F.when(kind.isin("salutation", "dateline", "signature"), F.concat(F.lit("#"), kind, F.lit("(["), F.col("inner"), F.lit("])")))
        .when(kind == "section", F.concat(F.lit("#section-heading("), quote(F.col("text")), F.lit(")")))
        .when(kind == "chapter-divider", F.concat(F.lit("#chapter-divider("), quote(F.concat(F.coalesce("numeral", F.lit("")), F.lit("."))), F.lit(", "), quote(F.col("text")), F.lit(")")))
        .when(kind == "paragraph", F.concat(F.when(F.col("number") > 0, F.concat(F.lit("#paragraph-num("), F.col("number").cast("string"), F.lit(") "))).otherwise(""), F.col("inner")))
        .when(kind == "continuation", F.col("inner"))
    )
    bodies = rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_pos", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("lines"))
    meta = lambda k: F.try_element_at(F.col("meta"), F.lit(k))
    text = lambda k: quote(F.coalesce(meta(k), F.lit("")))
    fields = (("title", text("title")), ("subtitle", quote_optional(meta("subtitle"))), ("pope", text("pope")), ("promulgated", typst_date(F.try_to_date(meta("promulgated"), "yyyy-MM-dd"))), ("incipit", quote_optional(meta("incipit"))), ("source-url", text("source_url")), ("fetch-date", quote(today)))
    head = F.concat(F.lit(HEAD + "\n"), *(F.concat(F.lit(f"  {k}: "), v, F.lit(",\n")) for k, v in fields), F.lit(")\n"))
    return parsed.join(bodies, keys, "left").select(*keys, strip(F.concat(head, F.coalesce(F.concat(F.lit("\n"), F.col("lines"), F.lit("\n")), F.lit("")))).alias("typst_source"))
