"""Validation: the warnings of a parsed document as one array, in the order of the checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import gap_list, let, short_list, strip

from .notes import references

WARNING = "struct<code:string,message:string,severity:string>"


def warning(code: str, message: Column, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"))


def gaps(numbers: Column) -> Column:
    """Neighbours in an array of numbers where the second isn't the first plus one."""
    pairs = F.transform(F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))), lambda n, i: F.struct(F.element_at(numbers, i + 1).alias("before"), n.alias("after")))
    return F.filter(pairs, lambda p: p["after"] != p["before"] + 1)


def checks(d: Column) -> Column:
    """d: a struct with title, pope, promulgated, paragraphs and footnotes."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    numbers = F.transform(F.filter(d["paragraphs"], lambda p: p["number"].isNotNull()), lambda p: p["number"])
    refs = F.array_sort(F.array_distinct(F.flatten(F.transform(d["paragraphs"], lambda p: references(p["text"])))))
    defs = F.array_sort(F.array_distinct(F.transform(d["footnotes"], lambda f: f["number"])))
    return F.array_compact(
        F.concat(
            F.array(
                F.when(blank(d["title"]), warning("missing-title", F.lit("title is empty"), "error")),
                F.when(blank(d["pope"]), warning("missing-pope", F.lit("pope is empty"), "error")),
            ),
            let(numbers, lambda n: number_checks(F.size(d["paragraphs"]), n, gaps(n))),
            F.array(let(F.struct(refs.alias("refs"), defs.alias("defs")), lambda x: note_check(x["refs"], x["defs"]))),
            F.array(F.when(d["promulgated"].isNull(), warning("missing-date", F.lit("could not extract promulgation date"), "error"))),
        )
    )


def number_checks(count: Column, numbers: Column, jumps: Column) -> Column:
    first = F.try_element_at(numbers, F.lit(1))
    return F.array(
        F.when(count == 0, warning("no-paragraphs", F.lit("no body paragraphs extracted"), "error")).when(F.size(numbers) == 0, warning("no-numbered-paragraphs", F.lit("no numbered paragraphs: the layout may be unfamiliar"), "error")),
        F.when(first != 1, warning("first-paragraph-not-1", F.concat(F.lit("first numbered paragraph is "), first.cast("string"), F.lit(", expected 1")), "warn")),
        let(jumps, lambda j: F.when(F.size(j) > 0, warning("paragraph-number-gap", F.concat(F.lit("paragraph numbers are non-contiguous: "), gap_list(j)), "warn"))),
    )


def note_check(refs: Column, defs: Column) -> Column:
    """References without any definition are an error; sets that differ are a warning."""
    told = lambda name, values: let(values, lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f"{name}: "), short_list(v))))
    mismatch = F.concat_ws("; ", told("refs without defs", F.array_except(refs, defs)), told("defs without refs", F.array_except(defs, refs)))
    none = warning("no-footnote-definitions", F.concat(F.size(refs).cast("string"), F.lit(" footnote references in body but no definitions parsed")), "error")
    return F.when((F.size(refs) > 0) & (F.size(defs) == 0), none).otherwise(let(mismatch, lambda m: F.when(m != "", warning("footnote-mismatch", m, "warn"))))


def has_errors(warnings: Column) -> Column:
    return F.exists(warnings, lambda w: w["severity"] == "error")


def shown(w: Column) -> Column:
    return F.concat(F.lit("["), w["severity"], F.lit("] "), w["code"], F.lit(": "), w["message"])


#: Colours of severities on a terminal; any other is white.
COLOURS = {"error": "red", "warn": "yellow", "info": "blue"}
