"""Parsing: pages to documents, with a chain of strategies that heals what validation rejects."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import fold, html_tokens, notes, segment, validate

from . import overrides as settings
from . import strategy as strategies
from .strategy import DEFAULT_CHAIN, Strategy

PARAGRAPHS = "array<struct<number:int,chapter:string,section:string,text:string>>"
FOOTNOTES = "array<struct<number:int,text:string>>"


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, persisted until release()."""
    _kept.append(df.persist())
    return _kept[-1]


def release() -> None:
    """Frees the tokens and attempts that parsing has kept, once what reads them is written."""
    while _kept:
        _kept.pop().unpersist()


def in_order(held: Column, *fields: str) -> Column:
    """An array of structs that begin with pos in order of pos, without pos."""
    return F.transform(F.sort_array(held), lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def attempt(pages: DataFrame, tokens: DataFrame, strategy: Strategy, order: int = 0, key: str = "slug") -> DataFrame:
    """One strategy over all pages: key, strategy_ord, strategy_name, document (null if it failed)
    and warnings. pages: key, html, source_url; tokens: the pages' tokens."""
    faults = tokens.where(F.col("error").isNotNull()).groupBy(key).agg(F.first("error").alias("fault"))
    rows = strategy.find_body(tokens.where(F.col("error").isNull()), key)
    rows = strategy.split_notes(strategy.find_title(rows, key), key)
    rows = rows.withColumn("first_body", F.min(F.when(F.col("is_body"), F.col("pos"))).over(Window.partitionBy(key)))
    rows = rows.withColumn("in_body", F.col("is_body") & ~((F.col("pos") == F.col("title_pos")) & (F.col("title_pos") == F.col("first_body"))))
    rows = strategy.drop_preamble(rows, key)
    rows = rows.withColumn("in_body", F.col("in_body") & (F.col("start").isNull() | (F.col("pos") >= F.col("start"))))
    filled = F.col("in_body") & ~segment.empty(F.col("text_stripped"))
    rows = rows.withColumn("dateline", F.max(F.when(filled & strategy.is_dateline(F.col("text_stripped")), F.col("pos"))).over(Window.partitionBy(key)))
    rows = rows.withColumn("in_text", F.coalesce(filled & (tx.strip(F.col("md")) != "") & (F.col("dateline").isNull() | (F.col("pos") < F.col("dateline"))), F.lit(False)))
    # Rows that aren't the body's text go along without a kind, so one pass serves text, notes and heads.
    rows = fold.classify(rows.withColumnRenamed("md", "own_md").withColumn("md", F.when(F.col("in_text"), F.col("own_md"))), strategy.is_heading, strategy.chapter_numeral)
    rows = fold.carried(rows.withColumn("kind", F.when(F.col("in_text"), F.col("kind"))), [key]).withColumns({"text": fold.text(), "md": F.col("own_md")})
    note = F.when(F.col("is_note") & ~segment.empty(F.col("text_stripped")), F.transform(F.filter(notes.defined(), lambda n: n["number"].isNotNull()), lambda n: F.struct(F.col("pos"), n["number"].alias("number"), n["text"].alias("text"))))
    parts = rows.groupBy(key).agg(
        in_order(F.collect_list(F.when(fold.told(), F.struct("pos", "number", "chapter", "section", "text"))), "number", "chapter", "section", "text").alias("kept"),
        in_order(F.flatten(F.collect_list(note)), "number", "text").alias("footnotes"),
        F.max("body").alias("body"),
        F.max("title_pos").alias("title_pos"),
        F.max("first_body").alias("first_body"),
        F.max(F.when(F.col("pos") == F.col("title_pos"), F.col("lines"))).alias("lines"),
        F.max(F.when(F.col("pos") == F.col("dateline"), F.col("md"))).alias("dateline_md"),
        F.min(F.when(filled & (F.col("pos") > F.col("dateline")), F.struct("pos", "md")))["md"].alias("after_md"),
    )
    url = F.coalesce(F.nullif("source_url", F.lit("")), tx.source_url(F.col("html")))  # read off the page only if it isn't given
    found = pages.select(key, url.alias("source_url")).join(parts, key, "left").join(faults, key, "left")
    found = found.withColumn("signature_md", F.when(strategy.is_signature(F.col("after_md")) & (F.col("after_md") != ""), F.col("after_md")))
    promulgated = tx.dateline_date(F.col("dateline_md"))
    failure = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("body").isNull(), "body container not found")
        .when(F.col("title_pos").isNull(), "title paragraph not found")
        .when(F.col("first_body").isNull(), "no body paragraphs found")
        .when(promulgated.isNull(), "could not extract promulgation date from body")
    )
    closing = F.transform(F.array_compact(F.array("dateline_md", "signature_md")), lambda t: F.struct(F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"), t.alias("text")))
    found = found.withColumns({"failure": failure, "block": strategy.title_block(F.coalesce("lines", F.array().cast("array<string>"))), "promulgated": promulgated, "kept": F.coalesce("kept", F.array().cast(PARAGRAPHS))})
    first = F.try_element_at(F.filter("kept", lambda p: p["number"] == 1), F.lit(1))["text"]
    document = F.struct(
        F.col(key).alias("title_slug"),
        F.when(F.col("block.pope") == "", "").otherwise(tx.slugify(F.col("block.pope"))).alias("author_slug"),
        F.date_format("promulgated", "yyyy-MM-dd").alias("publication_date_slug"),
        F.col("block.title").alias("title"),
        F.col("block.subtitle").alias("subtitle"),
        F.col("block.pope").alias("pope"),
        F.col("promulgated"),
        F.when(F.col("block.title") == "", F.coalesce(tx.incipit(first, F.col("block.title")), F.lit(""))).otherwise(F.coalesce(tx.incipit(first, F.col("block.title")), F.col("block.title"))).alias("incipit"),
        F.col("block.salutation").alias("salutation"),
        F.concat("kept", closing).cast(PARAGRAPHS).alias("paragraphs"),
        F.coalesce("footnotes", F.array().cast(FOOTNOTES)).alias("footnotes"),
        F.col("source_url"),
    )
    found = found.withColumn("document", F.when(F.col("failure").isNull(), document))
    crashed = F.array(validate.warning("strategy-crashed", F.concat(F.lit(f"{strategy.name}: "), F.col("failure")), "error"))
    judged = F.when(F.col("failure").isNotNull(), crashed).otherwise(validate.checks(F.col("document")))
    return found.select(key, F.lit(order).alias("strategy_ord"), F.lit(strategy.name).alias("strategy_name"), "document", judged.alias("warnings"))


def is_clean() -> Column:
    return F.col("document").isNotNull() & ~validate.has_errors(F.col("warnings"))


def clean(attempts: DataFrame) -> DataFrame:
    return attempts.where(is_clean())


class ParseWarning(UserWarning):
    """What ``warn`` issues: a code that attempts at documents got, and how often."""


def warn(found: DataFrame) -> None:
    """A Python warning for each code and severity of the attempts, with the number of pages: a report
    whose size doesn't grow with the corpus. The attempts hold the messages themselves."""
    counts = found.select(F.explode("warnings").alias("w")).groupBy("w.severity", "w.code").agg(F.count("*").alias("n")).orderBy("severity", "code")
    for r in counts.collect():
        warnings.warn(f"[{r.severity}] {r.code}: {r.n} pages", ParseWarning, stacklevel=2)


def attempts(pages: DataFrame, chain: Sequence[Strategy] | None = None, key: str = "slug", tokens: DataFrame | None = None, strategy: Strategy | None = None, **tokeniser) -> DataFrame:
    """Every attempt of every page. The next strategy of a chain sees only the pages that the ones
    before left without a clean document. A single strategy goes before a chain; without either, pages
    whose settings name a strategy are parsed with it alone, and the others by the default chain. Pages
    are tokenised once; ``release`` frees what is kept of them once the result is written."""
    spark = pages.sparkSession
    if strategy is not None:
        chain = (strategy,)
    if tokens is None:
        tokens = kept(html_tokens.tokens(pages, key, **tokeniser).repartition(key).sortWithinPartitions(key, "pos"))  # all windows read this order
    if chain is not None:
        return chained(pages, tokens, chain, key)
    named = settings.table(spark).where(F.col("strategy").isNotNull()).select(F.col("slug").alias(key), F.col("strategy").alias("own_strategy"))
    names = sorted({c.strategy for c in settings._configs.values() if c.strategy})
    if not names:
        return chained(pages, tokens, DEFAULT_CHAIN, key)
    rest = pages.join(F.broadcast(named.select(key)), key, "left_anti")
    found = chained(rest, tokens.join(rest.select(key), key, "left_semi"), DEFAULT_CHAIN, key)
    for name in names:
        own = pages.join(F.broadcast(named.where(F.col("own_strategy") == name).select(key)), key, "left_semi")
        found = found.unionByName(chained(own, tokens.join(own.select(key), key, "left_semi"), (strategies.get(name),), key))
    return found


def chained(pages: DataFrame, tokens: DataFrame, chain: Sequence[Strategy], key: str) -> DataFrame:
    found = None
    left, left_tokens = pages, tokens
    for order, strategy in enumerate(chain):
        own = attempt(left, left_tokens, strategy, order, key)
        last = order + 1 == len(chain)
        own = own if last else kept(own)  # read here and to find what is left
        found = own if found is None else found.unionByName(own)
        if not last:
            if own.where(~is_clean()).isEmpty():
                break
            done = clean(own).select(key)
            left, left_tokens = left.join(done, key, "left_anti"), left_tokens.join(done, key, "left_anti")
    return found


def pick(found: DataFrame, key: str = "slug") -> DataFrame:
    """The first clean attempt of each page, else its last, which may be one without a document."""
    ok = is_clean()
    order = Window.partitionBy(key).orderBy(ok.desc(), F.when(ok, F.col("strategy_ord")).otherwise(-F.col("strategy_ord")))
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def failures(picked: DataFrame, key: str = "slug") -> DataFrame:
    """The pages that no strategy could read: key, strategy_name and the last message."""
    return picked.where(F.col("document").isNull()).select(key, "strategy_name", F.element_at("warnings", -1)["message"].alias("message"))


def documents(picked: DataFrame, overrides: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The documents of the picked attempts, with their settings' fields. Warnings are those of the
    attempt: an override doesn't change them. Pages that no strategy could read are left out, and are
    what ``failures`` gives; if strict, the first of them fails the job with its message."""
    if strict:
        message = F.concat(F.lit("no strategy could read the page: "), F.element_at("warnings", -1)["message"])
        picked = picked.withColumn("document", F.coalesce("document", F.raise_error(message).cast(picked.schema["document"].dataType)))
    rows = picked.where(F.col("document").isNotNull()).select("document.*")
    return rows if overrides is None else settings.apply(rows, overrides)


def parse(pages: DataFrame, chain: Sequence[Strategy] | None = None, key: str = "slug", strategy: Strategy | None = None, strict: bool = False, **tokeniser) -> DataFrame:
    """pages(key, html, source_url) to documents, one row each."""
    return documents(pick(attempts(pages, chain, key, strategy=strategy, **tokeniser), key), settings.table(pages.sparkSession), strict)
