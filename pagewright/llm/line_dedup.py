"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line, the pages of the host that contain it are divided by the
host's number of pages; lines above the boilerplate ratio are dropped from every page of that host.

Lines are counted as 128-bit hashes with a partial aggregation before the only exchange, so a hot
host or a very common line is summed on the map side. What comes back is one row a host with the
hashes of its boilerplate lines: at most (mean lines a page) / ratio of them, whatever the number of
pages. Pages then drop lines in a projection, without being shuffled where that table is small.

Blank lines are kept and not counted. A null text stays null; a null host is a host of its own. A
host with fewer than min_pages pages holding a line keeps it, and so does one where the line's part is
just the ratio. Repeated rows count as pages; a page's equal lines count once and go together. Texts of
any length are taken whole. An empty table gives an empty result. Columns of other names pass through;
those named in ADDED are taken away or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: A line on a larger part of a host's pages is boilerplate, if on so many pages at least.
RATIO, MIN_PAGES = 0.05, 10

#: Names that the operator uses for its columns.
ADDED = ("n_lines", "n_dropped", "host_key", "boiler", "_host", "_kept", "_salt")

#: Parts of a host's pages where the table of hosts is too large to broadcast.
SALTS = 64


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), line).alias("a"), F.xxhash64(F.lit(2), line).alias("b"))


def filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """host_key, boiler: the hashes of each host's boilerplate lines. Hosts without any are absent."""
    keyed = pages.select(F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("host_key"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), filled), line_hash))
    totals = keyed.groupBy("host_key").agg(F.count("*").alias("pages"))
    counts = keyed.select("host_key", F.explode(lines).alias("line")).groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return (
        counts.join(totals, "host_key")
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host_key")
        .agg(F.sort_array(F.collect_list("line")).alias("boiler"))
    )


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of pages with boilerplate lines taken out of text, and n_lines and n_dropped
    added: lines that aren't blank, and those dropped. All other columns are as they were."""
    pages = pages.drop(*ADDED)
    found = written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    keyed = pages.withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")))
    if small(found):
        joined = keyed.join(F.broadcast(found), keyed["_host"] == found["host_key"], "left")
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, (keyed["_host"] == salted["host_key"]) & (keyed["_salt"] == salted["_salt"]), "left").drop("_salt")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("boiler").isNull(), lines).otherwise(F.filter(lines, lambda x: ~filled(x) | ~F.array_contains("boiler", line_hash(x))))
    count = lambda a: F.coalesce(F.size(F.filter(a, filled)), F.lit(0)).cast("long")
    return (
        joined.withColumn("_kept", kept)
        .withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(count(lines)), "n_dropped": F.when(F.col(text).isNull() | F.col("boiler").isNull(), 0).otherwise(count(lines) - count(F.col("_kept")))})
        .withColumn(text, F.when(F.col("boiler").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")))
        .drop("_kept", "_host", "host_key", "boiler")
    )
