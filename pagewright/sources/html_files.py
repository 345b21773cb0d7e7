"""HTML sources: folders of files, precedence between them, and the fetch rules as joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import SLUG_PATTERNS, derive_slug


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """slug and html of each file: a whole file is a row, its name without .html the slug."""
    return spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.html?)?$", 1).alias("slug"), F.col("value").alias("html"))


def preferred(first: DataFrame, second: DataFrame, key: str = "slug", value: str = "html") -> DataFrame:
    """Rows of both by key; where both have it, the first's."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value))


def allowed(urls: DataFrame, robots: DataFrame, host: str = "host") -> DataFrame:
    """URLs that robots(host, allowed) doesn't forbid; a host without an answer allows."""
    rules = robots.select(F.col("host").alias("_host"), F.col("allowed").alias("_allowed"))
    return urls.join(rules, urls[host] == rules["_host"], "left").where(F.coalesce("_allowed", F.lit(True))).drop("_host", "_allowed")


def slug_of(url: str) -> str:
    """What derive_slug gives, for one URL on the driver."""
    path = re.sub(r"[?#].*", "", re.sub(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "", url, count=1), flags=re.DOTALL) or url
    stem = path.rsplit("/", 1)[-1].removesuffix(".html").removesuffix(".htm")
    return next((m[1] for p in SLUG_PATTERNS if (m := re.match(p, stem))), stem)


def fetch(urls: list[str], folder: str, get, allows, pause=1.0, slug: str | None = None) -> list[tuple[str, str]]:
    """One URL after another into folder/slug.html (its own slug, if one is given) by the caller's get(url) -> bytes, at least
    ``pause`` seconds apart, where allows(url) isn't False; gives (url, fault) of those that failed.
    Runs on the driver: a rate limit leaves nothing to distribute."""
    import time
    from pathlib import Path

    failed, last = [], None
    for url in urls:
        if last is not None:
            time.sleep(max(0.0, last + pause - time.monotonic()))
        last = time.monotonic()
        try:
            if allows(url) is False:
                raise PermissionError(f"robots.txt disallows {url}")
            Path(folder).mkdir(parents=True, exist_ok=True)
            Path(folder, f"{slug or slug_of(url)}.html").write_bytes(get(url))
        except Exception as fault:  # noqa: BLE001  a failed URL is a result
            failed.append((url, str(fault)))
    return failed


def slugs(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumn("slug", derive_slug(F.col(url)))
