"""SQL over parsed documents: temporary views of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(documents: DataFrame, attempts: DataFrame | None = None, prefix: str = "") -> None:
    """Views documents, paragraphs and footnotes, and attempts and warnings if they are given."""
    documents.createOrReplaceTempView(f"{prefix}documents")
    for name in ("paragraphs", "footnotes"):
        documents.select("title_slug", F.posexplode(name).alias("pos", "x")).select("title_slug", "pos", "x.*").createOrReplaceTempView(f"{prefix}{name}")
    if attempts is not None:
        attempts.createOrReplaceTempView(f"{prefix}attempts")
        attempts.select("slug", "strategy_name", F.posexplode("warnings").alias("check_ord", "w")).select("slug", "strategy_name", "check_ord", "w.*").createOrReplaceTempView(f"{prefix}warnings")
