"""An extension: a folder of HTML files as a stream. Documents don't depend on each other, so each
micro-batch runs the batch plan and there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.plans import overrides, parse


def source(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """slug, html and source_url of new files; files_per_trigger bounds a batch."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.html?)?$", 1).alias("slug"), F.col("value").alias("html"), F.lit(None).cast("string").alias("source_url"))


def start(pages: DataFrame, target: str, checkpoint: str, **tokeniser) -> StreamingQuery:
    """Parsed documents as Parquet under target, a folder for each batch: a batch that is run again
    replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        found = parse.pick(parse.attempts(batch, **tokeniser))
        try:
            parse.documents(found, overrides.table(batch.sparkSession)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            parse.release()

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
