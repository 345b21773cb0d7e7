"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many points (virtual nodes) on a ring of 64-bit hashes; a key belongs to the next
point clockwise. No shard takes more than ``load_factor`` times its fair share of bytes: what finds
its shard full goes on clockwise to the next shard that has room, so balance is guaranteed and few
keys move when the number of shards changes.

The ring is cut into cells (2 ** cell_bits arcs of equal length). Only sums per cell are planned, a
table whose size depends on cell_bits alone; rows then take their cell's shard. Groups of equal
texts are spread like any other rows, as the key is the doc_id. Every step is a DataFrame operation.

A null text has size 1. Rows without a key are spread by a hash of their text; repeated rows share
a cell. An empty table gives an empty result. Columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

VIRTUAL_NODES = 128


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """The points: shard and place, a 64-bit hash shifted to be unsigned in order."""
    shards = spark.range(n_shards).withColumnRenamed("id", "shard")
    nodes = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("node"))
    return nodes.select(F.col("shard").cast("int").alias("shard"), F.xxhash64(F.lit("node"), "shard", "node").alias("place"))


def cell_of(key: Column, cell_bits: int) -> Column:
    """The arc of the ring that a key's hash falls into."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("key"), key), 64 - cell_bits).cast("int")


def preferences(spark: SparkSession, n_shards: int, cell_bits: int, virtual_nodes: int) -> DataFrame:
    """For every cell: its shards in clockwise order of their next point. One row a cell."""
    cells = spark.range(1 << cell_bits, numPartitions=1).select(F.col("id").cast("int").alias("cell"))
    points = ring(spark, n_shards, virtual_nodes).withColumn("cell", F.shiftrightunsigned("place", 64 - cell_bits).cast("int"))
    first = points.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(F.shiftrightunsigned("place", 1).alias("at"), "shard"))).alias("here"))
    # The next point of each shard at or after a cell: a fill from the right, twice round.
    twice = cells.join(first, "cell", "left").select(F.explode(F.array(F.col("cell"), F.col("cell") + (1 << cell_bits))).alias("turn"), "here")
    ahead = Window.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def spot(s: int) -> Column:
        own = F.filter("here", lambda p: p["shard"] == s)
        return F.last(F.when(F.size(own) > 0, F.struct(F.col("turn"), F.try_element_at(own, F.lit(1))["at"].alias("at"), F.lit(s).alias("shard"))), True).over(ahead)

    return (
        twice.withColumn("spots", F.sort_array(F.array(*map(spot, range(n_shards)))))
        .where(F.col("turn") < (1 << cell_bits))
        .select(F.col("turn").alias("cell"), F.transform("spots", lambda p: p["shard"]).alias("order"))
    )


def plan(cells: DataFrame, n_shards: int, load_factor: float, cell_bits: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """cells(cell, size, n) -> cell, shard, n. In each round every cell without a place asks its
    next shard clockwise, which admits cells in order of the ring while they fit."""
    spark = cells.sparkSession
    shared_dir(spark)
    total, largest = cells.agg(F.sum("size"), F.max("size")).first()
    fair = -(-(total or 0) // n_shards)
    waiting = cells.join(preferences(spark, n_shards, cell_bits, virtual_nodes), "cell").checkpoint()
    loads = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))
    placed: DataFrame | None = None
    # On the second turn the bound is wider by a cell, so that no cell finds every shard full.
    for limit in (int(fair * load_factor), int(fair * load_factor) + (largest or 0)):
        for turn in range(n_shards):
            asked = waiting.withColumn("shard", F.element_at("order", turn + 1)).join(F.broadcast(loads), "shard")
            inside = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            tried = asked.withColumn("fits", F.col("load") + F.sum("size").over(inside) <= limit).drop("load").checkpoint()
            admitted = tried.where("fits").select("cell", "shard", "size", "n")
            placed = admitted if placed is None else placed.unionAll(admitted)
            waiting = tried.where("not fits").select("cell", "size", "n", "order")
            if waiting.isEmpty():
                return placed
            gained = admitted.groupBy("shard").agg(F.sum("size").alias("gain"))
            loads = loads.join(F.broadcast(gained), "shard", "left").select("shard", (F.col("load") + F.coalesce("gain", F.lit(0))).alias("load")).checkpoint()
    raise AssertionError("every cell has a place after the second turn")


def shard(docs: DataFrame, n_shards: int, size: Column, key: str = "doc_id", text: str = "text", load_factor: float = 1.001, cell_bits: int = 16) -> DataFrame:
    """Adds size, shard and slot (gapless from 0 in each shard) to the rows of docs.

    The plan holds 2 ** cell_bits rows at most and is broadcast; the only exchange of documents'
    rows numbers them within their cells, which hold one row in 2 ** cell_bits on average.
    """
    rows = docs.withColumn("size", size).drop("shard", "slot", "_cell", "_first").withColumn("_cell", cell_of(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.coalesce(F.xxhash64(text).cast("string"), F.lit("")))), cell_bits))
    cells = rows.groupBy(F.col("_cell").alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).checkpoint()
    placed = plan(cells, n_shards, load_factor, cell_bits)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.select(F.col("cell").alias("_cell"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")).checkpoint()
    within = Window.partitionBy("_cell").orderBy(key)
    return (
        rows.withColumn("slot", F.row_number().over(within) - 1)
        .join(F.broadcast(slots), "_cell")
        .withColumn("slot", (F.col("slot") + F.col("_first")).cast("long"))
        .drop("_cell", "_first")
    )
