"""What an index embeds: chunks, summaries, concepts, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_text
from ..sources.folders import shared_folder


def embedding_items(chunks: DataFrame, summaries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(kind, ref, paper_id, text, kind_pos, a, b): kind_pos, a, b give the order; see numbered().

    chunks: id, paper_id, idx, text, corpus_pos. summaries: paper_id, text, corpus_pos. concepts: id,
    canonical_name, aliases, description, pos.
    """
    none = F.lit(None).cast("bigint")
    return (
        chunks.select(F.lit("chunk").alias("kind"), F.col("id").alias("ref"), F.col("paper_id").cast("bigint"), "text", F.lit(0).alias("kind_pos"), F.col("corpus_pos").cast("bigint").alias("a"), F.col("idx").cast("bigint").alias("b"))
        .unionByName(summaries.select(F.lit("summary").alias("kind"), F.col("paper_id").cast("string").alias("ref"), F.col("paper_id").cast("bigint"), "text", F.lit(1).alias("kind_pos"), F.col("corpus_pos").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
        .unionByName(concepts.select(F.lit("concept").alias("kind"), F.col("id").alias("ref"), none.alias("paper_id"), concept_text(F.col("canonical_name"), F.col("aliases"), F.col("description")).alias("text"), F.lit(2).alias("kind_pos"), F.col("pos").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    )


def numbered(items: DataFrame) -> DataFrame:
    """Adds row_idx from 0 in item order, without gathering all rows in one task.

    Range partitions are numbered within and offset by the sizes of those before. Their bounds are drawn from a
    sample, so the partitioned rows are written once to the shared folder and counted and read from there.
    """
    spark = items.sparkSession
    path = shared_folder(spark, "items")
    order = ("kind_pos", "a", "b")
    ordered = items.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).write.parquet(path)
    within = spark.read.parquet(path)
    sizes = within.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return within.join(F.broadcast(starts), "_part").withColumn("row_idx", F.col("_n") + F.col("_start") - 1).drop("_part", "_n", "_start", *order)
