"""Pages as a stream: an extension for corpora that grow, over the batch operators.

Chunking works within a page, so it needs no state; only repeated deliveries do, and these are dropped by key
within a watermark. Chunk ids count over a whole paper and so are given per page here: paper:page.n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import DEFAULT_MAX_TOKENS, blocks, fitted, packed

PAGE = "paper_id bigint, page int, text string, loaded_at timestamp"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(pages: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, lateness: str = "30 days") -> DataFrame:
    """(id, paper_id, page, text) of each page's chunks; a page delivered again within the lateness is dropped."""
    most = F.lit(max_tokens)
    once = pages.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["paper_id", "page"])
    cut = once.where("text is not null").select("paper_id", "page", F.posexplode(packed(fitted(blocks(F.col("text")), most), most)).alias("n", "text"))
    return cut.select(F.concat(F.col("paper_id").cast("string"), F.lit(":"), F.col("page").cast("string"), F.lit("."), F.col("n").cast("string")).alias("id"), "paper_id", "page", "text")


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to parquet, each batch exactly once, until what is there is done."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
