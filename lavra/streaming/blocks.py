"""Documents as they arrive: a file stream of plain text into blocks and running route counts.

Documents are self-contained, so a batch needs no state of earlier ones; counts over all
batches are an aggregation Spark keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quotation import analyse
from ..operators.routing import census, route
from ..sources.readers import decoded, txt_blocks


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of every text file that turns up below the path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), decoded("content").alias("text"))


def route_batches(texts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes one row per document and its route, batch by batch; a batch that is repeated replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows = route(census(analyse(txt_blocks(batch)))).select("doc_id", "route", "confidence")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
