"""Order documents as a stream of files, merged into the same history tables as the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from custscope.plans.ingest import load_documents
from custscope.sources.documents import parse_documents


def document_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Every document of the folder, those that cannot be read too."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_documents(reader.text(folder).where(F.trim("value") != ""))


def start_ingest(documents: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merges every new file once and stops when the folder is drained.

    Progress is the stream's checkpoint and not the newest order time, so a late order is still
    loaded. Each batch is one published version with its accounts and rejects; a batch that is repeated after a failure
    is found published and left out.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        load_documents(batch.sparkSession, root, batch, incremental=False, stream=(checkpoint, batch_id))

    return (
        documents.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
