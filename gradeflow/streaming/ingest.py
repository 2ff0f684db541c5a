"""Incremental ingest of documents, and publication of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunking import narrative_chunks
from ..operators.lines import remove_toc, to_lines


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (doc_id, text) of text files as they arrive; the id is the path."""
    return spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def _logged(same: DataFrame, log: str) -> bool:
    try:
        return not same.intersect(same.sparkSession.read.parquet(log).select(same.columns)).isEmpty()
    except AnalysisException:
        return False


def ingest(texts: DataFrame, chunks: str, status: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Prepares and chunks arriving documents with the batch operators and appends them, with a status row per document.

    Tables are partitioned by the batch's number and a batch overwrites its own partition, so one that runs again adds nothing
    twice. The last table that a batch writes is a log (batch, n_docs, digest), with a sum over its documents' digests; a batch
    that is logged with the digest that it has now is left as it is.
    """
    cut = prepare or (lambda docs: narrative_chunks(remove_toc(to_lines(docs))))

    log = f"{status}-log"

    def run(batch: DataFrame, number: int) -> None:
        same = batch.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("digest")).withColumn("batch", F.lit(number))
        if _logged(same, log):
            return
        out = cut(batch).withColumn("batch", F.lit(number))
        write = lambda df, path: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        write(out, chunks)
        made = batch.sparkSession.read.parquet(chunks).where(F.col("batch") == number).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        write(batch.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(3).alias("state"), F.lit(number).alias("batch")), status)
        write(same, log)

    return texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(messages: DataFrame, checkpoint: str, path: str | None = None, kafka: dict[str, str] | None = None) -> StreamingQuery:
    """A stream of (value) to Kafka, if options are given, else to text files."""
    writer = messages.select(F.col("value").cast("string")).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if kafka:
        return writer.format("kafka").options(**kafka).start()
    return writer.format("text").start(path)
