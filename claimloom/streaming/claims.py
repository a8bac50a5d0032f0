"""Claims from a stream of documents, and append-only logs.

Extraction is stateless per document, so the batch plan runs on a stream as it
is; a file of documents is read once, and a restarted query goes on where its
checkpoint ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.claims import extract_claims

DOCUMENTS = "doc_id long, text string, source string, published_at timestamp, ingested_at timestamp"


def read_documents(spark: SparkSession, path: str, files_at_once: int = 16, glob: str = "*.parquet") -> DataFrame:
    """The documents of the files under a folder, those there and those that come."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", glob).parquet(path)


def claim_stream(documents: DataFrame) -> DataFrame:
    """Claims of a stream of documents(doc_id, text, ingested_at)."""
    return extract_claims(documents.withColumn("chunk_id", F.col("doc_id")), "doc_id", "chunk_id", "text", keep=("ingested_at",))


def hourly_counts(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """Claims by hour of arrival and type; hours close once the watermark has passed them."""
    return claims.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 hour"), "claim_type").agg(F.count(F.lit(1)).alias("n"))


def write_claims(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append claims to a table until the files present are read."""
    return claims.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows as JSON lines, a folder for each batch, so that a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
