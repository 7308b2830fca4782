"""Append-only index maintenance with Structured Streaming.

Each micro-batch is indexed and appended below a folder of its own, so a batch that is run again
after a failure replaces its folder instead of counting twice. Reading sums document
frequencies over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.model import Schema
from quillon.operators.index import SearchIndex, build_index


def maintain_index(rows: DataFrame, schema: Schema, path: str, checkpoint: str, key: str = "doc_id", **trigger) -> StreamingQuery:
    """Index a stream of rows with unique keys below ``path``."""

    def batch(part: DataFrame, number: int) -> None:
        part.persist()
        try:
            index = build_index(part, schema, key)
            index.postings.write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings/batch={number}")
            index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        finally:
            part.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_maintained(spark: SparkSession, schema: Schema, path: str) -> SearchIndex:
    """The index of all batches so far."""
    postings = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings").drop("batch")
    docs = spark.read.option("basePath", f"{path}/docs").parquet(f"{path}/docs").drop("batch")
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    return SearchIndex(schema, postings, terms, docs, docs.count())
