"""Saving an index and loading it in another application.

``postings`` is partitioned by field and dealt in ranges of terms, so that a term, prefix or range
predicate prunes folders, files and row groups; ``meta`` holds a version, the schema, the number of
documents and each field's kind, which a reader may insist on.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.model import Schema, SearchError
from quillon.operators.index import SearchIndex, postings_of

VERSION = 1


def kinds(schema: Schema) -> dict[str, str]:
    return {f.name: "positional" if f.positions else "frequency" for f in schema.fields}


def write_postings(index: SearchIndex, path: str) -> None:
    n = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # doc_id is in the range so that a term of a third of all documents is split too
    dealt = lambda rows: rows.repartitionByRange(n, "field", "term", "doc_id")
    # tokens are dealt before they are grouped: one exchange, and only they are read to find the ranges
    postings = dealt(index.postings) if index.tokens is None else postings_of(dealt(index.tokens), index.schema)
    postings.sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")


def write_meta(spark: SparkSession, schema: Schema, num_docs: int, path: str) -> None:
    meta = {"version": VERSION, "schema": json.loads(schema.to_json()), "num_docs": num_docs, "kinds": kinds(schema)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def save_index(index: SearchIndex, path: str) -> None:
    spark = index.postings.sparkSession
    write_postings(index, path)
    spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    write_meta(spark, index.schema, index.num_docs, path)


def load_index(spark: SparkSession, path: str, expect: dict[str, str] | None = None) -> SearchIndex:
    """The index under ``path``; :class:`SearchError` if its version or a field's kind is another."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta["version"] != VERSION:
        raise SearchError(f"index version {meta['version']}, expected {VERSION}")
    for name, kind in (expect or {}).items():
        if meta["kinds"].get(name) != kind:
            raise SearchError(f"field '{name}' is {meta['kinds'].get(name)}, expected {kind}")
    read = lambda what: spark.read.parquet(f"{path}/{what}")
    return SearchIndex(Schema.from_json(json.dumps(meta["schema"])), read("postings"), read("terms"), read("docs"), meta["num_docs"])
