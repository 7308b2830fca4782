"""Scores of an exact term in a document, from its frequency and the term's document frequency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (frequency in the document, documents with the term, documents) -> score
ScoreFunction = Callable[[Column, Column, Column], Column]


def tf_idf(tf: Column, df: Column, n: Column) -> Column:
    return (F.log(1 + tf) * (F.log((n + 1.0) / (df + 1.0)) + 1)).cast("float")


def no_score(tf: Column, df: Column, n: Column) -> Column:
    return F.lit(0.0).cast("float")


def term_frequency(tf: Column, df: Column, n: Column) -> Column:
    return tf.cast("float")
