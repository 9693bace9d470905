"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm._common import held_out, narrow


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled, not held-out ids, by a hash of the id.

    An id labelled more than once counts by the mean of its labels (a half counts as 1); ids and
    labels that are null are left out. ``docs`` may hold more columns; they come along.
    """
    chosen = (
        narrow(labels, "doc_id", column)
        .filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.join(F.broadcast(chosen), "doc_id")  # ``bound`` rows at most
