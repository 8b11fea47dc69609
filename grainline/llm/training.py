"""Labelled rows for the classifiers: a bounded, repeatable sample without the held-out fifth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Every fifth document by the CRC-32 of its id as text is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``rows`` labelled documents of at most ``max_bytes``.

    Ids are taken in order of their MD5, of those that have such a document, so reruns
    agree and no source is preferred. Of rows that repeat an id the least text is
    taken. ``rows * max_bytes`` bounds what the driver holds; the chosen ids, at most
    ``rows``, are what is broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
    once = known.groupBy("doc_id").agg(F.max(label).alias("_label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = once.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").cast("int").alias("_label"))
    table = found.toArrow().combine_chunks().sort_by("doc_id")
    column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column, np.asarray(table.column("_label"), dtype=np.int64)
