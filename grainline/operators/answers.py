"""Locators, the answer cache, fallback and re-embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search

#: Version of the cached payload's fields.
CACHE_SCHEMA = 15


def location(m: Column) -> Column:
    """A reader's name for where a chunk stands, from a struct of locators (null where unknown).

    Fields: pages, page, frame, sheet, cell_range, line_start, line_end, body_index,
    row_start, row_end, section, table_index.
    """
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    pages, first, last = m["pages"], F.get(m["pages"], F.lit(0)), F.element_at(m["pages"], -1)
    line_end = F.coalesce(m["line_end"], m["line_start"])
    return (
        F.when(F.size(pages) == 1, text("p.", first))
        .when(F.size(pages) > 1, text("pp.", first, "-", last))
        .when(m["page"].isNotNull(), text("p.", m["page"]))
        .when(m["frame"].isNotNull(), text("frame ", m["frame"]))
        .when(m["sheet"].isNotNull(), F.concat(text("Sheet: ", m["sheet"]), F.coalesce(text(", ", m["cell_range"]), F.lit(""))))
        .when(m["line_start"] == line_end, text("line ", line_end))
        .when(m["line_start"].isNotNull(), text("lines ", m["line_start"], "-", line_end))
        .when(m["body_index"].isNotNull(), text("document item ", m["body_index"]))
        .when(m["row_start"].isNotNull(), text("rows ", m["row_start"], "-", F.coalesce(m["row_end"], m["row_start"])))
        .when(m["section"].isNotNull(), F.trim(F.regexp_replace(m["section"], "^[# ]+", "")))
        .when(m["table_index"].isNotNull(), text("table ", m["table_index"] + 1))
        .otherwise("")
    )


def locator_kind(source: Column, m: Column) -> Column:
    return (
        F.when(source.isin("pdf", "image"), source)
        .when(m["sheet"].isNotNull(), "spreadsheet")
        .when(m["line_start"].isNotNull(), "source_lines")
        .when(m["body_index"].isNotNull(), "document_structure")
        .when(m["row_start"].isNotNull(), "table_rows")
        .otherwise("section")
    )


def parse_metadata(raw: Column) -> Column:
    """Author, date, topics and entities of a model's JSON answer; blank where it can't be read."""
    clean = F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", "")
    found = F.from_json(clean, "author string, date string, topics array<string>, entities array<string>")
    word = lambda name: F.when(F.trim(found[name]) != "", found[name])
    many = lambda name: F.coalesce(F.filter(found[name], lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.struct(word("author").alias("author"), word("date").alias("date"), many("topics").alias("topics"), many("entities").alias("entities"))


def cache_lookup(requests: DataFrame, entries: DataFrame, threshold: float, now: Column) -> DataFrame:
    """The nearest admissible entry of each request: ``request_id, entry_id, similarity``.

    An entry answers a request of the same tenant, user, model, question, epoch,
    profile and number of results: these are compared as they are, hashes only route.
    Those that have expired, or are of another schema, don't take part; the nearest of
    the rest has to reach ``threshold``. Entries and requests of one such key meet in
    tiles and blocks, so that a question that all ask is no task of its own.
    """
    whole = F.to_json(F.struct("tenant", "user", "model", "question", "epoch", "profile", "top_k"), {"ignoreNullFields": "false"})
    open_now = entries.filter((F.col("expires_at") > now) & (F.col("schema_version") == CACHE_SCHEMA))
    found = search.nearest(
        open_now.select(F.col("entry_id").alias("chunk_id"), "vector", whole.alias("_same")), requests.select(F.col("request_id").alias("query_id"), "qvec", whole.alias("_same")), 1, _same, F.xxhash64("_same"), F.array(F.xxhash64("_same"))
    )
    return found.filter(F.col("score") >= threshold).select(F.col("query_id").alias("request_id"), F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity"))


def _same(tile: pa.RecordBatch, block: pa.RecordBatch) -> np.ndarray:
    """Which entries have a request's key, by the whole of it."""
    _, codes = np.unique(np.concatenate([t.column(2).to_numpy(zero_copy_only=False) for t in (tile, block)]).astype(str), return_inverse=True)
    return codes[tile.num_rows :, None] == codes[None, : tile.num_rows]


def falls_back(allowed: Column, status: Column, scope: Column, changed: Column) -> Column:
    """A general answer is given only if allowed, evidence is lacking, no documents were chosen
    and nothing changed meanwhile."""
    return allowed & (status == "insufficient_evidence") & scope.isNull() & ~changed


def best_window(scores: DataFrame) -> DataFrame:
    """Scores of a passage's windows -> the passage's best."""
    return scores.groupBy("query_id", "chunk_id").agg(F.max("window_score").alias("rerank_score"))


def word_windows(text: Column, size: int = 192) -> Column:
    """A passage as runs of at most ``size`` words, to be scored one by one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / size), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "))


def swap_ready(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Whether a re-embedded copy may replace a group: same number of rows and same fingerprint."""
    a, b = old.select(by, F.col("fingerprint").alias("_a"), F.col("n").alias("_n")), new.select(by, F.col("fingerprint").alias("_b"), F.col("n").alias("_m"))
    both = a.join(b, by, "full_outer")
    return both.select(by, (F.col("_a").eqNullSafe(F.col("_b")) & F.col("_n").eqNullSafe(F.col("_m"))).alias("ready"))
