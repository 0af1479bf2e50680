"""Masking of streams: detection is one narrow pass for each document, so it has no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators import recognize


def mask_stream(docs: DataFrame, entities: list[str] | None = None, text: str = "text") -> DataFrame:
    """A stream of documents with ``masked`` and ``n_entities``; append mode, nothing kept between batches."""
    return recognize.mask(docs, entities, text).drop("spans")


def windowed_counts(docs: DataFrame, ts: str, window: str = "10 minutes", late: str = "1 hour", entities: list[str] | None = None, text: str = "text") -> DataFrame:
    """window_start, entity, n: spans of each type in each window of event time. Windows older
    than the watermark close, so the state is bounded by types and open windows."""
    found = recognize.detect(docs.withWatermark(ts, late), entities, text)
    rows = recognize.explode_spans(found, ts)
    return rows.groupBy(F.window(ts, window).alias("w"), "entity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "entity", "n")
