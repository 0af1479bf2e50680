"""Writing masked texts and detection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions import text as T


def write_texts(masked: DataFrame, path: str, key: str = "doc_id", text: str = "masked") -> None:
    """A folder ``<key>=<value>`` for each document with its text as UTF-8. Documents
    with an empty or blank text are left out. Any store that Spark writes to."""
    filled = masked.where(T.strip(F.col(text)) != "")
    filled.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def write_table(masked: DataFrame, path: str) -> None:
    """All columns as Parquet: the sink for many documents, where a folder each is too many."""
    masked.write.mode("overwrite").parquet(path)


def append_log(reports: DataFrame, path: str, key: str | None = None, report: str = "report") -> None:
    """Append report sections (see ``results.detection_report``) as text, with ``key`` in a
    folder of its own for each document, so that a document's log can be read alone."""
    rows = reports.select(*([key] if key else []), F.col(report).alias("value"))
    writer = rows.write.mode("append")
    (writer.partitionBy(key) if key else writer).text(path)
