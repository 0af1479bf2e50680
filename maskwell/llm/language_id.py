"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (2, 3)
SAMPLE_PER_LANGUAGE = 2000
MOST_LANGUAGES = 256
SMOOTHING = 0.5
CHARS = 1 << 19
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities by language and bucket; at most MOST_LANGUAGES x BUCKETS values."""

    languages: tuple[str, ...]
    log_probs: np.ndarray
    log_priors: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts in bounded pieces: (points, starts, row of
    each start, does the text go on). A text longer than a piece goes on in the
    next one, from the last characters on, so that each n-gram is seen once."""
    points, starts, rows, more, size = [], [], [], [], 0
    back = max(ORDERS) - 1
    for row, text in enumerate(texts):
        if not text:
            continue
        text = f" {text.lower()} "
        for at in range(0, max(1, len(text) - back), CHARS):
            part = np.frombuffer(text[at : at + CHARS + back].encode("utf-32-le", "surrogatepass"), np.uint32)
            points.append(part)
            starts.append(size)
            rows.append(row)
            more.append(at + CHARS < len(text) - back)
            size += len(part)
            if size >= CHARS:
                yield np.concatenate(points), np.array(starts), np.array(rows), np.array(more)
                points, starts, rows, more, size = [], [], [], [], 0
    if size:
        yield np.concatenate(points), np.array(starts), np.array(rows), np.array(more)


def _features(points: np.ndarray, starts: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: bucket of the n-gram at every position, and which
    positions are whole n-grams of one text. A piece whose text goes on ends with
    the characters that the next one begins with; n-grams that start there are
    counted in the next one, for all orders."""
    n = len(points)
    ends = np.append(starts[1:], n)
    back = max(ORDERS) - 1
    for order in ORDERS:
        whole = np.zeros(n + 1, np.int32)
        stop = np.maximum(starts, ends - np.where(more, back, order - 1))
        np.add.at(whole, starts, 1)
        np.add.at(whole, stop, -1)
        mask = np.cumsum(whole[:-1]) > 0
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint32)
            for i in range(order):
                h[: n - i] += (points[i:] if i else points) * _MULTIPLIERS[i]
            h += np.uint32(order)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        yield h >> np.uint32(16), mask


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on ``labelled``(doc_id, text, lang): of each language, the whole texts of
    the ``per_language`` rows with the smallest hash of doc_id.

    The bound on the sample is a parameter. A histogram of the hash's upper bits
    gives the range that holds these rows, so that only they and the rest of
    the last bin are ranked in one place, however common a language is. Where
    ``lang`` has more than MOST_LANGUAGES values, those with most rows are learned
    (ties: the first by name), which bounds the model that is broadcast.
    Counting runs on the executors; the driver gets one count for each language
    and bucket.
    """
    key = F.xxhash64(F.col("doc_id"), F.lit(5))
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", key.alias("key"), F.shiftright(key, 48).alias("bin"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = rows.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    last = bins.groupBy("lang").agg(F.max(F.when(F.col("before") < per_language, F.col("bin"))).alias("last"), F.sum("n").alias("n"))
    last = last.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not last:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    ranges = labelled.sparkSession.createDataFrame([(r.lang, r.last) for r in last], "lang string, last long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    near = rows.join(F.broadcast(ranges), "lang").where("bin <= last").withColumn("r", rank)
    ids = near.where(F.col("r") <= per_language).select("doc_id", "lang").collect()
    names = sorted({r.lang for r in ids})
    code = {name: i for i, name in enumerate(names)}
    wanted = labelled.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in ids], "doc_id long, lang string").distinct()
    sample = labelled.join(F.broadcast(wanted), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for points, starts, rows, more in _pieces(batch.column(0).to_pylist()):
                ends = np.append(starts[1:], len(points))
                owner = np.repeat([code[langs[r]] for r in rows], ends - starts)
                for bucket, mask in _features(points, starts, more):
                    for c in set(owner.tolist() if len(rows) == 1 else [code[langs[r]] for r in rows]):
                        mine = np.bincount(bucket[mask & (owner == c)], minlength=BUCKETS)
                        counts[c] = counts.get(c, 0) + mine
        for c, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(mine[at], pa.int64())], ["c", "bucket", "n"]
            )

    rows = sample.select("text", "lang").mapInArrow(run, "c int, bucket int, n long").groupBy("c", "bucket").agg(F.sum("n").alias("n"))
    counted = rows.toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[counted.c, counted.bucket] = counted.n
    counts += SMOOTHING
    return LanguageModel(
        tuple(names),
        np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32),
        np.full(len(names), -np.log(len(names))),
    )


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    n, m = len(texts), len(model.languages)
    if not m:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.tile(model.log_priors, (n, 1))
    for points, starts, rows, more in _pieces(texts):
        for bucket, mask in _features(points, starts, more):
            for c in range(m):
                np.add.at(total[:, c], rows, np.add.reduceat(model.log_probs[c][bucket] * mask, starts, dtype=np.float64))
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    lettered = np.array([any(map(str.isalpha, t)) if t else False for t in texts], bool)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the whole text alone.

    Null or empty text and text without a letter: ``und``, 0. An unfitted model
    (no labelled rows): ``und``, 0 for all. Ties go to the language that sorts
    first. Repeated rows and null ids each get their own row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = score_texts(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def filter_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Rows whose language is known with at least ``least`` posterior; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = score_texts(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
