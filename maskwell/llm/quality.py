"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm._text import _FOLDED, PIECE, SPACE, _hash_spans, row_slices, utf8, word_spans

SAMPLE = 4000
THRESHOLD = 0.3
ROUNDS = 150

#: Byte classes that a line's bytes are counted by.
CLASSES = ("upper", "digit", "space", "bang", "bar", "symbol", "punctuation")
_OF = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "bang": b"!",
    "bar": b"|",
    "symbol": b"*#$%&@^~=<>_\\+",
    "punctuation": b".,;:?'\"()-/[]{}",
}
_MEMBER = np.zeros((len(CLASSES), 256), np.uint8)
for _i, _name in enumerate(CLASSES):
    _MEMBER[_i, list(_OF[_name])] = 1
N_OWN = len(CLASSES) + 5
N_FEATURES = 3 * N_OWN + 1


@dataclass(frozen=True)
class QualityModel:
    """Field weights, transition scores [from, to] and the calibration of a document's mean marginal."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float
    base: float


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Slices of whole rows; a very long row is cut behind line ends, else behind spaces."""
    for i, j in row_slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * PIECE:
            yield data[lo:hi], offsets[i : j + 1] - lo, i
            continue
        while lo < hi:
            end = min(hi, lo + PIECE)
            while end < hi:
                piece = data[lo:end]
                at = np.flatnonzero(piece == 10)
                at = at if len(at) else np.flatnonzero(SPACE[piece])
                if len(at):
                    end = lo + int(at[-1]) + 1
                    break
                end = min(hi, end + PIECE)
            yield data[lo:end], np.array([0, end - lo]), i
            lo = end


def _line_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty lines: sums (bytes of each class, repeated words, words, bytes),
    first and last word's hash, row, and whether the line reaches the end of its row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[row + 1])
    keep = ends > starts
    starts, ends, row = starts[keep], ends[keep], row[keep]
    c = len(CLASSES)
    sums, edge = np.zeros((len(starts), c + 3), np.int64), np.zeros((len(starts), 2), np.uint64)
    if not len(starts):
        return sums, edge, row, np.zeros(0, bool)
    for k in range(c):
        sums[:, k] = np.add.reduceat(_MEMBER[k][data], starts, dtype=np.int64)
    word_starts, word_ends = word_spans(data, offsets)
    words = _hash_spans(data, word_starts, word_ends, _FOLDED) if len(word_starts) else np.empty(0, np.uint64)
    line = np.maximum(np.searchsorted(starts, word_starts, "right") - 1, 0)
    again = np.flatnonzero((words[1:] == words[:-1]) & (line[1:] == line[:-1])) + 1
    sums[:, c] = np.bincount(line[again], minlength=len(starts))
    sums[:, c + 1] = np.bincount(line, minlength=len(starts))
    sums[:, c + 2] = ends - starts
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(line)) - 1 if len(line) else first
    edge[line[first], 0], edge[line[first], 1] = words[first], words[last]
    return sums, edge, row, ends == offsets[row + 1]


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and rows of all pieces' lines; a line cut by a piece's end becomes one again."""
    c = len(CLASSES)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = None
    for sums, edge, row, last in parts:
        if not len(row):
            continue
        if held is not None and held[2] == row[0]:
            old, old_edge = held[0], held[1]
            twice = old[c + 1] and sums[0, c + 1] and old_edge[1] == edge[0, 0]
            sums[0] += old
            sums[0, c] += bool(twice)
            if not (sums[0, c + 1] - old[c + 1]):
                edge[0] = old_edge
            elif old[c + 1]:
                edge[0, 0] = old_edge[0]
            out[-1] = (out[-1][0][:-1], out[-1][1][:-1])
        out.append((sums, row))
        held = (sums[-1], edge[-1], row[-1]) if last[-1] else None
    if not out:
        return np.zeros((0, c + 3), np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all non-empty lines of the texts, in order: own features, bytes, row. A line's
    features come from sums over its bytes, so a long line is one line."""
    data, offsets = utf8(column)
    sums, row = _joined([(s, e, r + first, last) for piece, at, first in _cuts(data, offsets) for s, e, r, last in [_line_sums(piece, at)]])
    c = len(CLASSES)
    size, n_words, out = sums[:, c + 2], sums[:, c + 1], np.empty((len(row), N_OWN), np.float32)
    # spread the shares: what matters are the first few hundredths
    out[:, :c] = np.sqrt(sums[:, :c] / np.maximum(size, 1)[:, None]) * 3
    out[:, c] = np.sqrt(sums[:, c] / np.maximum(n_words, 1)) * 3
    out[:, c + 1] = np.log1p(size) / 4
    out[:, c + 2] = np.log1p(n_words) / 4
    out[:, c + 3] = np.minimum(size / np.maximum(n_words, 1), 40) / 8
    out[:, c + 4] = 1
    return out, size, row


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features of each line, of the line before and of the one after (zeros at a document's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], axis=1)


class Chains:
    """Lines of documents laid out so that one step works on all documents still running."""

    def __init__(self, row: np.ndarray):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(row)))
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        self.running = len(starts) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")

    def log_odds(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward messages (with the line's own score) and backward messages, as
        log-odds of good over bad. The odds form of forward-backward needs no scaling."""
        ahead, back = unary.copy(), np.zeros_like(unary)
        for t in range(1, len(self.running)):
            at = self.starts[: self.running[t]] + t
            r = ahead[at - 1]
            ahead[at] += np.logaddexp(r + trans[1, 1], trans[0, 1]) - np.logaddexp(r + trans[1, 0], trans[0, 0])
        for t in range(len(self.running) - 1, 0, -1):
            at = self.starts[: self.running[t]] + t
            r = unary[at] + back[at]
            back[at - 1] = np.logaddexp(r + trans[1, 1], trans[1, 0]) - np.logaddexp(r + trans[0, 1], trans[0, 0])
        return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def marginals(own: np.ndarray, row: np.ndarray, model: QualityModel) -> np.ndarray:
    unary = with_neighbours(own, row).astype(np.float64) @ model.weights
    ahead, back = Chains(row).log_odds(unary, model.transitions)
    return _sigmoid(ahead + back)


def _gather(p: np.ndarray, size: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean marginal of each document; NaN without lines."""
    total, weight = np.zeros(n), np.zeros(n)
    np.add.at(total, row, p * size)
    np.add.at(weight, row, size)
    with np.errstate(invalid="ignore"):
        return total / weight


def _adam(gradient, at: np.ndarray, rounds: int, rate: float = 0.1) -> np.ndarray:
    m, v = np.zeros_like(at), np.zeros_like(at)
    for i in range(1, rounds + 1):
        g = gradient(at)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        at = at + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return at


def fit(own: np.ndarray, size: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> QualityModel:
    """Fit on the lines of documents labelled ``good`` (one bool for each row number).

    Labels are of documents: a line classifier is fitted on them first, lines
    of bad documents that it holds for good are relabelled, and the field is
    fitted on the lines' labels (conditional likelihood, L2).
    """
    base = float(np.clip(good.mean(), 0.01, 0.99)) if len(good) else 0.5
    none = QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))), base)
    if good.all() or not good.any() or not len(row):
        return none
    x = with_neighbours(own, row).astype(np.float64)
    y = good[row].astype(np.float64)
    weight = size / size.mean()
    weight = np.minimum(weight, 5)

    def line_gradient(w):
        return x.T @ ((y - _sigmoid(x @ w)) * weight) / weight.sum() - 1e-4 * w

    w = _adam(line_gradient, np.zeros(N_FEATURES), rounds)
    y = np.where(good[row], 1.0, (_sigmoid(x @ w) >= 0.5).astype(float))
    chains = Chains(row)
    inner = np.flatnonzero(row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[inner] == a) & (y[inner + 1] == b)).sum()

    def field_gradient(theta):
        w, trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        unary = x @ w
        ahead, back = chains.log_odds(unary, trans)
        p = _sigmoid(ahead + back)
        left, right = ahead[inner], unary[inner + 1] + back[inner + 1]
        joint = np.stack([np.broadcast_to(trans[a, b] + a * left + b * right, left.shape) for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0, initial=0.0)) if joint.size else joint
        joint = joint / joint.sum(axis=0)
        pairs = seen.ravel() - joint.sum(axis=1)
        n = max(1, len(y))
        return np.concatenate([x.T @ (y - p) / n - 1e-3 * w, pairs / n - 1e-3 * trans.ravel()])

    theta = _adam(field_gradient, np.concatenate([w, np.zeros(4)]), rounds, 0.05)
    model = QualityModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), 1.0, 0.0, base)
    mean = _gather(marginals(own, row, model), size, row, len(good))
    ok = ~np.isnan(mean)
    z, label = _stretch(mean[ok]), good[ok].astype(float)
    z1 = np.stack([z, np.ones_like(z)], axis=1)

    def calibrate(c):
        return z1.T @ (label - _sigmoid(z1 @ c)) / len(label) - 1e-3 * c

    slope, offset = _adam(calibrate, np.array([1.0, 0.0]), 300, 0.05)
    return QualityModel(model.weights, model.transitions, float(slope), float(offset), base)


def _stretch(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 0.001, 0.999)
    return np.log(mean / (1 - mean)) / 2


def document_scores(column: pa.Array, model: QualityModel) -> np.ndarray:
    """Probability that each text is of good quality; texts without lines get the share of good labels."""
    n = len(column)
    own, size, row = line_features(column)
    mean = _gather(marginals(own, row, model), size, row, n) if len(row) else np.full(n, np.nan)
    empty = np.isnan(mean)
    score = _sigmoid(model.slope * _stretch(np.where(empty, 0.5, mean)) + model.offset)
    return np.where(empty, model.base, score)


def train(labelled: DataFrame, sample: int = SAMPLE, texts: DataFrame | None = None) -> QualityModel:
    """Fit on a bounded sample of ``labelled``(doc_id, text, quality): the ``sample``
    documents with the smallest hash of doc_id, whole texts. Features are made
    on the executors; the driver gets numbers for each line of the sample.
    A doc_id with both labels counts as bad. With ``texts``(doc_id, text) the
    texts are read from there, so ``labelled`` may lack them and no text is
    shuffled.
    """
    spark = labelled.sparkSession
    chosen = labelled.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(sample).collect()
    ids = spark.createDataFrame([(r.doc_id, r.q) for r in chosen], "doc_id long, q int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, size, row = line_features(batch.column(1))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([own[a:b].astype(np.float32).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array([size[a:b].astype(np.int64).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                ],
                ["doc_id", "q", "own", "size"],
            )

    texts = (labelled if texts is None else texts).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "q")
    rows = texts.mapInArrow(run, "doc_id long, q int, own binary, size binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.own)))
    own = np.concatenate([np.frombuffer(r.own, np.float32).reshape(-1, N_OWN) for r in rows] or [np.zeros((0, N_OWN), np.float32)])
    size = np.concatenate([np.frombuffer(r.size, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(rows)), [len(r.size) // 8 for r in rows]) if rows else np.zeros(0, np.int64)
    return fit(own, size, row, np.array([r.q > 0 for r in rows], bool))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, from the whole text alone.

    Null, empty or line-less text gets the share of good labels seen in
    training. Null ids and repeated rows: a row each. A model fitted on no or
    on one kind of label gives every row that share. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = document_scores(batch.column(1), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
