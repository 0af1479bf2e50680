"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm._shared import drop_path, materialize
from maskwell.llm._text import _FOLDED, NOT_ALNUM, PIECE, U64, _hash_spans, mix, random_u64, row_slices, utf8

#: Fixed masks of five compared words; 0 ignores a position.
MASKS = ("11111", "111101", "110111", "1101101", "1011011", "11100101")
#: Masks for items of at most SHORT words only: a substitution in these leaves no seed of five words.
SHORT_MASKS = ("1111", "11011", "10111", "11101", "110101", "101011")
SHORT = 10
SIMILARITY = 0.8
WINDOW = 20
SHIFT = 8
BLOCK_WORDS = 1_000_000
#: Alignments and words that are looked at in one numpy step.
STEP = 1 << 21
#: Alignments that are held at once.
MOST = 1 << 23


@dataclass(frozen=True)
class Probe:
    """Seeds of a block of test items, sorted by hash; at most BLOCK_WORDS words and one item.

    ``present`` is a bit table of the seeds' upper bits. A word takes about 100 bytes in all.
    """

    item_ids: list
    words: np.ndarray
    offsets: np.ndarray
    word_item: np.ndarray
    seeds: np.ndarray
    seed_word: np.ndarray
    present: np.ndarray
    bits: int
    kinds: tuple[int, ...]


def unit_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in order and the rows' offsets into them.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as
    a-z. In scripts written without spaces (kana, CJK ideographs: UTF-8 lead
    bytes E3-E9) each character is a word; CJK punctuation and the full-width
    space (E3 80 xx) part words.
    """
    if not len(data):
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        parts, at = [], 0
        while at < len(data):
            end = _cut(data, at)
            parts.append(unit_hashes(data[at:end], np.array([0, end - at]))[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    lead = (data >= 0xE3) & (data <= 0xE9)
    gap = NOT_ALNUM[data]
    if lead.any():
        mark = np.flatnonzero(lead[:-2] & (data[:-2] == 0xE3) & (data[1:-1] == 0x80))
        for i in range(3):
            gap[mark + i] = True
    tail = np.zeros(len(data), bool)
    tail[2:] = lead[:-2]
    starts_here = np.empty(len(data), bool)
    starts_here[0], starts_here[1:] = True, gap[:-1] | lead[1:] | tail[:-1]
    filled = offsets[1:] > offsets[:-1]
    starts_here[offsets[:-1][filled]] = True
    ends_here = np.append(starts_here[1:], True) | np.append(gap[1:], True)
    word = ~gap
    starts, ends = np.flatnonzero(word & starts_here), np.flatnonzero(word & ends_here) + 1
    words = _hash_spans(data, starts, ends, _FOLDED) if len(starts) else np.empty(0, U64)
    return words, np.searchsorted(starts, offsets)


def _cut(data: np.ndarray, at: int) -> int:
    """The end of a piece from ``at`` on: after a gap or before a one-character word."""
    size = PIECE
    while at + size < len(data):
        piece = data[at : at + size + 1]
        breaks = np.flatnonzero(NOT_ALNUM[piece[:-1]] | ((piece[1:] >= 0xE3) & (piece[1:] <= 0xE9)))
        if len(breaks):
            return at + int(breaks[-1]) + 1
        size *= 2
    return len(data)


def _masked(words: np.ndarray, mask: str, kind: int) -> np.ndarray:
    """The hash at every position where the mask fits."""
    salts = random_u64(8, 61) | U64(1)
    n = len(words) - len(mask) + 1
    h = np.full(max(0, n), U64(kind + 1))
    if n > 0:
        with np.errstate(over="ignore"):
            for i, bit in enumerate(mask):
                if bit == "1":
                    h += words[i : n + i] * salts[i]
        h = mix(h)
    return h


#: Kinds of seeds: five-word masks, short items' masks, whole items of one to four words.
_KINDS = (*MASKS, *SHORT_MASKS, *("1" * n for n in range(1, 5)))
_FIRST_SHORT, _FIRST_WHOLE = len(MASKS), len(MASKS) + len(SHORT_MASKS)


def _fits(offsets: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of the ``n`` first positions lie in one row with the ``span`` words from there on."""
    last = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + span <= last


def build_probe(items: list[tuple[int, str]]) -> Probe:
    data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
    words, at = unit_hashes(data, offsets)
    size = np.diff(at)
    word_item = np.repeat(np.arange(len(items), dtype=np.int32), size)
    length = size[word_item] if len(words) else np.zeros(0, np.int64)
    seeds, where, kinds = [], [], []
    for kind, mask in enumerate(_KINDS):
        h = _masked(words, mask, kind)
        ok = _fits(at, len(h), len(mask))
        if kind >= _FIRST_WHOLE:
            ok &= length[: len(h)] == len(mask)
        elif kind >= _FIRST_SHORT:
            ok &= (length[: len(h)] <= SHORT) & (length[: len(h)] > 4)
        ok = np.flatnonzero(ok)
        if len(ok):
            kinds.append(kind)
            seeds.append(h[ok])
            where.append(ok.astype(np.int32))
    seeds, where = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((seeds, U64), (where, np.int32)))
    order = np.argsort(seeds, kind="stable")
    seeds, where = seeds[order], where[order]
    bits = max(16, int(len(seeds) * 16).bit_length())
    slot = np.unique(seeds >> U64(64 - bits))
    present = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(present, slot >> U64(3), (U64(1) << (slot & U64(7))).astype(np.uint8))
    return Probe([i for i, _ in items], words, at, word_item, seeds, where, present, bits, tuple(kinds))


def _enough(same: np.ndarray, similarity: float, window: int) -> bool:
    """Is the share of equal words high enough over the item, or over some run of at least ``window`` words?"""
    if same.mean() >= similarity:
        return True
    if len(same) < window:
        return False
    total = np.concatenate([[0.0], np.cumsum(same - similarity)])
    return bool((total[window:] >= np.minimum.accumulate(total)[:-window] - 1e-9).any())


def _in_order(wanted: np.ndarray, words: np.ndarray, first: int, last: int) -> np.ndarray:
    """Which of the item's words are matched by a longest common subsequence with the
    document, the item laid at ``first`` to ``last``: words put in or left out only
    shift, and no word of the document counts for two."""
    n, wide = len(wanted), last - first + 1
    at = first + np.arange(n)[:, None] + np.arange(wide)[None, :]
    inside = (at >= 0) & (at < len(words))
    equal = inside & (words[np.clip(at, 0, max(0, len(words) - 1))] == wanted[:, None])
    best = np.zeros((n + 1, wide + 1), np.int32)
    for i in range(n):
        best[i + 1, :wide] = np.maximum.accumulate(np.maximum(best[i, :wide] + equal[i], best[i, 1:]))
        best[i + 1, wide] = best[i + 1, wide - 1]
    same, i, d = np.zeros(n, bool), n, wide - 1
    while i > 0:
        if d and best[i, d] == best[i, d - 1]:
            d -= 1
        elif equal[i - 1, d] and best[i, d] == best[i - 1, d] + 1:
            same[i - 1] = True
            i -= 1
        else:
            i, d = i - 1, min(d + 1, wide - 1)
    return same


def _alignments(words: np.ndarray, at: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (row, item, first word of the item in the slice) of all seeds in common,
    sorted; in one piece, or in several where there are more than MOST of them."""
    found, held = [], 0
    shift = U64(64 - probe.bits)
    for kind in probe.kinds:
        h = _masked(words, _KINDS[kind], kind)
        slot = h >> shift
        maybe = np.flatnonzero((probe.present[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1)
        maybe = maybe[_fits(at, len(h), len(_KINDS[kind]))[maybe]]
        if not len(maybe):
            continue
        first, last = (np.searchsorted(probe.seeds, h[maybe], side) for side in ("left", "right"))
        hit = last > first
        maybe, first, count = maybe[hit], first[hit], (last - first)[hit]
        done = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(maybe):
            # a seed that many items share is spread out by numpy, in bounded steps
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + STEP, "right")) - 1)
            each = count[lo:hi]
            offset = np.arange(done[hi] - done[lo]) - np.repeat(done[lo:hi] - done[lo], each)
            w = probe.seed_word[np.repeat(first[lo:hi], each) + offset]
            p = np.repeat(maybe[lo:hi], each)
            item = probe.word_item[w]
            found.append(_distinct(np.searchsorted(at, p, "right") - 1, item, p - (w - probe.offsets[item])))
            held += len(found[-1][0])
            if held > MOST:
                yield _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, held = [], 0
            lo = hi
    if found:
        yield _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _distinct(row: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    return row[new], item[new], start[new]


def find_hits(column: pa.Array, probe: Probe, similarity: float = SIMILARITY, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item index, first word of the alignment, equal words, item's words) of verified overlaps."""
    data, offsets = utf8(column)
    if not len(probe.seeds):
        return
    for lo, hi in row_slices(offsets):
        words, at = unit_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, item, start in _alignments(words, at, probe):
            for a, b in _steps(row, item, np.diff(probe.offsets)[item]):
                equal = _equal(words, at, row[a:b], item[a:b], start[a:b], probe)
                _judge(words, at, row[a:b], item[a:b], start[a:b], equal, probe, similarity, window, best)
        for (r, i), (first, same) in best.items():
            yield lo + r, i, first, same, int(probe.offsets[i + 1] - probe.offsets[i])


def _steps(row: np.ndarray, item: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of alignments of about STEP words together, cut between (row, item) pairs where that is possible."""
    done = np.concatenate([[0], np.cumsum(size)])
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(done, done[a] + STEP, "right")) - 1)
        if b < len(size):
            head = int(heads[np.searchsorted(heads, b, "right") - 1])
            b = head if head > a else b
        yield a, b
        a = b


def _equal(words: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """Equality of the item's words with the document's under each alignment, flat, and the alignments' offsets."""
    size = np.diff(probe.offsets)[item]
    edge = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    place = np.repeat(start, size) + inner
    inside = (place >= np.repeat(at[row], size)) & (place < np.repeat(at[row + 1], size))
    same = probe.words[np.repeat(probe.offsets[item], size) + inner] == words[np.clip(place, 0, max(0, len(words) - 1))]
    return same & inside, edge


def _judge(words, at, row, item, start, equal, probe: Probe, similarity: float, window: int, best: dict) -> None:
    """Keep in ``best`` the alignment of each (row, item) with the most equal words that is an overlap.

    Alignments up to SHIFT words apart are taken together, since a word put in
    or left out shifts the rest; they are judged by words matched in order.
    """
    same, edge = equal
    n = np.diff(edge)
    if not len(n):
        return
    count = np.add.reduceat(same, edge[:-1], dtype=np.int64)
    least = np.minimum(np.ceil(similarity * n - 1e-9), np.where(n >= window, np.ceil(similarity * window - 1e-9), np.inf))

    def keep(k: int, first: int, matched: int) -> None:
        key = (int(row[k]), int(item[k]))
        if key not in best or matched > best[key][1]:
            best[key] = (first - int(at[row[k]]), matched)

    for k in np.flatnonzero(count >= least).tolist():
        if _enough(same[edge[k] : edge[k + 1]], similarity, window):
            keep(k, int(start[k]), int(count[k]))
    # groups of close alignments: two grids, so that no close pair is parted by both
    close = np.zeros(len(n), bool)
    close[1:] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (start[1:] - start[:-1] <= SHIFT)
    if not close.any():
        return
    chain = np.cumsum(~close) - 1
    origin = start[np.flatnonzero(~close)][chain]
    for shift in (0, (SHIFT + 1) // 2):
        cell = (start - origin + shift) // (SHIFT + 1)
        fresh = np.ones(len(n), bool)
        fresh[1:] = (chain[1:] != chain[:-1]) | (cell[1:] != cell[:-1])
        heads = np.flatnonzero(fresh)
        total, members = np.add.reduceat(count, heads), np.diff(np.append(heads, len(n)))
        for g in np.flatnonzero((members > 1) & (total >= least[heads])).tolist():
            a, b = int(heads[g]), int(heads[g] + members[g])
            either = np.logical_or.reduce([same[edge[k] : edge[k + 1]] for k in range(a, b)])
            if not _enough(either, similarity, window):
                continue
            base, end = int(at[row[a]]), int(at[row[a] + 1])
            wanted = probe.words[probe.offsets[item[a]] : probe.offsets[item[a] + 1]]
            matched = _in_order(wanted, words[base:end], int(start[a]) - base, int(start[b - 1]) - base)
            if _enough(matched, similarity, window):
                keep(a, int(start[a]), int(matched.sum()))


def _blocks(benchmark: DataFrame, most: int, least_words: int) -> Iterator[list[tuple[int, str]]]:
    """The test items of at least ``least_words`` words in blocks of bounded size, streamed to the driver one by one."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(unit_hashes(*utf8(pa.array([r[1]])))[0])
        if n < max(1, least_words):
            continue
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, block_words: int = BLOCK_WORDS, least_words: int = 1
) -> DataFrame:
    """doc_id, item_id, start, matched, item_words, similarity: one row for each document
    row and test item that it overlaps with; documents without a hit have no row.

    Words are as in ``unit_hashes``. Test seeds are broadcast in blocks of at
    most ``block_words`` words (a longer test set takes several passes, one
    block in a task at a time), training seeds are looked up in the same pass
    that hashes the text, so nothing of the corpus is shuffled and passages
    common to many documents cost no more than others. Around each hit the
    item is laid over the document: it overlaps if at least ``similarity`` of
    the item's words are equal, or that share of some run of at least
    ``window`` of them. Where words were put in or left out, equal words count
    as far as they are in order.

    Items of one to four words are found where they stand whole, word by word;
    items of five to ten words also by seeds of four words, so that one
    substituted word doesn't hide them. Items below ``least_words`` words are
    left out. Null or empty text: no hit. Null ids are carried. Repeated rows
    have their own hits, repeated items too. Empty table on either side: no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, matched int, item_words int, similarity double"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for i, block in enumerate(_blocks(benchmark, block_words, least_words)):
        shared = spark.sparkContext.broadcast(build_probe(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, probe = batch.column(0), shared.value
                hits = [
                    (ids[row].as_py(), probe.item_ids[item], start, same, n, same / n)
                    for row, item, start, same, n in find_hits(batch.column(1), probe, similarity, window)
                ]
                if hits:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        part = rows.mapInArrow(run, schema)
        out = out.unionByName(part) if i else part
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, block_words: int = BLOCK_WORDS, least_words: int = 5
) -> DataFrame:
    """The rows of ``docs`` without an overlap with any test item; columns unchanged, no shuffle.

    Items of fewer than ``least_words`` words don't count here: a phrase of a
    few common words would take clean documents with it. ``contamination``
    reports them. With more than one block the rows kept are written to the
    shared folder between blocks, so that a task holds one block at a time.
    """
    at = docs.columns.index("text")
    before = None
    blocks = _blocks(benchmark, block_words, least_words)
    block = next(blocks, None)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(build_probe(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for hit in find_hits(batch.column(at), shared.value, similarity, window):
                    keep[hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        block = next(blocks, None)
        if block is not None:
            docs, path = materialize(docs, "decontaminated")
            if before:
                drop_path(docs.sparkSession, before)
            before = path
    return docs
