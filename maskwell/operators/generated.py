"""Spans from generated text: a generator returns the text with entities replaced by
tags; the text between tags is found again in the original, what lies between is a span."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.spans import no_spans
from maskwell.functions.text import LINE_MARK, NARROW_PUNCTUATION, WIDE_PUNCTUATION

_NARROW = str.maketrans(WIDE_PUNCTUATION, NARROW_PUNCTUATION)


@dataclass(frozen=True)
class Recovery:
    """Limits of span recovery."""

    tags: dict[str, str] = field(default_factory=lambda: dict(fixed.GENERATED_TAGS))
    least_fuzzy: int = 6
    window: int = 700
    #: (up to this anchor length, least ratio), the last one for all longer anchors.
    ratios: tuple[tuple[int, float], ...] = ((9, 0.93), (20, 0.86), (1 << 30, 0.80))
    longest: dict[str, int] = field(default_factory=lambda: dict(fixed.LONGEST_GENERATED))
    longest_other: int = 120
    base_score: float = 0.85

    def least_ratio(self, size: int) -> float:
        return next(ratio for upto, ratio in self.ratios if size <= upto)


def find_exactly(text: str, anchor: str, start: int) -> tuple[int, float] | None:
    at = text.find(anchor, start)
    return None if at < 0 else (at, 1.0)


def find_nearly(text: str, anchor: str, start: int, limits: Recovery) -> tuple[int, float] | None:
    """The place within the window that is most like the anchor, the earliest of equals."""
    size = len(anchor)
    best = (-1, 0.0)
    for at in range(start, min(len(text), start + limits.window) - size + 1):
        likeness = SequenceMatcher(None, anchor, text[at : at + size])
        # two upper bounds of the ratio spare most of the comparisons
        if likeness.real_quick_ratio() > best[1] and likeness.quick_ratio() > best[1] and (ratio := likeness.ratio()) > best[1]:
            best = (at, ratio)
    return best if best[0] >= 0 and best[1] >= limits.least_ratio(size) else None


def recover(original: str, generated: str, requested: set[str], limits: Recovery = Recovery()) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, str, str]]]:
    """Spans (entity, start, end, score) and what was discarded (tag, reason, context).

    Anchors are looked for behind the last one that was found; one that isn't
    found is passed over, and its tag waits for the next. Of two tags in a row
    the later one counts. A tag with no anchor behind it is discarded.
    """
    text, spans, dropped = original.translate(_NARROW), [], []
    end, tag = 0, None
    for part in re.split("(" + "|".join(map(re.escape, limits.tags)) + ")", generated):
        if part in limits.tags:
            tag = part
            continue
        anchor = part.translate(_NARROW).strip()
        found = find_exactly(text, anchor, end) if anchor else None
        if found is None and len(anchor) >= limits.least_fuzzy:
            found = find_nearly(text, anchor, end, limits)
        if found is None:
            continue
        at, ratio = found
        if tag is not None and limits.tags[tag] in requested:
            reason = _fault(limits, limits.tags[tag], end, at)
            if reason:
                dropped.append((tag, reason, _context(original, end)))
            else:
                spans.append((limits.tags[tag], end, at, max(0.0, min(1.0, limits.base_score * ratio))))
        end, tag = at + len(anchor), None
    if tag is not None:
        dropped.append((tag, "no_right_anchor", _context(original, end)))
    return spans, dropped


def _context(text: str, at: int) -> str:
    return text[max(0, at - 40) : at + 40]


def _fault(limits: Recovery, entity: str, start: int, end: int) -> str | None:
    """Why a span can't stand, or None."""
    most = limits.longest.get(entity, limits.longest_other)
    if end < start:
        return "negative_span"
    if end == start:
        return "empty_span"
    return f"span_too_long(len={end - start}, max={most})" if end - start > most else None


def with_recovered_spans(
    docs: DataFrame, entities: list[str], text: str = "text", generated: str = "generated", limits: Recovery = Recovery(), out: str = "recovered", discarded: str = "discarded"
) -> DataFrame:
    """``docs`` with spans recovered from the ``generated`` column and the discards
    (tag, reason, context). Line marks in it are line ends. Null on either side: none of both."""
    requested, (at, gen_at) = set(entities), (docs.columns.index(text), docs.columns.index(generated))
    span = pa.list_(pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64()), ("source", pa.string())]))
    drop = pa.list_(pa.struct([("tag", pa.string()), ("reason", pa.string()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, drops = [], []
            for t, g in zip(batch.column(at).to_pylist(), batch.column(gen_at).to_pylist(), strict=True):
                found, lost = recover(t, g.replace(LINE_MARK, "\n"), requested, limits) if t is not None and g is not None else ([], [])
                spans.append([{"entity": e, "start": a, "end": b, "text": t[a:b], "score": s, "source": "generated"} for e, a, b, s in found])
                drops.append([dict(zip(("tag", "reason", "context"), x, strict=True)) for x in lost])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, span), pa.array(drops, drop)], [*batch.schema.names, out, discarded])

    schema = docs.select("*", no_spans().alias(out), F.array().cast("array<struct<tag:string,reason:string,context:string>>").alias(discarded)).schema
    return docs.mapInArrow(run, schema)


class TagGenerator:
    """A generator (``generate(text) -> text with tags``) as a model of spans. Line ends go
    in as marks. It isn't called if no entity of its tags is asked for (see ``with_model_spans``)."""

    def __init__(self, generate: Callable[[str], str], limits: Recovery = Recovery()):
        self.generate, self.limits = generate, limits

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        every = set(self.limits.tags.values())
        return [recover(t, self.generate(t.replace("\n", LINE_MARK)).replace(LINE_MARK, "\n"), every, self.limits)[0] for t in texts]
