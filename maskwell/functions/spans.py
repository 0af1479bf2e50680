"""Span expressions over arrays: regex spans with offsets, conflict resolution, label decoding, masking.

A span is a struct (entity, start, end, text, score, source) with half-open
code-point offsets. All forms work inside one row, so no plan here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.arrays import let, scan

SPAN = "struct<entity:string,start:int,end:int,text:string,score:double,source:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def make(entity, start: Column, end: Column, text: Column, score, source) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(entity).cast("string").alias("entity"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        text.alias("text"), as_col(score).cast("double").alias("score"), as_col(source).cast("string").alias("source"),
    )


class Pattern(NamedTuple):
    """A pattern that never matches the empty string, and what its matches are. ``needs``
    are strings of which every match has one."""

    entity: str
    pattern: str
    score: float
    source: str
    needs: tuple[str, ...] = ()


#: A span with the number of the pattern that found it.
FOUND = SPAN[:-1] + ",rule:int>"


def find_all(t: Column, patterns: list[Pattern], offset: Column | int = 0) -> Column:
    """The matches of all patterns as an array of FOUND, pattern by pattern.

    Gaps (``split``) and hits (``regexp_extract_all``) alternate, so one scan
    over both gives the offsets; it stands in the plan once, whatever the number
    of patterns. ``(?U)`` makes \\d, \\s and \\w Unicode. A text without a
    pattern's ``needs`` is passed over by a byte search, ahead of any regular
    expression, and one without a match before arrays are built.
    """
    base = offset if isinstance(offset, Column) else F.lit(offset)

    def matched(number: int, p: Pattern) -> Column:
        java = "(?U)" + p.pattern
        possible = t.rlike(java)
        if p.needs:
            possible = reduce(lambda a, b: a | b, (t.contains(w) for w in p.needs)) & possible
        parts = [F.lit(number).alias("rule"), F.lit(p.entity).alias("entity"), F.lit(p.score).cast("double").alias("score"), F.lit(p.source).alias("source")]
        return F.when(possible, F.struct(*parts, F.split(t, java, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(java), F.lit(0)).alias("hits")))

    def step(state: Column, z: Column) -> Column:
        start = state["end"] + F.length(z["0"])
        return F.struct(start.alias("start"), (start + F.length(z["1"])).alias("end"), z["1"].alias("text"))

    zero = F.struct(F.lit(0).alias("start"), base.cast("int").alias("end"), F.lit(None).cast("string").alias("text"))

    def spans(p: Column) -> Column:
        # the last gap has no hit behind it
        hits = F.filter(scan(F.arrays_zip(p["gaps"].alias("0"), p["hits"].alias("1")), zero, step), lambda z: z["text"].isNotNull())
        return F.transform(hits, lambda z: F.struct(
            p["entity"].alias("entity"), z["start"].alias("start"), z["end"].alias("end"), z["text"].alias("text"), p["score"].alias("score"), p["source"].alias("source"), p["rule"].alias("rule")))

    if not patterns:
        return F.array().cast(f"array<{FOUND}>")
    packs = F.array(*[matched(i, p) for i, p in enumerate(patterns)])
    return F.flatten(F.transform(F.filter(packs, lambda p: p.isNotNull()), spans))


def plain(spans: Column) -> Column:
    """Spans without the pattern's number."""
    return F.transform(spans, lambda s: with_score(s, s["score"]))


def find(t: Column, pattern: str, entity: str, score: float, source: str, offset: Column | int = 0, needs: list[str] | None = None) -> Column:
    """All matches of one pattern as spans."""
    return plain(find_all(t, [Pattern(entity, pattern, score, source, tuple(needs or ()))], offset))


#: Characters of a block of text, see ``blocks``.
BLOCK = 1024


def blocks(t: Column) -> Column:
    """The text cut in blocks of BLOCK characters: a substring of a long text is counted
    out from its start, a substring of a block isn't."""
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(parts: Column, start: Column, size: Column) -> Column:
    """``size`` characters from the 0-based ``start`` on, of a text given as its ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((start + size - 1) / BLOCK).cast("int") - first + 1
    inside = F.array_join(F.slice(parts, first + 1, F.greatest(n, F.lit(0))), "")
    return F.when(size > 0, F.substr(inside, start - first * BLOCK + 1, size)).otherwise("")


def around(parts: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text ``before`` and ``after`` [start, end), of a text given as its ``blocks``."""
    low = F.greatest(start - before, F.lit(0))
    return piece(parts, low, end + after - low)


def in_context(t: Column, spans: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(spans, blocks of the text)``; a text without spans isn't cut."""
    return let(spans, lambda x: F.when(F.size(x) == 0, x).otherwise(let(blocks(t), lambda parts: body(x, parts))))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_score(s: Column, score: Column) -> Column:
    return make(s["entity"], s["start"], s["end"], s["text"], score, s["source"])


def _ordered(spans: Column, key: Callable[[Column, Column], list[Column]]) -> Column:
    """Stable sort by ``key(span, index)``; the index breaks ties."""
    keyed = F.transform(
        spans, lambda s, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key(s, i))], i.alias("ord"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def by_start(spans: Column) -> Column:
    return _ordered(spans, lambda s, i: [s["start"]])


def clusters(spans: Column) -> Column:
    """The spans in order of start, cut where none reaches over the cut: arrays of spans
    that overlap with none of another array. Conflicts only arise within one, so each
    is resolved on its own, and the cost of that is in its size."""

    def cut(ordered: Column) -> Column:
        reach = scan(
            ordered,
            F.struct(F.lit(-1).alias("end"), F.lit(True).alias("fresh")),
            lambda state, s: F.struct(F.greatest(state["end"], s["end"]).alias("end"), (s["start"] >= state["end"]).alias("fresh")),
        )
        heads = F.filter(F.transform(reach, lambda r, i: F.when(r["fresh"], i)), lambda i: i.isNotNull())
        return let(heads, lambda at: F.transform(at, lambda a, k: F.slice(ordered, a + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - a)))

    return let(by_start(spans), cut)


def _by_cluster(spans: Column, resolve: Callable[[Column], Column]) -> Column:
    """``resolve`` for each cluster that has more than one span."""
    whole = lambda x: F.flatten(F.transform(clusters(x), lambda c: F.when(F.size(c) == 1, c).otherwise(resolve(c))))
    return let(spans, lambda x: F.when(F.size(x) <= 1, x).otherwise(whole(x)))


def deduplicate(spans: Column) -> Column:
    """Greedy by (score down, start): a span that overlaps an accepted one goes."""

    def resolve(group: Column) -> Column:
        best = _ordered(group, lambda s, i: [-s["score"], s["start"]])
        step = lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(s)))
        return by_start(F.aggregate(best, no_spans(), step))

    return _by_cluster(spans, resolve)


def priority(entity: Column) -> Column:
    names = F.array(*[F.lit(x) for x in fixed.ENTITY_PRIORITY])
    at = F.array_position(names, entity)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(fixed.ENTITY_PRIORITY))).cast("int")


def merge_candidates(spans: Column, kind: str = SPAN) -> Column:
    """By (start, priority, score down): a span meets the first kept one it overlaps
    and replaces it if of better priority, or of equal priority and higher score."""

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda k: overlap(k, s)), True).cast("int")
        held = F.get(acc, at - 1)
        mine, other = priority(s["entity"]), priority(held["entity"])
        wins = (mine < other) | ((mine == other) & (s["score"] > held["score"]))
        swapped = F.concat(F.filter(acc, lambda k, i: i != at - 1), F.array(s))
        return F.when(at == 0, F.concat(acc, F.array(s))).when(wins, swapped).otherwise(acc)

    def resolve(group: Column) -> Column:
        return by_start(F.aggregate(_ordered(group, lambda s, i: [s["start"], priority(s["entity"]), -s["score"]]), F.array().cast(f"array<{kind}>"), step))

    return _by_cluster(spans, resolve)


def covered(s: Column, kept: Column) -> Column:
    """How many positions of ``s`` the union of ``kept`` covers; ``kept`` may overlap among itself."""
    cut = F.transform(
        F.filter(kept, lambda k: overlap(k, s)),
        lambda k: F.struct(F.greatest(k["start"], s["start"]).alias("a"), F.least(k["end"], s["end"]).alias("b")),
    )
    zero = F.struct(s["start"].cast("int").alias("to"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(cut),
        zero,
        lambda acc, c: F.struct(
            F.greatest(acc["to"], c["b"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), c["b"] - F.greatest(acc["to"], c["a"]))).alias("n")
        ),
        lambda acc: acc["n"],
    )


def merge_results(spans: Column) -> Column:
    """By (score down, length down, start): a span goes if more than half of its own
    positions are covered by accepted ones."""

    def resolve(group: Column) -> Column:
        best = _ordered(group, lambda s, i: [-s["score"], s["start"] - s["end"], s["start"]])
        step = lambda acc, s: F.when(covered(s, acc) > (s["end"] - s["start"]) * F.lit(0.5), acc).otherwise(F.concat(acc, F.array(s)))
        return by_start(F.aggregate(best, no_spans(), step))

    return _by_cluster(spans, resolve)


def meaningful(spans: Column) -> Column:
    """Drops blank spans and person names without a letter of Latin, kana or kanji."""
    blank = lambda s: ~s["text"].rlike(r"(?U)[^\s\x1c-\x1f]")
    nameless = lambda s: s["entity"].isin("PERSON", "JP_PERSON") & ~s["text"].rlike("[A-Za-z぀-ヿ一-鿿]")
    return F.filter(spans, lambda s: ~(blank(s) | nameless(s)))


_OPEN = "struct<entity:string,start:int,end:int,score:double,n:int,words:array<string>>"


def _decoded(tokens: Column, labels: dict[str, str]) -> Column:
    """Token classes (label, score, start, end, word) to entities, as an array of _OPEN.

    ``B-`` closes and opens, ``I-`` extends only its own type, a plain label
    extends its own type and else switches, unknown plain labels and ``O``
    close. The score is the running mean.
    """
    known = F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv])
    nothing = F.lit(None).cast(_OPEN)

    def pair(current: Column, out: Column) -> Column:
        return F.struct(current.cast(_OPEN).alias("open"), out.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))

    def step(acc: Column, k: Column) -> Column:
        o, entity = acc["open"], F.try_element_at(known, k["label"])
        fresh = F.struct(entity.alias("entity"), k["start"].cast("int").alias("start"), k["end"].cast("int").alias("end"),
                         k["score"].cast("double").alias("score"), F.lit(1).alias("n"), F.array(k["word"]).alias("words"))
        longer = F.struct(o["entity"].alias("entity"), o["start"].alias("start"), k["end"].cast("int").alias("end"),
                          ((o["score"] * o["n"] + k["score"]) / (o["n"] + 1)).alias("score"), (o["n"] + 1).alias("n"),
                          F.concat(o["words"], F.array(k["word"])).alias("words"))
        same = F.coalesce(o["entity"] == entity, F.lit(False))
        return (
            F.when(k["label"].startswith("B-"), pair(F.when(entity.isNotNull(), fresh.cast(_OPEN)).otherwise(nothing), closed(acc)))
            .when(k["label"].startswith("I-"), F.when(same, pair(longer, acc["out"])).otherwise(acc))
            .when(entity.isNull(), pair(nothing, closed(acc)))
            .when(same, pair(longer, acc["out"]))
            .otherwise(pair(fresh, closed(acc)))
        )

    return F.aggregate(tokens, pair(nothing, F.array().cast(f"array<{_OPEN}>")), step, closed)


def decode_labels(tokens: Column, labels: dict[str, str], text: Column) -> Column:
    """Token classes (label, score, start, end) to spans; BIO or plain labels, see
    ``_decoded``. Tokens at (0, 0) are skipped."""
    real = F.transform(
        F.filter(tokens, lambda k: (k["start"] != 0) | (k["end"] != 0)),
        lambda k: F.struct(k["label"], k["score"], k["start"], k["end"], F.lit(None).cast("string").alias("word")),
    )
    return F.transform(
        _decoded(real, labels),
        lambda o: make(o["entity"], o["start"], o["end"], F.substr(text, o["start"] + 1, o["end"] - o["start"]), o["score"], F.lit("ner")),
    )


def decode_words(tokens: Column, labels: dict[str, str], text: Column) -> Column:
    """Token classes (label, score, word) of a tokenizer without offsets to spans. The first
    and last token are marks and skipped. An entity's words, joined by spaces (pieces
    that begin with ## by nothing), are looked for in the text, then once more
    without spaces; the first place counts, and an entity not found goes."""
    bare = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    real = F.transform(bare, lambda k: F.struct(k["label"], k["score"], F.lit(0).alias("start"), F.lit(0).alias("end"), k["word"]))
    joined = lambda o: F.replace(F.array_join(o["words"], " "), F.lit(" ##"), F.lit(""))
    named = F.transform(_decoded(real, labels), lambda o: F.struct(o.alias("o"), joined(o).alias("text"), F.replace(joined(o), F.lit(" "), F.lit("")).alias("tight")))
    placed = F.transform(named, lambda x: F.struct(
        x["o"].alias("o"), F.when(F.instr(text, x["text"]) > 0, x["text"]).otherwise(x["tight"]).alias("text")))
    found = F.filter(F.transform(placed, lambda x: F.struct(x["o"].alias("o"), x["text"].alias("text"), F.instr(text, x["text"]).alias("at"))), lambda x: x["at"] > 0)
    return F.transform(found, lambda x: make(x["o"]["entity"], x["at"] - 1, x["at"] - 1 + F.length(x["text"]), x["text"], x["o"]["score"], F.lit("ner")))


def mask_of(entity: Column, masks: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (masks or fixed.MASKS).items() for x in kv])
    return F.coalesce(F.try_element_at(table, entity), F.lit(fixed.DEFAULT_MASK))


def apply_masks(t: Column, spans: Column, masks: dict[str, str] | None = None) -> Column:
    """``t`` with disjoint spans, sorted by start, replaced by their masks."""

    def replaced(x: Column, parts: Column) -> Column:
        # a span's part of the output: the text since the span before, and the mask
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(x, F.greatest(i, F.lit(1)))["end"])
        out = F.transform(x, lambda s, i: F.concat(piece(parts, before(i), s["start"] - before(i)), mask_of(s["entity"], masks)))
        end = F.element_at(x, -1)["end"]
        return F.concat(F.array_join(out, ""), piece(parts, end, F.length(t) - end))

    return F.when(F.size(spans) == 0, t).otherwise(let(spans, lambda x: let(blocks(t), lambda parts: replaced(x, parts))))
