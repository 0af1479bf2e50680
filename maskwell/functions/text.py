"""Text expressions: normalisation, lines, headings, sections. No Python runs on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.arrays import let, scan

SEGMENT = "struct<line_number:int,section_id:string,section_type:string,start:int,end:int,text:string>"
#: All characters that count as white space; plain ``trim`` takes only U+0020.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(t: Column) -> Column:
    return F.trim(t, F.lit(BLANKS))


def normalize(t: Column) -> Column:
    """Full-width space to space, runs of blanks to one, three or more line ends to two, stripped; null is empty."""
    t = F.translate(F.coalesce(t, F.lit("")), "　", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def contains_any(t: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (t.contains(w) for w in words))


def is_japanese(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike("[ぁ-んァ-ン一-龯]")


def heading(line: Column, lower: Column) -> Column:
    """Section type of a heading line by the first matching type, else null; ``lower`` is the lower-case line."""
    out = None
    for kind, (ja, en) in fixed.SECTION_HEADINGS.items():
        found = contains_any(line, ja) | contains_any(lower, list(dict.fromkeys(w.lower() for w in en)))
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise(F.lit(None).cast("string"))


def segments(normal: Column) -> Column:
    """The non-empty stripped lines of a normalised text with offsets and sections, as an array.

    Lines before the first heading are in ``header`` (``section_0``).
    """
    # each stage binds what the next one uses more than once
    lines = F.transform(
        F.split(normal, "\n", -1),
        lambda x: F.struct(
            (F.length(x) + 1).alias("width"),
            (F.length(x) - F.length(F.ltrim(x, F.lit(BLANKS)))).alias("lead"),
            strip(x).alias("body"),
        ),
    )
    lowered = F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(x["body"]).alias("lower")))
    lines = F.transform(
        lowered,
        lambda y: F.struct(
            y["x"]["width"].alias("width"), y["x"]["lead"].alias("lead"), y["x"]["body"].alias("body"),
            heading(y["x"]["body"], y["lower"]).alias("kind"),
        ),
    )

    def step(state: Column, x: Column) -> Column:
        return F.struct(
            state["next"].alias("pos"),
            (state["next"] + x["width"]).alias("next"),
            (state["number"] + x["kind"].isNotNull().cast("int")).alias("number"),
            F.coalesce(x["kind"], state["section"]).alias("section"),
            x["lead"].alias("lead"),
            x["body"].alias("body"),
        )

    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("next"), F.lit(0).alias("number"), F.lit("header").alias("section"),
        F.lit(0).alias("lead"), F.lit("").alias("body"),
    )
    filled = F.filter(scan(lines, zero, step), lambda x: x["body"] != "")
    return F.transform(
        filled,
        lambda x, i: F.struct(
            i.alias("line_number"),
            F.concat(F.lit("section_"), x["number"].cast("string")).alias("section_id"),
            x["section"].alias("section_type"),
            (x["pos"] + x["lead"]).alias("start"),
            (x["pos"] + x["lead"] + F.length(x["body"])).alias("end"),
            x["body"].alias("text"),
        ),
    )


def section_text(segs: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(segs, lambda s: s["section_type"] == kind), lambda s: s["text"]), "\n")


def reconstruct(segs: Column) -> Column:
    """The segments at their offsets, gaps filled with spaces."""

    def whole(x: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(x, F.greatest(i, F.lit(1)))["end"])
        return F.array_join(F.transform(x, lambda s, i: F.concat(F.repeat(F.lit(" "), s["start"] - before(i)), s["text"])), "")

    return let(segs, whole)


# Full-width punctuation and its half-width form, the mark for a line end.
WIDE_PUNCTUATION, NARROW_PUNCTUATION = "：；？！（）［］｛｝　", ":;?!()[]{} "
LINE_MARK = "<LB>"


def encode_lines(t: Column) -> Column:
    """Line ends as marks, as a text generator takes its input."""
    return F.replace(t, F.lit("\n"), F.lit(LINE_MARK))


def decode_lines(t: Column) -> Column:
    return F.replace(t, F.lit(LINE_MARK), F.lit("\n"))


def narrow_punctuation(t: Column) -> Column:
    """Full-width punctuation as half-width, character by character: offsets stay."""
    return F.translate(t, WIDE_PUNCTUATION, NARROW_PUNCTUATION)
