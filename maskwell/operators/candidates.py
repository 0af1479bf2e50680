"""Line candidates: spans per section line, verification by policy and format, collisions, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.arrays import let
from maskwell.functions.spans import SPAN, Pattern, apply_masks, clusters, find_all, make, merge_candidates, no_spans, overlap, priority
from maskwell.functions.text import contains_any, normalize, segments, strip

#: A line candidate: a span with the section of its line.
CANDIDATE = SPAN[:-1] + ",section_id:string,section_type:string>"
VERDICT = "struct<entity:string,start:int,end:int,text:string,score:double,source:string,section:string,verified:double,status:string,reason:string>"


def _ascii_int(t: Column) -> Column:
    return F.translate(t, "０１２３４５６７８９", "0123456789").try_cast("int")


def _char(t: Column, at: Column) -> Column:
    """The character at a 0-based position, empty outside the text."""
    return F.when(at < 0, "").otherwise(F.substr(t, at + 1, F.lit(1)))


def _digit(c: Column) -> Column:
    return c.rlike(r"(?U)^\d$")


#: The rules of a line, in the order that breaks ties.
PATTERNS = [
    Pattern("EMAIL_ADDRESS", fixed.EMAIL, 0.95, "rule:email_regex", ("@",)),
    *[Pattern("PHONE_NUMBER_JP", p, 0.9, "rule:phone_jp_regex", (w,)) for p, w in zip(fixed.PHONE_JP, ("-", "0", "+81"), strict=True)],
    *[Pattern("PHONE_NUMBER", p, 0.9, "rule:phone_en_regex", (w,)) for p, w in zip(fixed.PHONE_EN, ("+1", "("), strict=True)],
    Pattern("JP_ZIP_CODE", fixed.ZIP_JP, 0.95, "rule:jp_zip_regex", ("-",)),
    Pattern("US_ZIP_CODE", fixed.ZIP_US, 0.7, "rule:us_zip_regex"),
    *[Pattern("DATE", p, 0.5, "rule:date_regex", (w,)) for p, w in zip(fixed.DATES, "-年/", strict=True)],
    Pattern("JP_AGE", fixed.AGE, 0.85, "rule:age_regex", ("歳",)),
    Pattern("JP_GENDER", fixed.GENDER, 0.8, "rule:gender_regex", ("男", "女")),
]


def pattern_candidates(seg: Column) -> Column:
    """The patterns' spans in a line, less post codes that go on with a number before
    them, US codes that are years or stand outside of contact and header, and ages
    beyond 120; dates are birth dates in a line with a birth word."""
    t, source = seg["text"], lambda s: s["source"]
    birth = contains_any(F.lower(t), fixed.BIRTH_LINE_WORDS)

    def stands(s: Column) -> Column:
        at = s["start"] - seg["start"]
        one, two = _char(t, at - 1), _char(t, at - 2)
        free = ~(_digit(one) | (_digit(two) & (one == "-")))
        year = _ascii_int(F.substr(s["text"], F.lit(1), F.lit(4))).between(1900, 2100)
        young = _ascii_int(F.regexp_extract(s["text"], r"(?U)(\d+)", 1)).between(0, 120)
        return (
            F.when(source(s) == "rule:jp_zip_regex", free)
            .when(source(s) == "rule:us_zip_regex", seg["section_type"].isin("contact", "header") & ~year)
            .when(source(s) == "rule:age_regex", young)
            .otherwise(True)
        )

    def dated(s: Column) -> Column:
        is_birth = (source(s) == "rule:date_regex") & birth
        return make(F.when(is_birth, "DATE_OF_BIRTH_JP").otherwise(s["entity"]), s["start"], s["end"], s["text"], F.when(is_birth, 0.9).otherwise(s["score"]), source(s))

    return F.transform(F.filter(find_all(t, PATTERNS, seg["start"]), stands), dated)


def addresses(seg: Column) -> Column:
    """Per prefecture its first occurrence in the line, up to the first delimiter."""
    t = seg["text"]

    def one(name: Column) -> Column:
        at = F.instr(t, name)
        rest = F.substr(t, at, F.length(t))
        body = F.regexp_extract(rest, "(?s)^(.*?)(?:" + "|".join(fixed.ADDRESS_ENDS) + r"|\z)", 1)
        body = strip(body)
        start = seg["start"] + at - 1
        span = make("JP_ADDRESS", start, start + F.length(body), body, 0.75, "rule:jp_address_prefix")
        return F.when((at > 0) & (F.length(body) > F.length(name) + 2), span)

    names = F.array(*[F.lit(p) for p in fixed.PREFECTURES])
    return F.when(contains_any(t, ["県", "府", "東京都", "北海道"]), F.filter(F.transform(names, one), lambda s: s.isNotNull())).otherwise(no_spans())


def line_candidates(seg: Column) -> Column:
    """All rules on one segment; each candidate carries the segment's section."""
    spans = F.concat(pattern_candidates(seg), addresses(seg))
    return F.transform(spans, lambda s: in_section(s, seg["section_id"], seg["section_type"]))


def in_section(s: Column, section_id: Column, section_type: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("entity", "start", "end", "text", "score", "source")], section_id.alias("section_id"), section_type.alias("section_type"))


#: Every rule's match has one of these, so other lines need no rule.
_POSSIBLE = r"[@\p{Nd}男女県府]|東京都|北海道"


def extract(docs: DataFrame, text: str = "text", ner: str | None = None) -> DataFrame:
    """``docs`` with normalised ``text``, ``segments`` and merged ``candidates``; null text is empty.

    ``ner`` names a column of spans that a model found in the reconstructed text,
    which has the normalised text's offsets; they take the section at their start.
    """
    docs = docs.withColumn(text, normalize(F.col(text))).withColumn("segments", segments(F.col(text)))
    docs = docs.withColumn("candidates", F.flatten(F.transform(F.filter("segments", lambda g: g["text"].rlike(_POSSIBLE)), line_candidates)))
    if ner is not None:
        located = F.transform(ner, lambda s: let(segment_at(F.col("segments"), s["start"]), lambda g: in_section(
            s, F.coalesce(g["section_id"], F.lit("unknown")), F.coalesce(g["section_type"], F.lit("unknown")))))
        docs = docs.withColumn("candidates", F.concat("candidates", F.coalesce(located, F.array().cast(f"array<{CANDIDATE}>"))))
    return docs.withColumn("candidates", merge_candidates(F.col("candidates"), CANDIDATE))


def segment_at(segs: Column, position: Column) -> Column:
    """The segment that holds a position, null if none does."""
    return F.get(F.filter(segs, lambda g: (g["start"] <= position) & (position < g["end"])), F.lit(0))


def valid_date(t: Column) -> Column:
    checks = []
    for p in fixed.DATE_FORMATS:
        y, m, d = (_ascii_int(F.regexp_extract(t, "(?U)" + p, i)) for i in (1, 2, 3))
        checks.append(F.coalesce(y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31), F.lit(False)))
    return checks[0] | checks[1] | checks[2]


def verdict(s: Column, section: Column, allowed: Column | None = None) -> Column:
    """One candidate's verification: allow list, section policy, format, thresholds."""
    shift = F.lit(0.0)
    for kind, (person, address) in fixed.SECTION_POLICY.items():
        here = section == kind
        shift = F.when(here & s["entity"].isin(fixed.PERSON_TYPES), person).when(here & s["entity"].isin(fixed.ADDRESS_TYPES), address).otherwise(shift)
    score = F.when(shift == 0, s["score"]).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["score"] + shift)))
    policy = F.when(shift < 0, F.concat(F.lit("section_penalty:"), section)).when(shift > 0, F.concat(F.lit("section_boost:"), section))

    body, name, ok = strip(s["text"]), F.lit(None).cast("string"), F.lit(True)
    # phone numbers are judged without the spaces inside
    shapes = {"PHONE_NUMBER_JP": F.translate(body, " 　", ""), "PHONE_NUMBER": F.translate(body, " ", "")}
    for entity, (label, pattern) in fixed.VALID_FORMATS.items():
        mine = s["entity"] == entity
        name, ok = F.when(mine, label).otherwise(name), F.when(mine, shapes.get(entity, body).rlike("(?U)" + pattern)).otherwise(ok)
    dated = s["entity"].isin("DATE_OF_BIRTH_JP", "DATE")
    name, ok = F.when(dated, "date").otherwise(name), F.when(dated, valid_date(body)).otherwise(ok)
    shape = F.when(name.isNotNull(), F.concat(F.when(ok, "format_valid:").otherwise("format_invalid:"), name))

    listed = F.lit(False) if allowed is None else allowed
    final = F.when(listed | ~ok, 0.0).otherwise(score)
    status = F.when(listed | ~ok, "exclude").when(score >= fixed.MASK_FROM, "mask").when(score >= fixed.REVIEW_FROM, "review").otherwise("exclude")
    reasons = F.concat_ws("; ", policy, shape)
    reason = F.when(listed, "allow_list_match").when(reasons == "", "passed_verification").otherwise(reasons)
    return F.struct(
        s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["score"].alias("score"),
        s["source"].alias("source"), section.alias("section"), final.alias("verified"), status.alias("status"), reason.alias("reason"),
    )


def resolve_collisions(verdicts: Column) -> Column:
    """Active spans by start: the first kept one that overlaps stays unless the newcomer's
    priority is better; losers become excluded, after the kept and the already excluded ones."""
    nothing = F.array().cast(f"array<{VERDICT}>")

    def lost(v: Column) -> Column:
        return v.withField("verified", F.lit(0.0)).withField("status", F.lit("exclude")).withField("reason", F.lit("collision_lower_priority"))

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc["kept"], lambda k: overlap(k, v)), True).cast("int")
        held = F.get(acc["kept"], at - 1)
        better = priority(v["entity"]) < priority(held["entity"])
        rest = F.filter(acc["kept"], lambda k, i: i != at - 1)
        return (
            F.when(at == 0, F.struct(F.concat(acc["kept"], F.array(v)).alias("kept"), acc["lost"].alias("lost")))
            .when(better, F.struct(F.concat(rest, F.array(v)).alias("kept"), F.concat(acc["lost"], F.array(lost(held))).alias("lost")))
            .otherwise(F.struct(acc["kept"].alias("kept"), F.concat(acc["lost"], F.array(lost(v))).alias("lost")))
        )

    def resolved(all_of: Column) -> Column:
        active = clusters(F.filter(all_of, lambda v: v["status"] != "exclude"))
        zero = F.struct(nothing.alias("kept"), nothing.alias("lost"))
        # spans of different clusters don't meet, so each is folded on its own, in order
        folded = F.transform(active, lambda c: F.when(F.size(c) == 1, F.struct(c.alias("kept"), nothing.alias("lost"))).otherwise(F.aggregate(c, zero, step)))
        inactive = F.filter(all_of, lambda v: v["status"] == "exclude")
        return let(folded, lambda x: F.concat(F.flatten(F.transform(x, lambda f: f["kept"])), inactive, F.flatten(F.transform(x, lambda f: f["lost"]))))

    return let(verdicts, lambda x: F.when(F.exists(x, lambda v: v["status"] != "exclude"), resolved(x)).otherwise(x))


def allow_key(t: Column) -> Column:
    return F.regexp_replace(strip(F.lower(t)), "[ 　]", "")


def verify(found: DataFrame, allow_terms: list[str] | None = None) -> DataFrame:
    """``extract``'s rows with ``verdicts``. ``allow_terms`` is a parsed allow list (a configuration
    file's terms); for a large one, use ``operators.allow.drop_allowed`` on span rows."""
    keys = sorted({"".join(t.lower().split()) for t in allow_terms or []})

    def one(s: Column) -> Column:
        listed = allow_key(s["text"]).isin(keys) if keys else None
        return verdict(s, s["section_type"], listed)

    found = found.withColumn("verdicts", F.transform("candidates", one))
    return found.withColumn("verdicts", resolve_collisions(F.col("verdicts")))


def explode_verdicts(checked: DataFrame, *keys: str) -> DataFrame:
    """A row for each verdict, in the outer form (see ``recognize.explode_spans``)."""
    return checked.select(*keys, F.explode_outer("verdicts").alias("v")).where("v IS NOT NULL").select(*keys, "v.*")


def by_status(checked: DataFrame, *keys: str, include_review: bool = False) -> DataFrame:
    """Rows of the verdicts to mask (with review ones if asked), the score being the verified one."""
    wanted = ["mask", "review"] if include_review else ["mask"]
    rows = explode_verdicts(checked, *keys).where(F.col("status").isin(wanted))
    return rows.select(*keys, "entity", "start", "end", "text", F.col("verified").alias("score"), "source")


def flat_detections(checked: DataFrame, *keys: str) -> DataFrame:
    """Rows of the verdicts that aren't excluded, with both scores, section and reason."""
    rows = explode_verdicts(checked, *keys).where("status <> 'exclude'")
    return rows.select(*keys, "entity", "text", "start", "end", "score", F.col("verified").alias("verified_score"), "source", "section", "status", "reason")


def mask_verified(checked: DataFrame, text: str = "text", include_review: bool = False) -> DataFrame:
    """``verify``'s rows with ``masked``."""
    wanted = ["mask", "review"] if include_review else ["mask"]
    kept = F.filter("verdicts", lambda v: v["status"].isin(wanted))
    checked = checked.withColumn("kept", F.array_sort(F.transform(kept, lambda v: F.struct(v["start"], v["end"], v["entity"]))))
    # kept spans may still overlap where a better one replaced another: the later one goes
    apart = F.filter("kept", lambda v, i: (i == 0) | (v["start"] >= F.coalesce(F.array_max(F.transform(F.slice("kept", F.lit(1), i), lambda k: k["end"])), F.lit(0))))
    return checked.withColumn("masked", apply_masks(F.col(text), apart)).drop("kept")
