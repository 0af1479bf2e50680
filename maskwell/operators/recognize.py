"""Document recognizers: rule spans of whole texts, resolved and masked, all in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.arrays import let
from maskwell.functions.spans import Pattern, apply_masks, around, deduplicate, find_all, in_context, make, meaningful, plain, with_score
from maskwell.functions.text import contains_any, normalize

#: Our own rule for context words: one within this many characters before the span lifts its score.
CONTEXT_BEFORE, CONTEXT_LIFT = 50, 0.35
DEFAULT_ENTITIES = [
    "PHONE_NUMBER_JP", "JP_ZIP_CODE", "DATE_OF_BIRTH_JP", "JP_AGE", "JP_GENDER", "EMAIL_ADDRESS", "JP_PERSON", "JP_ADDRESS",
]


def _rules() -> list[tuple[str, Pattern]]:
    """(recognizer, pattern) in the order that breaks ties."""
    kinds = {"phone_jp": "phone_jp", "mobile_jp": "phone_jp", "zip_jp": "zip_jp", "age_sai": "age", "age_sai_short": "age", "gender": "gender"}
    out = [(kinds[name], Pattern(entity, pattern, score, f"rule:{name}", tuple(fixed.NEEDED[name]))) for name, entity, pattern, score in fixed.DOCUMENT_PATTERNS]
    # a text without a birth word has no birth date
    out += [("birth_date", Pattern("DATE_OF_BIRTH_JP", p, 1.0, "rule:birth_date", tuple(fixed.BIRTH_WORDS))) for p in fixed.BIRTH_DATE_PATTERNS]
    out.append(("address", Pattern("JP_ADDRESS", fixed.ADDRESS_PATTERN, 0.7, "rule:address", ("東京都", "北海道", "府", "県"))))
    out += [("name_keyword", Pattern("JP_PERSON", p, 0.85, "rule:name_keyword", (w,))) for w, p in zip(fixed.NAME_WORDS, fixed.NAME_PATTERNS, strict=True)]
    out.append(("email", Pattern("EMAIL_ADDRESS", fixed.EMAIL, 1.0, "rule:email", ("@",))))
    out += [("phone_en", Pattern("PHONE_NUMBER", p, 0.9, "rule:phone_en", (w,))) for p, w in zip(fixed.PHONE_EN, ("+1", "("), strict=True)]
    return out


RULES = _rules()
#: Recognizer -> the sources of its spans.
SOURCES = {name: tuple(dict.fromkeys(p.source for n, p in RULES if n == name)) for name, _ in RULES}


def rule_spans(t: Column, entities: list[str] | None = None, recognizers: list[str] | None = None) -> Column:
    """Unresolved spans of the rules for the entities (and of the recognizers) asked for.

    Context decides on scores and on what a match is: a context word in the 50
    characters before lifts phones, zips, ages and genders; a birth date needs a
    birth word within 50 characters, and a career word within 30 drops it unless
    a birth word stands in the 20 before; an address ends in no name of a school
    or company and is sure beside an address word; a name is what follows its
    keyword, to the end of the match, of two characters or more.
    """
    chosen = [p for name, p in RULES if (entities is None or p.entity in entities) and (recognizers is None or name in recognizers)]
    have = {p.entity for p in chosen}
    found = find_all(t, chosen)
    if "JP_PERSON" in have:
        numbered = [(i, "(?U)" + p.pattern) for i, p in enumerate(chosen) if p.entity == "JP_PERSON"]
        named = lambda s: F.coalesce(*[F.when(s["rule"] == i, F.regexp_extract(s["text"], java, 1)) for i, java in numbered])
        cut = lambda s: let(named(s), lambda name: make(s["entity"], s["end"] - F.length(name), s["end"], name, s["score"], s["source"]))
        found = F.transform(found, lambda s: F.when(s["entity"] == "JP_PERSON", cut(s)).otherwise(with_score(s, s["score"])))
        found = F.filter(found, lambda s: (s["entity"] != "JP_PERSON") | (F.length(F.translate(s["text"], " 　", "")) >= 2))
    else:
        found = plain(found)
    if "JP_ADDRESS" in have:
        ends = "(?:" + "|".join(fixed.NOT_ADDRESS_SUFFIXES) + r")\z"
        found = F.filter(found, lambda s: (s["entity"] != "JP_ADDRESS") | ~s["text"].rlike(ends))
    contextual = have & {*fixed.CONTEXT_WORDS, "DATE_OF_BIRTH_JP", "JP_ADDRESS"}
    if not contextual:
        return found

    def judged(x: Column, parts: Column) -> Column:
        before = lambda s, n: around(parts, s["start"], s["start"], n, 0)
        near = lambda s, n: around(parts, s["start"], s["end"], n, n)
        if "DATE_OF_BIRTH_JP" in have:
            is_birth = lambda s: contains_any(near(s, 50), fixed.BIRTH_WORDS) & (
                contains_any(before(s, 20), fixed.BIRTH_WORDS) | ~contains_any(near(s, 30), fixed.CAREER_WORDS)
            )
            x = F.filter(x, lambda s: (s["entity"] != "DATE_OF_BIRTH_JP") | is_birth(s))

        def score(s: Column) -> Column:
            out = s["score"]
            for entity, words in fixed.CONTEXT_WORDS.items():
                if entity in have:
                    lifted = F.least(F.lit(1.0), s["score"] + CONTEXT_LIFT)
                    out = F.when((s["entity"] == entity) & contains_any(before(s, CONTEXT_BEFORE), words), lifted).otherwise(out)
            if "JP_ADDRESS" in have:
                out = F.when((s["entity"] == "JP_ADDRESS") & contains_any(near(s, 50), fixed.ADDRESS_WORDS), 1.0).otherwise(out)
            return out

        return F.transform(x, lambda s: with_score(s, score(s)))

    return in_context(t, found, judged)


def detect(
    docs: DataFrame, entities: list[str] | None = None, text: str = "text", preprocess: bool = True, out: str = "spans",
    extra: Column | None = None,
) -> DataFrame:
    """``docs`` with the text that offsets refer to in ``text`` and the resolved spans in ``out``.

    Null text counts as empty. Rules of entities not asked for aren't in the
    plan. ``extra`` adds an array of spans from elsewhere, such as a model.
    """
    asked = entities or DEFAULT_ENTITIES
    docs = docs.withColumn(text, normalize(F.col(text)) if preprocess else F.coalesce(F.col(text), F.lit("")))
    spans = rule_spans(F.col(text), asked)
    docs = docs.withColumn(out, spans if extra is None else F.concat(spans, extra))
    return docs.withColumn(out, deduplicate(meaningful(F.col(out))))


def mask(docs: DataFrame, entities: list[str] | None = None, text: str = "text", **options) -> DataFrame:
    """``detect`` plus ``masked`` (the masked text) and ``n_entities``."""
    found = detect(docs, entities, text, **options)
    return found.withColumn("masked", apply_masks(F.col(text), F.col("spans"))).withColumn("n_entities", F.size("spans"))


def explode_spans(found: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    # the outer form: for explode, the optimizer adds a filter on the array's size below,
    # with all rules in it, and evaluates them a second time
    rows = found.select(*keys, F.explode_outer(spans).alias("s")).where("s IS NOT NULL")
    return rows.select(*keys, "s.*")


def entity_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Rows per entity type, with map-side partial aggregation."""
    return explode_spans(found, *keys).groupBy(*keys, "entity").agg(F.count("*").alias("n"))


def log_lines(found: DataFrame, *keys: str) -> DataFrame:
    rows = explode_spans(found, *keys)
    return rows.select(*keys, "start", F.format_string('[%s] "%s" (score: %.2f, pos: %d-%d)', "entity", "text", "score", "start", "end").alias("line"))


def parse_last_log_section(log: Column) -> Column:
    """Distinct entity names of the last section between rules of 60 or more ``=``; none if there are fewer than three parts."""
    parts = F.split(log, "={60,}", -1)
    found = F.array_distinct(F.regexp_extract_all(F.element_at(parts, -1), F.lit(r"\[([A-Z_]+)\]"), F.lit(1)))
    return F.when(F.size(parts) >= 3, found).otherwise(F.array().cast("array<string>"))


def confirm_by_both(spans: DataFrame, other: DataFrame, categories: dict[str, str], key: str = "doc_id") -> DataFrame:
    """Spans of one detector that another confirms: same category, overlap of at least half the shorter span."""
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    kind = lambda c: F.coalesce(F.try_element_at(table, c), c)
    a, b = spans.alias("a"), other.alias("b")
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    shorter = F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (kind(F.col("a.entity")) == kind(F.col("b.entity")))
    return a.join(b, same & (shared > 0) & (shared * 2 >= shorter), "left_semi")
