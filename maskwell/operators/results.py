"""Results of masking: per-document assembly, logs, audits, completeness and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.spans import apply_masks
from maskwell.functions.text import is_japanese
from maskwell.operators.models import RuleRegistry

RULE = "=" * 60
#: One line of a detection log.
LINE = '[%s] "%s" (score: %.2f, pos: %d-%d)'


def type_counts(spans: Column) -> Column:
    """Entity type -> number of spans, types in order of first appearance."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["entity"]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(spans, lambda s: s["entity"] == k))))


def assemble(found: DataFrame, text: str = "text", spans: str = "spans", out: str = "result") -> DataFrame:
    """``found`` with a masking result: masked_text, entities (type, text, score, start, end)
    and stats (total_entities, entities_by_type)."""
    entities = F.transform(spans, lambda s: F.struct(s["entity"].alias("type"), s["text"].alias("text"), s["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end")))
    stats = F.struct(F.size(spans).alias("total_entities"), type_counts(F.col(spans)).alias("entities_by_type"))
    return found.withColumn(out, F.struct(apply_masks(F.col(text), F.col(spans)).alias("masked_text"), entities.alias("entities"), stats.alias("stats")))


def entities_info(result: Column) -> Column:
    """The entities of a masking result as JSON, null if there are none."""
    return F.when(F.size(result["entities"]) > 0, F.to_json(result["entities"]))


def detection_report(found: DataFrame, at: Column | None = None, spans: str = "spans", out: str = "report") -> DataFrame:
    """Rows with spans, with the section that goes to their log: a rule, the time, a rule,
    a line for each span and the total. ``at`` is the time written, by default now."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
    lines = F.transform(spans, lambda s: F.format_string(LINE, s["entity"], s["text"], s["score"], s["start"], s["end"]))
    head = F.array(F.lit(""), F.lit(RULE), F.concat(F.lit("Masking Log - "), stamp), F.lit(RULE))
    total = F.array(F.concat(F.lit("Total: "), F.size(spans).cast("string"), F.lit(" entities masked")))
    # as a generator's output: a filter on the spans would go below and evaluate them a second time
    report = F.when(F.size(spans) > 0, F.array(F.array_join(F.concat(head, lines, total), "\n")))
    return found.withColumn(out, F.explode_outer(report)).where(F.col(out).isNotNull())


def parse_report(log: Column) -> Column:
    """The detections (entity, text, score, start, end) of a log's lines."""
    line = r'\[([A-Z_]+)\] "((?s:.*?))" \(score: ([0-9.]+), pos: (\d+)-(\d+)\)'
    hits = F.regexp_extract_all(log, F.lit(line), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, line, i)
    return F.transform(hits, lambda x: F.struct(
        part(x, 1).alias("entity"), part(x, 2).alias("text"), part(x, 3).cast("double").alias("score"),
        part(x, 4).cast("int").alias("start"), part(x, 5).cast("int").alias("end")))


def missing_types(types: Column, required: dict[str, list[str]] | None = None) -> Column:
    """Names of the required categories of which no accepted type is among ``types``."""
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("accepted")) for k, v in (required or fixed.REQUIRED_TYPES).items()])
    return F.transform(F.filter(table, lambda c: ~F.arrays_overlap(c["accepted"], types)), lambda c: c["name"])


def audit(docs: DataFrame, registry: RuleRegistry, *keys: str, text: str = "text") -> DataFrame:
    """A row for each finding of each rule of the text's language, none resolved against
    another: keys, language, ord (by start, score down, rule), recognizer, entity, score,
    start, end, text (line ends as spaces). Rules without a language are of both."""
    docs = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("language", F.when(is_japanese(F.col(text)), "ja").otherwise("en"))
    table = [(source, r.name, r.language) for r in registry.rules for source in (r.sources or (r.name,))]
    names = F.create_map(*[F.lit(x) for source, name, _ in table for x in (source, name)])
    languages = F.create_map(*[F.lit(x) for source, _, language in table for x in (source, language)])
    docs = docs.withColumn("found", registry.spans(F.col(text), registry.rules))
    spoken = F.filter("found", lambda s: F.try_element_at(languages, s["source"]).isin("", F.col("language")))
    ordered = F.array_sort(F.transform(spoken, lambda s: F.struct(
        s["start"].alias("start"), (-s["score"]).alias("less"), F.try_element_at(names, s["source"]).alias("recognizer"), s["end"].alias("end"), s["entity"].alias("entity"), s["text"].alias("text"))))
    rows = docs.select(*keys, "language", F.posexplode_outer(ordered).alias("ord", "f")).where("f IS NOT NULL")
    return rows.select(
        *keys, "language", "ord", "f.recognizer", "f.entity", (-F.col("f.less")).alias("score"), "f.start", "f.end", F.replace("f.text", F.lit("\n"), F.lit(" ")).alias("text")
    )


def recalled(expected: DataFrame, detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """``expected``(key, text) with ``found``: does a detection of the same key hold it, or it hold one?"""
    e = expected.withColumn("expected_row", F.monotonically_increasing_id())
    d = detected.select(F.col(key).alias("d_key"), F.trim("text").alias("d_text")).where("d_text <> ''").distinct()
    hit = e.join(d, (F.col(key) == F.col("d_key")) & (F.contains("text", "d_text") | F.contains("d_text", "text")), "left_semi").select("expected_row", F.lit(True).alias("found"))
    return e.join(hit, "expected_row", "left").select(*expected.columns, F.coalesce("found", F.lit(False)).alias("found"))


def recall(marked: DataFrame, *keys: str) -> DataFrame:
    return marked.groupBy(*keys).agg(F.avg(F.col("found").cast("double")).alias("recall"), F.count("*").alias("expected"))


def locate(spans: DataFrame, segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Span rows with section_id and section_type of the segment that holds their start
    (``unknown`` without one): a range join within a document."""
    s, g = spans.alias("s"), segs.alias("g")
    inside = (F.col(f"s.{key}") == F.col(f"g.{key}")) & (F.col("g.start") <= F.col("s.start")) & (F.col("s.start") < F.col("g.end"))
    return s.join(g, inside, "left").select("s.*", F.coalesce("g.section_id", F.lit("unknown")).alias("section_id"), F.coalesce("g.section_type", F.lit("unknown")).alias("section_type"))


def overlapping_pairs(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of one document that overlap, each once, with the shared length."""
    cols = ["entity", "start", "end"]
    a = spans.select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = spans.select(F.col(key).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in cols])
    before = F.struct("a_start", "a_end", "a_entity") < F.struct("b_start", "b_end", "b_entity")
    rows = a.join(b, (F.col(key) == F.col("b_key")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & before)
    return rows.drop("b_key").withColumn("shared", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
