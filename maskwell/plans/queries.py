"""Registered queries over ``documents`` plus small fixtures in Japanese and English.

The driver's documents hold no Japanese, so each query adds the fixture's rows.
The SQL that states what they return is in ``oracle``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.spans import Pattern, decode_labels, decode_words, deduplicate, find, find_all, plain
from maskwell.functions.text import encode_lines, is_japanese, narrow_punctuation, normalize, reconstruct, section_text, segments
from maskwell.operators import allow, candidates, generated, models, recognize, results, resumes, routing
from maskwell.plans import fixtures, oracle
from maskwell.sources import files

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the rules are CPU-bound: an input that makes fewer splits than there are cores is spread over them
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split:
        docs = docs.repartition(cores)
    extra = spark.createDataFrame([*fixtures.FIXTURE, (-5, None)], "doc_id long, text string").coalesce(1)
    return docs.unionByName(extra)


def _span_query(entity: str, pattern: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))
        found = docs.select("doc_id", find(F.col("text"), pattern, entity, 1.0, "rule").alias("spans"))
        rows = recognize.explode_spans(found, "doc_id")
        return rows.select("doc_id", "entity", F.col("start").cast("long"), F.col("end").cast("long"), "text")

    return query


SPAN_RULES = {
    "email_spans": ("EMAIL_ADDRESS", fixed.EMAIL_ASCII),
    "us_phone_spans": ("PHONE_NUMBER", fixed.PHONE_EN[1]),
    "us_phone_plus_spans": ("PHONE_NUMBER", fixed.PHONE_EN[0]),
    "jp_phone_spans": ("PHONE_NUMBER_JP", fixed.PHONE_JP[0]),
    "jp_zip_spans": ("JP_ZIP_CODE", r"\d{3}-\d{4}"),
    "age_spans": ("JP_AGE", fixed.DOCUMENT_PATTERNS[3][2]),
    "gender_spans": ("JP_GENDER", fixed.DOCUMENT_PATTERNS[5][2]),
    "date_slash_spans": ("DATE", fixed.BIRTH_DATE_PATTERNS[0]),
    "date_kanji_spans": ("DATE", fixed.BIRTH_DATE_PATTERNS[2]),
}


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normalize(F.col("text"))
    return corpus(spark, sf_dir).select("doc_id", t.alias("text"), is_japanese(F.col("text")).alias("japanese"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))
    return docs.withColumn("segments", segments(F.col("text")))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the outer form, see recognize.explode_spans
    rows = _segmented(spark, sf_dir).select("doc_id", F.explode_outer("segments").alias("g")).where("g IS NOT NULL").select("doc_id", "g.*")
    longs = [F.col(c).cast("long") for c in ("line_number", "start", "end")]
    return rows.select("doc_id", *longs, "section_id", "section_type", "text")


def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_segments(spark, sf_dir).groupBy("doc_id", "section_type").agg(F.count("*").alias("lines"))


def contact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("doc_id", section_text(F.col("segments"), "contact").alias("contact"))


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails and US phones, which can't overlap, masked; the flagship query."""
    asked = ["EMAIL_ADDRESS", "PHONE_NUMBER"]
    return recognize.mask(corpus(spark, sf_dir), asked).select("doc_id", "masked", F.col("n_entities").cast("long"))


def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize.detect(corpus(spark, sf_dir), ["EMAIL_ADDRESS", "PHONE_NUMBER"])
    return recognize.entity_counts(found).select("entity", "n")


def _longs(rows: DataFrame) -> DataFrame:
    """Offsets as long, as the SQL has them."""
    return rows.withColumns({c: F.col(c).cast("long") for c in ("start", "end") if c in rows.columns})


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.detect(corpus(spark, sf_dir))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document rules, resolved."""
    return _longs(recognize.explode_spans(_detected(spark, sf_dir), "doc_id"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(recognize.log_lines(_detected(spark, sf_dir), "doc_id"))


def masked_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default entity types masked."""
    return recognize.mask(corpus(spark, sf_dir)).select("doc_id", "masked", F.col("n_entities").cast("long"))


def entity_stats_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.entity_counts(_detected(spark, sf_dir)).select("entity", "n")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.assemble(_detected(spark, sf_dir))


def entity_counts_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type map of each document's result, as rows."""
    rows = _results(spark, sf_dir).select("doc_id", F.col("result.stats.total_entities").cast("long").alias("total"), F.explode_outer("result.stats.entities_by_type").alias("entity", "n"))
    return rows.where("entity IS NOT NULL").select("doc_id", "total", "entity", F.col("n").cast("long").alias("n"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.detection_report(_detected(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp"))


def detection_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log section, with a fixed time."""
    return _reports(spark, sf_dir).select("doc_id", "report")


def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections read back from the log sections."""
    rows = _reports(spark, sf_dir).select("doc_id", F.explode_outer(results.parse_report(F.col("report"))).alias("d")).where("d IS NOT NULL")
    return _longs(rows.select("doc_id", "d.*"))


def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required categories that a document's last log section lacks."""
    types = recognize.parse_last_log_section(F.col("report"))
    return _reports(spark, sf_dir).select("doc_id", F.array_join(results.missing_types(types), ",").alias("missing"))


def recognizer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumn("text", normalize(F.col("text")))
    rows = results.audit(docs, routing.default_registry(), "doc_id")
    return _longs(rows).withColumn("ord", F.col("ord").cast("long"))


def auto_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of both languages, merged by covered positions, less two allowed addresses."""
    asked = [*routing.requested(), "PHONE_NUMBER"]
    found = routing.analyze(corpus(spark, sf_dir), "auto", asked, allow=["help@example.com", "taro@example.com"], preprocess=True)
    return _longs(recognize.explode_spans(found, "doc_id"))


class StaffNumbers:
    """A stand-in for a model, of one pattern."""

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        return [[("ID", m.start(), m.end(), 0.875) for m in re.finditer(r"EMP[0-9]{5}", t)] + [("LOW", 0, min(3, len(t)), 0.5)] for t in texts]


STAFF_MODEL = models.ModelSpec("staff", "staff numbers", "ja", ("CUSTOMER_ID_JP",), StaffNumbers, labels={"ID": "CUSTOMER_ID_JP", "LOW": "CUSTOMER_ID_JP"})


def routed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern entities from the rules, customer ids from a model."""
    registry = models.ModelRegistry([STAFF_MODEL], {"ja": "staff"})
    found = routing.analyze_routed(corpus(spark, sf_dir), registry, preprocess=True)
    return _longs(recognize.explode_spans(found, "doc_id"))


def _dictionary(spark: SparkSession) -> DataFrame:
    return allow.parse_dictionary(spark.createDataFrame(list(enumerate(fixtures.DICTIONARY)), "position long, value string"))


def allow_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark).select("term", "position", F.col("nth").cast("long").alias("nth"))


def allowlist_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose text is no dictionary term."""
    return allow.drop_allowed(document_spans(spark, sf_dir), _dictionary(spark))


def reconstructed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("doc_id", reconstruct(F.col("segments")).alias("text"))


def section_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails with the section of the line they start in."""
    segs = line_segments(spark, sf_dir).select("doc_id", "start", "end", "section_id", "section_type")
    return results.locate(email_spans(spark, sf_dir), segs)


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps between unresolved phone and zip spans."""
    t = normalize(F.col("text"))
    docs = corpus(spark, sf_dir).select("doc_id", t.alias("text"))
    rules = [("PHONE_NUMBER_JP", fixed.PHONE_JP[0], "-"), ("PHONE_NUMBER", fixed.PHONE_EN[1], "("), ("JP_ZIP_CODE", r"\d{3}-\d{4}", "-")]
    spans = plain(find_all(F.col("text"), [Pattern(e, p, 1.0, "rule", (x,)) for e, p, x in rules]))
    return results.overlapping_pairs(_longs(recognize.explode_spans(docs.select("doc_id", spans.alias("spans")), "doc_id")))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.verify(candidates.extract(corpus(spark, sf_dir)))


def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line candidates, verified, with their verdicts."""
    return _longs(candidates.explode_verdicts(_verified(spark, sf_dir), "doc_id"))


def status_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(candidates.by_status(_verified(spark, sf_dir), "doc_id", include_review=True))


def flat_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(candidates.flat_detections(_verified(spark, sf_dir), "doc_id"))


def masked_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mask_verified(_verified(spark, sf_dir)).select("doc_id", "masked")


def dual_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document spans that a verified candidate of the same category confirms."""
    kinds = {e: c for c, es in fixed.CATEGORIES.items() for e in es}
    return recognize.confirm_by_both(document_spans(spark, sf_dir), status_filtered(spark, sf_dir), kinds)


def confident_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(spark, sf_dir).withColumn("spans", models.confident(F.col("spans")))
    return _longs(recognize.explode_spans(found, "doc_id"))


def recall_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame(fixtures.EXPECTED, "doc_id long, text string")
    return results.recall(results.recalled(expected, document_spans(spark, sf_dir)), "doc_id")


def _with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's documents, normalised, with entities of a language pipeline."""
    docs = corpus(spark, sf_dir).withColumn("text", normalize(F.col("text")))
    rows = spark.createDataFrame(fixtures.PIPELINE_ENTITIES, "doc_id long, label string, word string").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("label", "word"))).alias("words"))
    at = lambda w: F.instr(F.col("text"), w["word"]) - 1
    found = F.transform("words", lambda w: F.struct(w["label"].alias("label"), at(w).alias("start"), (at(w) + F.length(w["word"])).alias("end")))
    return docs.join(F.broadcast(rows), "doc_id", "left").withColumn("entities", found)


def ner_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and places of a language pipeline, scored by context words."""
    docs = _with_entities(spark, sf_dir)
    spans = F.concat(models.person_entities(F.col("text"), F.col("entities")), models.address_entities(F.col("text"), F.col("entities")))
    return _longs(recognize.explode_spans(docs.select("doc_id", spans.alias("spans")), "doc_id")).drop("source")


def ner_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language pipeline's entities among the line candidates, with their sections."""
    docs = _with_entities(spark, sf_dir)
    docs = docs.withColumn("ner", models.ner_candidates(F.col("text"), F.col("entities")))
    found = candidates.extract(docs, ner="ner")
    rows = found.select("doc_id", F.explode_outer("candidates").alias("c")).where("c.source LIKE 'ner:%'").select("doc_id", "c.entity", "c.start", "c.end", "c.text", "c.score", "c.section_type")
    return _longs(rows)


def decoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(fixtures.TOKENS, "id long, text string, tokens array<struct<label:string,score:double,start:int,end:int>>")
    spans = decode_labels(F.col("tokens"), fixtures.TOKEN_LABELS, F.col("text"))
    return _longs(recognize.explode_spans(df.select("id", spans.alias("spans")), "id")).drop("source")


def decoded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(fixtures.WORDS, "id long, text string, tokens array<struct<label:string,score:double,word:string>>")
    spans = decode_words(F.col("tokens"), fixtures.TOKEN_LABELS, F.col("text"))
    return _longs(recognize.explode_spans(df.select("id", spans.alias("spans")), "id")).drop("source")


def _recovered(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(fixtures.GENERATED, "id long, text string, generated string")
    return generated.with_recovered_spans(df, [*fixed.GENERATED_TAGS.values()])


def recovered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans recovered from generated text."""
    rows = _longs(recognize.explode_spans(_recovered(spark), "id", spans="recovered"))
    return rows.select("id", "entity", "start", "end", "text", F.round("score", 6).alias("score"))


def discarded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark).select("id", F.explode_outer("discarded").alias("d")).where("d IS NOT NULL").select("id", "d.tag", "d.reason")


def generation_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return corpus(spark, sf_dir).select("doc_id", encode_lines(t).alias("encoded"), narrow_punctuation(t).alias("narrow"))


def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a generated .docx (its lines as paragraphs), read back through the dispatch."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [files.write_docx((t or "").split("\n")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    made = corpus(spark, sf_dir).select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".DOCX")).alias("path"), "text").mapInArrow(build, "path string, content binary")
    read = files.extract_text(made)
    return read.select(F.regexp_extract("path", r"(-?\d+)\.", 1).cast("long").alias("doc_id"), "text", "error")


def _resumes(spark: SparkSession) -> DataFrame:
    rows = [
        (i, lang, job, (name, email, f"{i} Street", "000-0000", "000", "1990-01-01"), (school, degree, year), [(company, position, since, until, f"Work at {company}.")], tech, certs)
        for i, lang, job, tech, certs, name, email, school, degree, year, company, position, since, until in fixtures.RESUMES
    ]
    return spark.createDataFrame(rows, resumes.RESUME)


def resume_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.job_titles(_resumes(spark))


def resume_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most common technologies; a top-k report."""
    return resumes.top_technologies(_resumes(spark))


def resume_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.of_language(_resumes(spark), "Japanese")


def resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.as_text(_resumes(spark)).select("id", "text")


def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the projected texts, by the structure rules."""
    segs = resumes.as_text(_resumes(spark)).withColumn("segments", segments(normalize(F.col("text"))))
    rows = segs.select("id", F.explode_outer("segments").alias("g")).where("g IS NOT NULL")
    return rows.groupBy("id", F.col("g.section_type").alias("section_type")).agg(F.count("*").alias("lines"))


def score_resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare phone and zip patterns, resolved by score."""
    docs = corpus(spark, sf_dir).withColumn("text", normalize(F.col("text")))
    rules = [("PHONE_NUMBER_JP", fixed.PHONE_JP[0], 0.9, "-"), ("JP_ZIP_CODE", r"\d{3}-\d{4}", 0.95, "-"), ("PHONE_NUMBER", fixed.PHONE_EN[1], 0.92, "(")]
    found = plain(find_all(F.col("text"), [Pattern(e, p, s, "rule", (x,)) for e, p, s, x in rules]))
    rows = recognize.explode_spans(docs.select("doc_id", deduplicate(found).alias("spans")), "doc_id")
    return _longs(rows).select("doc_id", "entity", "start", "end", "text", "score")


_SPAN_QUERIES = {name: _span_query(*rule) for name, rule in SPAN_RULES.items()}
email_spans = _SPAN_QUERIES["email_spans"]
QUERIES = _SPAN_QUERIES | {
    f.__name__: f
    for f in (
        normalized_text, line_segments, section_summary, contact_text, masked_documents, entity_stats, document_spans, log_lines, verified_candidates,
        masked_all_types, entity_stats_all_types, entity_counts_by_document, detection_reports, parsed_reports, missing_types, recognizer_audit,
        auto_language_spans, routed_spans, allow_terms, allowlist_excluded, reconstructed_text, section_located, overlap_pairs, status_filtered,
        flat_detections, masked_verified, dual_confirmed, confident_spans, recall_by_document, ner_scored, ner_candidates, decoded_labels, decoded_words,
        recovered_spans, discarded_tags, generation_codec, docx_text, resume_titles, resume_technologies, resume_emails, resume_text, resume_sections,
        score_resolved_spans,
    )
}


def oracle_sql() -> dict[str, str]:
    return oracle.all_queries()
