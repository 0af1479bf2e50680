"""Which detector finds which entity: the default rules, analysis by language, routing to rules and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.spans import deduplicate, meaningful, merge_results, no_spans
from maskwell.functions.text import normalize
from maskwell.operators.models import ModelRegistry, Rule, RuleRegistry, with_model_spans
from maskwell.operators.recognize import SOURCES, rule_spans

# The entities that rules and models are asked for by default.
PATTERN_ENTITIES = ["PHONE_NUMBER_JP", "JP_ZIP_CODE", "DATE_OF_BIRTH_JP", "JP_AGE", "JP_GENDER", "EMAIL_ADDRESS"]
MODEL_ENTITIES = ["JP_PERSON", "JP_ADDRESS", "JP_ORGANIZATION", "CUSTOMER_ID_JP"]

#: Rules in the order that breaks ties: name, language (empty: any), entity, description.
_DEFAULT = [
    ("phone_jp", "ja", "PHONE_NUMBER_JP", "Japanese phone numbers"),
    ("zip_jp", "ja", "JP_ZIP_CODE", "Japanese postal codes"),
    ("birth_date", "ja", "DATE_OF_BIRTH_JP", "Japanese birth dates"),
    ("name_keyword", "ja", "JP_PERSON", "Japanese names by keyword"),
    ("age", "ja", "JP_AGE", "Ages"),
    ("gender", "ja", "JP_GENDER", "Genders"),
    ("address", "ja", "JP_ADDRESS", "Japanese addresses by prefecture"),
    ("email", "", "EMAIL_ADDRESS", "Email addresses"),
    ("phone_en", "en", "PHONE_NUMBER", "Phone numbers of the US"),
]


def _build(t: Column, names: list[str]) -> Column:
    return rule_spans(t, recognizers=names)


def default_registry() -> RuleRegistry:
    registry = RuleRegistry()
    for name, language, entity, description in _DEFAULT:
        registry.register(Rule(name, "pattern", language, entity, description, _build, sources=SOURCES[name]))
    return registry


def requested(pattern_entities: list[str] | None = None, model_entities: list[str] | None = None) -> list[str]:
    """Both lists as one, each type once at its first place."""
    return list(dict.fromkeys([*(PATTERN_ENTITIES if pattern_entities is None else pattern_entities), *(MODEL_ENTITIES if model_entities is None else model_entities)]))


def _allowed(spans: Column, allow: list[str] | None) -> Column:
    """Spans whose text is no allowed term, letter by letter."""
    return F.filter(spans, lambda s: ~s["text"].isin(allow)) if allow else spans


def _of_language(t: Column, registry: RuleRegistry, entities: list[str], language: str) -> Column:
    rules = [r for r in registry.select(entities) if r.language in ("", language)]
    return registry.spans(t, rules)


def analyze(
    docs: DataFrame, language: str = "auto", entities: list[str] | None = None, registry: RuleRegistry | None = None, allow: list[str] | None = None,
    text: str = "text", preprocess: bool = False, out: str = "spans",
) -> DataFrame:
    """``docs`` with the rules' spans, resolved. ``auto`` runs the rules of English and of
    Japanese and merges both results by covered positions. Null text is empty."""
    registry, asked = registry or default_registry(), entities or requested()
    docs = docs.withColumn(text, normalize(F.col(text)) if preprocess else F.coalesce(F.col(text), F.lit("")))
    t = F.col(text)
    parts = [_allowed(_of_language(t, registry, asked, lang), allow) for lang in (("en", "ja") if language == "auto" else (language,))]
    # both arrays are a column of their own before they are merged, so no rule runs twice
    docs = docs.withColumn(out, F.concat(*parts))
    merged = merge_results(F.col(out)) if language == "auto" else F.col(out)
    return docs.withColumn(out, deduplicate(meaningful(merged)))


def analyze_routed(
    docs: DataFrame, models: ModelRegistry, language: str = "auto", pattern_entities: list[str] | None = None, model_entities: list[str] | None = None,
    registry: RuleRegistry | None = None, allow: list[str] | None = None, least: float = 0.8, text: str = "text", preprocess: bool = False, out: str = "spans",
) -> DataFrame:
    """``docs`` with spans of both kinds, resolved: ``pattern_entities`` from the rules,
    ``model_entities`` from the default models of the language. The results are put
    one after the other, unmerged; the allow list is for the rules' alone."""
    registry = registry or default_registry()
    by_rule = PATTERN_ENTITIES if pattern_entities is None else pattern_entities
    by_model = MODEL_ENTITIES if model_entities is None else model_entities
    docs = docs.withColumn(text, normalize(F.col(text)) if preprocess else F.coalesce(F.col(text), F.lit("")))
    t = F.col(text)
    parts = [_allowed(_of_language(t, registry, by_rule, lang), allow) for lang in (("en", "ja") if language == "auto" else (language,))]
    docs, taken = docs.withColumn(out, F.concat(*parts)), [out]
    for i, spec in enumerate(models.specs_for(language, by_model)):
        taken.append(f"{out}_model_{i}")
        docs = with_model_spans(docs, models, spec, by_model, text, taken[-1], least)
    spans = F.concat(*[F.coalesce(F.col(c), no_spans()) for c in taken])
    return docs.withColumn(out, spans).drop(*taken[1:]).withColumn(out, deduplicate(meaningful(F.col(out))))
