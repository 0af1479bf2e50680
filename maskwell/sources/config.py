"""Configuration files: YAML settings with defaults, allow-list dictionaries."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.operators.allow import parse_dictionary
from maskwell.operators.routing import MODEL_ENTITIES, PATTERN_ENTITIES


@dataclass(frozen=True)
class Config:
    """Settings of a run; what a file leaves out has its default."""

    pattern_entities: list[str] = field(default_factory=lambda: list(PATTERN_ENTITIES))
    model_entities: list[str] = field(default_factory=lambda: list(MODEL_ENTITIES))
    masks: dict[str, str] = field(default_factory=lambda: dict(fixed.MASKS))
    default_mask: str = fixed.DEFAULT_MASK
    models_enabled: bool = False
    least_confidence: float = 0.8
    categories: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.CATEGORIES))
    entities_to_mask: list[str] = field(default_factory=list)
    allow_enabled: bool = False
    dictionary_path: str | None = None
    additional_terms: list[str] = field(default_factory=list)
    defaults_by_language: dict[str, str] = field(default_factory=dict)
    raw: dict = field(default_factory=dict)


def read_yaml(path: str | None) -> dict:
    """The file's mapping; a missing or empty file is an empty one. Read on the driver."""
    import yaml

    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load(path: str | None = None, raw: dict | None = None) -> Config:
    raw = read_yaml(path) if raw is None else raw
    base = Config()
    part = lambda *names: next((v for v in [_at(raw, names)] if v is not None), None)
    pick = lambda default, *names: default if part(*names) is None else part(*names)
    return Config(
        pick(base.pattern_entities, "detection_strategy", "pattern_entities"),
        pick(base.model_entities, "detection_strategy", "transformer_entities"),
        pick(base.masks, "masking", "entity_masks"),
        pick(base.default_mask, "masking", "default_mask"),
        pick(False, "transformer", "enabled"),
        pick(base.least_confidence, "transformer", "min_confidence"),
        pick(base.categories, "entity_categories"),
        pick([], "entities_to_mask"),
        pick(False, "allow_list", "enabled"),
        part("allow_list", "dictionary_path"),
        pick([], "allow_list", "additional_terms"),
        pick({}, "models", "defaults"),
        raw,
    )


def _at(tree: dict, names: tuple[str, ...]):
    for name in names:
        tree = tree.get(name) if isinstance(tree, dict) else None
    return tree


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """position, value of a dictionary file's lines, in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode_outer(F.split("value", "\r?\n")).alias("position", "value")).where("value IS NOT NULL")


def allow_terms(spark: SparkSession, config: Config, folder: str | None = None) -> list[str]:
    """The allow list of a configuration: the dictionary's terms, then the additional ones;
    empty unless enabled. A relative path is one of ``folder``. A configuration's list is
    small by its nature; for a large one join rows with ``allow.drop_allowed``."""
    if not config.allow_enabled:
        return []
    terms: list[str] = []
    if config.dictionary_path:
        path = config.dictionary_path if "/" == config.dictionary_path[:1] or ":" in config.dictionary_path else f"{folder or '.'}/{config.dictionary_path}"
        terms = [r.term for r in parse_dictionary(dictionary_lines(spark, path)).orderBy("position", "nth").collect()]
    return [*terms, *config.additional_terms]
