"""Seams for models: rule and model registries, lazy model instances on executors, NER spans.

Models are supplied by the caller; none comes with the package. A model is an
object with ``spans(texts) -> list of lists of (label or entity, start, end, score)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import fixed
from maskwell.functions.spans import around, in_context, make, no_spans
from maskwell.functions.text import contains_any

RULE_TYPES = ("pattern", "ner_ginza", "ner_presidio", "ner_transformer", "ner_gpt_masker")


@dataclass(frozen=True)
class Rule:
    """A recognizer: what it finds, in which language, and its spans as an expression of the
    text. ``build`` takes names of rules: neighbours that share it are built in one go."""

    name: str
    kind: str
    language: str
    entity: str
    description: str
    build: Callable[[Column, list[str]], Column]
    requires_nlp: bool = False
    #: Sources of the rule's spans, by which findings of several rules are told apart.
    sources: tuple[str, ...] = ()


@dataclass
class RuleRegistry:
    """Rules in order; the order breaks ties between equal spans."""

    rules: list[Rule] = field(default_factory=list)

    def register(self, rule: Rule) -> None:
        if rule.kind not in RULE_TYPES:
            raise ValueError(f"unknown type of rule: {rule.kind}")
        self.rules.append(rule)

    def by_type(self, kind: str) -> list[Rule]:
        return [r for r in self.rules if r.kind == kind]

    def by_language(self, language: str) -> list[Rule]:
        return [r for r in self.rules if r.language == language]

    def select(self, entities: list[str] | None = None, language: str | None = None, kinds: list[str] | None = None) -> list[Rule]:
        """The rules that a request needs; the others never enter the plan."""
        return [
            r for r in self.rules
            if (entities is None or r.entity in entities) and (language is None or r.language == language) and (kinds is None or r.kind in kinds)
        ]

    def spans(self, t: Column, rules: list[Rule]) -> Column:
        groups: list[tuple[Callable, list[str]]] = []
        for r in rules:
            if groups and groups[-1][0] is r.build:
                groups[-1][1].append(r.name)
            else:
                groups.append((r.build, [r.name]))
        return F.concat(*[build(t, names) for build, names in groups]) if groups else no_spans()

    def summary(self) -> str:
        lines = []
        for kind in RULE_TYPES:
            if mine := self.by_type(kind):
                lines += [f"{kind}:", *[f"  [{r.language}] {r.entity}: {r.description}" for r in mine]]
        return "\n".join([*lines, f"{len(self.rules)} rules"])


@dataclass(frozen=True)
class ModelInfo:
    id: str
    name: str
    language: str
    entities: tuple[str, ...]
    status: str
    description: str


@dataclass(frozen=True)
class ModelSpec:
    """A model that can be made on an executor. ``factory`` is pickled, the model isn't."""

    id: str
    name: str
    language: str
    entities: tuple[str, ...]
    factory: Callable[[], object]
    kind: str = "transformer"
    labels: dict[str, str] | None = None
    description: str = ""


#: One process's models and failed loads, by id.
_LOADED: dict[str, object] = {}
_FAILED: dict[str, str] = {}


class ModelRegistry:
    """Model specifications by id and the default id of each language."""

    def __init__(self, specs: list[ModelSpec], defaults: dict[str, str] | None = None):
        self.specs, self.defaults = {s.id: s for s in specs}, dict(defaults or {})

    def get(self, model_id: str) -> object | None:
        """This process's instance, made at first use. Unknown ids and models whose
        load failed once give None; the failure is kept and not tried again."""
        if model_id not in self.specs or model_id in _FAILED:
            return None
        if model_id not in _LOADED:
            try:
                _LOADED[model_id] = self.specs[model_id].factory()
            except Exception as e:  # noqa: BLE001 - any failure of foreign code is recorded
                _FAILED[model_id] = str(e)
                return None
        return _LOADED[model_id]

    def default_id(self, language: str) -> str | None:
        return self.defaults.get(language)

    def for_language(self, language: str) -> object | None:
        name = self.default_id(language)
        return self.get(name) if name else None

    def specs_for(self, language: str, entities: list[str]) -> list[ModelSpec]:
        """Default models of a language (``auto``: of all) that find any of the entities."""
        wanted = [i for lang, i in self.defaults.items() if language in ("auto", lang)]
        return [self.specs[i] for i in dict.fromkeys(wanted) if i in self.specs and not set(entities).isdisjoint(self.specs[i].entities)]

    def models(self) -> list[ModelInfo]:
        status = lambda i: "loaded" if i in _LOADED else "error" if i in _FAILED else "available"
        return [ModelInfo(s.id, s.name, s.language, tuple(s.entities), status(s.id), s.description) for s in self.specs.values()]

    def summary(self) -> str:
        lines = [f"{m.id} ({m.status}): {m.name}, {m.language}, {', '.join(m.entities)}" for m in self.models()]
        return "\n".join([*(lines or ["no models"]), *[f"default {k}: {v}" for k, v in self.defaults.items()]])


def with_model_spans(
    docs: DataFrame, registry: ModelRegistry, spec: ModelSpec, entities: list[str], text: str = "text", out: str = "model_spans", least: float = 0.0
) -> DataFrame:
    """``docs`` with the model's spans of the entities asked for, of score ``least`` or more.

    If the model finds none of the entities, it isn't in the plan. A row whose
    analysis fails has no spans; a model that can't be loaded fails the query.
    Texts go to the model in Arrow batches, the instance is one for each Python worker.
    """
    wanted = [e for e in entities if e in spec.entities]
    if not wanted:
        return docs.withColumn(out, no_spans())
    labels, source = spec.labels, f"{spec.kind}:{spec.id}"
    kinds = {"entity": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string(), "score": pa.float64(), "source": pa.string()}
    kind = pa.list_(pa.struct(list(kinds.items())))
    at = docs.columns.index(text)

    def one(model, t: str) -> list[dict]:
        try:
            found = model.spans([t])[0]
        except Exception:  # noqa: BLE001 - one text's failure must not end the batch
            return []
        named = [(labels.get(e) if labels else e, s, n, p) for e, s, n, p in found]
        return [{"entity": e, "start": s, "end": n, "text": t[s:n], "score": p, "source": source} for e, s, n, p in named if e in wanted and p >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = registry.get(spec.id)
        if model is None:
            raise RuntimeError(f"model {spec.id} can't be loaded: {_FAILED.get(spec.id, 'unknown id')}")
        for batch in batches:
            spans = [one(model, t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, out])

    schema = docs.select("*", no_spans().alias(out)).schema
    return docs.mapInArrow(run, schema)


#: The longest input of token classifiers, in tokens; what follows isn't scanned.
MOST_TOKENS = 512


class TokenClassifier:
    """Token classification as a model: ``predict(text) -> (label, score, start, end)`` of
    each token, at most MOST_TOKENS of them, decoded to spans on the JVM side or here."""

    def __init__(self, predict: Callable[[str], list[tuple[str, float, int, int]]], labels: dict[str, str]):
        self.predict, self.labels = predict, labels

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        return [self._decode(self.predict(t)[:MOST_TOKENS]) for t in texts]

    def _decode(self, tokens: list[tuple[str, float, int, int]]) -> list[tuple[str, int, int, float]]:
        done, now = [], None
        for label, score, start, end in tokens:
            if (start, end) == (0, 0):
                continue
            entity = self.labels.get(label)
            inside = label.startswith("I-")
            grows = now is not None and entity == now[0] and not label.startswith("B-")
            if grows:
                n = now[4]
                now = (entity, now[1], end, (now[3] * n + score) / (n + 1), n + 1)
            elif not inside:
                done += [now] if now else []
                now = (entity, start, end, score, 1) if entity else None
        return [(e, a, b, p) for e, a, b, p, _ in [*done, *([now] if now else [])]]


def confident(spans: Column, least: float = 0.8) -> Column:
    return F.filter(spans, lambda s: s["score"] >= least)


def scored_entities(t: Column, entities: Column, label: str, entity: str, words: list[str]) -> Column:
    """Entities (label, start, end) of a language pipeline as spans: those of one label,
    0.9 with a context word within 50 characters, else 0.6."""
    mine = F.filter(F.coalesce(entities, F.array().cast("array<struct<label:string,start:int,end:int>>")), lambda e: e["label"] == label)

    def scored(x: Column, parts: Column) -> Column:
        near = lambda s: contains_any(around(parts, s["start"], s["end"], fixed.NER_WINDOW, fixed.NER_WINDOW), words)
        text = lambda s: around(parts, s["start"], s["end"], 0, 0)
        return F.transform(x, lambda s: make(entity, s["start"], s["end"], text(s), F.when(near(s), fixed.NER_NEAR).otherwise(fixed.NER_ALONE), F.lit("ner:" + entity)))

    bare = F.transform(mine, lambda e: make(entity, e["start"], e["end"], F.lit(""), 0.0, ""))
    return in_context(t, bare, scored)


def person_entities(t: Column, entities: Column) -> Column:
    return scored_entities(t, entities, "PERSON", "JP_PERSON", fixed.NER_PERSON_WORDS)


def address_entities(t: Column, entities: Column) -> Column:
    return scored_entities(t, entities, "LOC", "JP_ADDRESS", fixed.NER_ADDRESS_WORDS)


def ner_candidates(t: Column, entities: Column) -> Column:
    """Entities of a language pipeline as line candidates' spans, all of score 0.7."""
    table = F.create_map(*[F.lit(x) for kv in fixed.NER_CANDIDATE_LABELS.items() for x in kv])
    known = F.filter(F.coalesce(entities, F.array().cast("array<struct<label:string,start:int,end:int>>")), lambda e: F.try_element_at(table, e["label"]).isNotNull())
    bare = F.transform(known, lambda e: make(F.try_element_at(table, e["label"]), e["start"], e["end"], F.lit(""), 0.7, "ner:pipeline"))
    with_text = lambda x, parts: F.transform(x, lambda s: make(s["entity"], s["start"], s["end"], around(parts, s["start"], s["end"], 0, 0), s["score"], s["source"]))
    return in_context(t, bare, with_text)

