"""Operators on small inputs, most against plain forms of the same rule."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskwell.functions import arrays
from maskwell.functions import spans as S
from maskwell.functions import text as T
from maskwell.operators import candidates, generated, models, recognize, results, resumes, routing
from maskwell.sources import config, files, sinks
from maskwell.streaming import masking

PRIORITY = ["EMAIL_ADDRESS", "JP_ZIP_CODE", "DATE"]


def _random_documents(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        spans = []
        for _ in range(rng.randrange(0, 9)):
            start = rng.randrange(0, 20)
            spans.append((rng.choice([*PRIORITY, "OTHER"]), start, start + rng.randrange(1, 8), "x", rng.choice([0.5, 0.7, 0.9]), "r"))
        out.append((i, spans))
    return out


def _meet(a, b):
    return a[1] < b[2] and b[1] < a[2]


def _rank(s):
    return {"EMAIL_ADDRESS": 0, "JP_ZIP_CODE": 3, "DATE": 12}.get(s[0], 15)


def test_merge_candidates_matches_a_plain_form(spark):
    rows = _random_documents(120, 11)
    out = spark.createDataFrame(rows, f"i int, s array<{S.SPAN}>").select("i", S.merge_candidates(F.col("s")).alias("m")).collect()
    for r in out:
        kept = []
        for s in sorted(rows[r.i][1], key=lambda s: (s[1], _rank(s), -s[4])):
            at = next((k for k, other in enumerate(kept) if _meet(other, s)), None)
            if at is None:
                kept.append(s)
            elif _rank(s) < _rank(kept[at]) or (_rank(s) == _rank(kept[at]) and s[4] > kept[at][4]):
                kept = kept[:at] + kept[at + 1 :] + [s]
        assert [tuple(x) for x in r.m] == sorted(kept, key=lambda s: s[1])


def test_collisions_match_a_plain_form(spark):
    rng, rows = random.Random(3), []
    for i, spans in _random_documents(120, 12):
        rows.append((i, [(*s, "contact", s[4], rng.choice(["mask", "review", "exclude"]), "ok") for s in spans]))
    out = spark.createDataFrame(rows, f"i int, v array<{candidates.VERDICT}>").select("i", candidates.resolve_collisions(F.col("v")).alias("c")).collect()
    for r in out:
        given = rows[r.i][1]
        active = sorted([v for v in given if v[8] != "exclude"], key=lambda v: v[1])
        kept, lost = [], []
        for v in active:
            at = next((k for k, other in enumerate(kept) if _meet(other, v)), None)
            if at is None:
                kept.append(v)
            elif _rank(v) < _rank(kept[at]):
                lost.append(kept[at])
                kept = kept[:at] + kept[at + 1 :] + [v]
            else:
                lost.append(v)
        want = given if not active else kept + [v for v in given if v[8] == "exclude"] + [(*v[:7], 0.0, "exclude", "collision_lower_priority") for v in lost]
        assert [tuple(x) for x in r.c] == [tuple(v) for v in want]


def test_scan_goes_over_chunks(spark):
    n = 3 * arrays.CHUNK + 7
    df = spark.createDataFrame([(list(range(n)),), ([],)], "x array<int>")
    got = [r[0] for r in df.select(arrays.scan(F.col("x"), F.lit(0), lambda state, x: state + x)).collect()]
    assert got[0] == [i * (i + 1) // 2 for i in range(n)] and got[1] == []


def test_many_matches_of_one_text(spark):
    t = "\n".join("tel 090-1234-5678 a@b.co" for _ in range(4000))
    row = recognize.mask(spark.createDataFrame([(1, t)], "doc_id long, text string"), ["PHONE_NUMBER_JP", "EMAIL_ADDRESS"]).first()
    assert row.n_entities == 8000 and row.masked == "\n".join("tel ***-****-**** ****" for _ in range(4000))


def test_rules_stand_once_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "text string").withColumn("doc_id", F.lit(1).cast("long"))
    rows = recognize.explode_spans(recognize.detect(df), "doc_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # a call for each rule, and one that cuts the text in blocks for contexts
    assert plan.count("regexp_extract_all(text") == len([1 for _, p in recognize.RULES if p.entity in recognize.DEFAULT_ENTITIES]) + 1


def test_pieces_of_a_text(spark):
    t = "".join(random.Random(1).choice("aé日😀\n") for _ in range(5000))
    cuts = [(0, 0), (0, 5), (1020, 10), (1023, 1), (1024, 2048), (4990, 100), (2047, 1026)]
    df = spark.createDataFrame([(t, a, n) for a, n in cuts], "t string, a int, n int")
    got = [r[0] for r in df.select(S.piece(S.blocks(F.col("t")), F.col("a"), F.col("n"))).collect()]
    assert got == [t[a : a + n] for a, n in cuts]


def test_text_codec_and_reconstruction(spark):
    df = spark.createDataFrame([("a：b\n（c）　d",)], "t string")
    r = df.select(T.encode_lines(F.col("t")).alias("e"), T.decode_lines(T.encode_lines(F.col("t"))).alias("d"), T.narrow_punctuation(F.col("t")).alias("n")).first()
    assert (r.e, r.d, r.n) == ("a：b<LB>（c）　d", "a：b\n（c）　d", "a:b\n(c) d")


# --- models and generated text


class Words:
    def spans(self, texts):
        if "bad" in texts[0]:
            raise ValueError("bad text")
        return [[("PER", i, i + 3, 0.9 if i else 0.4) for i in range(0, len(t) - 2, 4)] for t in texts]


def broken():
    raise OSError("no such model")


SPEC = models.ModelSpec("words", "every fourth", "en", ("PERSON", "LOCATION"), Words, labels={"PER": "PERSON"}, description="x")


def test_model_registry():
    registry = models.ModelRegistry([SPEC, models.ModelSpec("gone", "n", "ja", ("JP_PERSON",), broken)], {"en": "words", "ja": "gone", "fr": "none"})
    assert [m.status for m in registry.models()] == ["available", "available"]
    assert registry.for_language("en") is registry.get("words") and registry.get("nobody") is None and registry.for_language("de") is None
    assert registry.get("gone") is None and registry.get("gone") is None
    assert [m.status for m in registry.models()] == ["loaded", "error"] and "default ja: gone" in registry.summary()
    assert [s.id for s in registry.specs_for("auto", ["JP_PERSON", "PERSON"])] == ["words", "gone"]
    assert registry.specs_for("en", ["JP_PERSON"]) == []


def test_model_spans(spark):
    registry = models.ModelRegistry([SPEC], {"en": "words"})
    df = spark.createDataFrame([(1, "abc def"), (2, None), (3, "bad one")], "doc_id long, text string")
    got = {r.doc_id: [(s.entity, s.start, s.end, s.text, s.source) for s in r.model_spans] for r in models.with_model_spans(df, registry, SPEC, ["PERSON"], least=0.8).collect()}
    assert got == {1: [("PERSON", 4, 7, "def", "transformer:words")], 2: [], 3: []}
    plan = models.with_model_spans(df, registry, SPEC, ["JP_AGE"])
    assert "MapInArrow" not in plan._jdf.queryExecution().toString() and plan.first().model_spans == []


def test_token_classifier_decodes_like_the_expression(spark):
    from maskwell.plans import fixtures

    for _, t, tokens in fixtures.TOKENS:
        got = models.TokenClassifier(lambda _, tokens=tokens: tokens, fixtures.TOKEN_LABELS).spans([t])[0]
        df = spark.createDataFrame([(t, tokens)], "t string, k array<struct<label:string,score:double,start:int,end:int>>")
        want = df.select(S.decode_labels(F.col("k"), fixtures.TOKEN_LABELS, F.col("t"))).first()[0]
        assert got == [(s.entity, s.start, s.end, s.score) for s in want]


def test_registry_selects_rules():
    registry = routing.default_registry()
    assert [r.name for r in registry.select(["EMAIL_ADDRESS"])] == ["email"] and len(registry.by_language("ja")) == 7
    assert registry.by_type("ner_ginza") == [] and "9 rules" in registry.summary()
    with pytest.raises(ValueError):
        registry.register(models.Rule("x", "other", "ja", "X", "x", lambda t, n: t))
    assert routing.requested(["A", "B"], ["B", "C"]) == ["A", "B", "C"]


def test_languages_choose_rules(spark):
    t = "性別 男性 (555) 123-4567 a@b.co 電話 03-1234-5678"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    asked = [*routing.requested(), "PHONE_NUMBER"]
    kinds = lambda lang: {s.entity for s in routing.analyze(df, lang, asked).first().spans}
    assert kinds("en") == {"EMAIL_ADDRESS", "PHONE_NUMBER"}
    assert kinds("ja") == {"EMAIL_ADDRESS", "JP_GENDER", "PHONE_NUMBER_JP", "JP_ZIP_CODE"}
    assert kinds("auto") == {"EMAIL_ADDRESS", "JP_GENDER", "PHONE_NUMBER_JP", "PHONE_NUMBER"}
    assert [s.text for s in routing.analyze(df, "en", asked, allow=["a@b.co"]).first().spans] == ["(555) 123-4567"]


def test_recovery_of_spans():
    everything = set(generated.Recovery().tags.values())
    text = "オペレーター：お名前は山田太郎ですか？会員IDはABC12345です。東京都練馬区在住です。"
    spans, dropped = generated.recover(text, "オペレーター:お名前は<name>ですか?会員IDは<customer-id>です。<address>在住です。", everything)
    assert [(e, text[a:b], s) for e, a, b, s in spans] == [("JP_PERSON", "山田太郎", 0.85), ("CUSTOMER_ID_JP", "ABC12345", 0.85), ("JP_ADDRESS", "東京都練馬区", 0.85)] and not dropped
    assert generated.recover("会員IDはABC12345です。", "会員IDは<customer-id>", everything) == ([], [("<customer-id>", "no_right_anchor", "会員IDはABC12345です。")])
    assert generated.recover(text, "お名前は<name>ですか", {"JP_ADDRESS"}) == ([], [])
    assert generated.recover("ab", "a<name>b", everything)[1][0][1] == "empty_span"
    # an anchor too short or too unlike is passed over; its tag waits for the next
    spans, _ = generated.recover("名は山田です、よろしくお願いします", "名は<name>ですゑゑゑゑゑゑ<LB>よろしくお願いします".replace("<LB>", "<address>"), everything)
    assert [e for e, *_ in spans] == ["JP_ADDRESS"]
    plain = lambda t, a, start: max(((r := __import__("difflib").SequenceMatcher(None, a, t[i : i + len(a)]).ratio(), -i) for i in range(start, min(len(t), start + 700) - len(a) + 1)), default=None)
    rng = random.Random(4)
    for _ in range(40):
        t = "".join(rng.choice("abcd ") for _ in range(90))
        at = rng.randrange(60)
        a = list(t[at : at + 12])
        a[rng.randrange(12)] = "x"
        found, best = generated.find_nearly(t, "".join(a), 3, generated.Recovery()), plain(t, "".join(a), 3)
        assert found == ((-best[1], best[0]) if best[0] >= 0.86 else None)


def test_generator_as_model(spark):
    class Tags(generated.TagGenerator):
        def __init__(self):
            super().__init__(lambda t: t.replace("Ann", "<name>"))

    assert Tags().spans(["I am Ann from\nhere"]) == [[("JP_PERSON", 4, 9, 0.85)]]


# --- results


def test_result_assembly_and_reports(spark):
    df = spark.createDataFrame([(1, "a@b.co と c@d.org"), (2, "none")], "doc_id long, text string")
    found = recognize.detect(df, ["EMAIL_ADDRESS"])
    rows = {r.doc_id: r for r in results.assemble(found).withColumn("info", results.entities_info(F.col("result"))).collect()}
    assert rows[1].result.masked_text == "**** と ****" and rows[1].result.stats.entities_by_type == {"EMAIL_ADDRESS": 2} and rows[1].result.stats.total_entities == 2
    assert json.loads(rows[1].info)[0] == {"type": "EMAIL_ADDRESS", "text": "a@b.co", "score": 1.0, "start": 0, "end": 6}
    assert rows[2].info is None and rows[2].result.stats.entities_by_type == {}
    report = results.detection_report(found).collect()
    assert len(report) == 1 and report[0].report.splitlines()[-1] == "Total: 2 entities masked"
    back = results.detection_report(found).select(results.parse_report(F.col("report")).alias("d")).first().d
    assert [(d.entity, d.text, d.score, d.start, d.end) for d in back] == [("EMAIL_ADDRESS", "a@b.co", 1.0, 0, 6), ("EMAIL_ADDRESS", "c@d.org", 1.0, 9, 16)]
    last = results.detection_report(found).select(results.missing_types(recognize.parse_last_log_section(F.col("report"))).alias("m")).first().m
    assert last == ["名前", "住所", "生年月日", "郵便番号", "電話番号"]


def test_recall(spark):
    expected = spark.createDataFrame([(1, "ab"), (1, "zz"), (2, "q"), (3, "long text")], "doc_id long, text string")
    detected = spark.createDataFrame([(1, "xaby"), (2, "r"), (3, "text"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.recall for r in results.recall(results.recalled(expected, detected), "doc_id").collect()} == {1: 0.5, 2: 0.0, 3: 1.0}


def test_dual_confirmation(spark):
    cols = "doc_id long, entity string, start int, end int"
    a = spark.createDataFrame([(1, "JP_PERSON", 0, 4), (1, "JP_PERSON", 10, 14), (1, "DATE", 20, 24), (2, "JP_PERSON", 0, 4)], cols)
    b = spark.createDataFrame([(1, "PERSON", 2, 9), (1, "PERSON", 13, 20), (1, "JP_AGE", 20, 24)], cols)
    got = recognize.confirm_by_both(a, b, {"PERSON": "person", "JP_PERSON": "person"}).collect()
    assert [(r.doc_id, r.start) for r in got] == [(1, 0)]


# --- files and configuration


def test_docx_scan(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(files.write_docx(["First\tline", "", "two\nlines"], [[["A", "B"], ["1", "x\ny"]]]))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "notes.txt").write_text("no")
    for folder in ("output", "sub", "sub/venv"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "d.docx").write_bytes(files.write_docx([folder]))
    read = lambda **o: {(r.doc_id, r.path.split("/")[-2]): r for r in files.scan(spark, str(tmp_path), **o).collect()}
    flat = read()
    assert {k[0] for k in flat} == {"a", "b", "c"}
    by = {k[0]: r for k, r in flat.items()}
    assert by["a"].text == "First\tline\n\ntwo\nlines\nA | B\n1 | x\ny" and by["a"].error is None
    assert by["b"].text is None and "BadZipFile" in by["b"].error and by["c"].text is None and by["c"].error
    assert sorted(k for k in read(recursive=True) if k[0] == "d") == [("d", "sub")]
    mine = files.scan(spark, str(tmp_path), extractors={".pdf": lambda b: b.decode()}).collect()
    assert {r.doc_id: r.text for r in mine} == {"a": None, "b": None, "c": "%PDF"}
    assert {r.error for r in mine} == {None, "Unsupported file format: .docx"}


def test_extensions(spark):
    df = spark.createDataFrame([("x/a.PDF",), ("a.b.docx",), ("/d.e/file",), (".hidden",)], "p string")
    assert [r[0] for r in df.select(files.extension(F.col("p"))).collect()] == [".pdf", ".docx", "", ""]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", "masked é\ntext"), ("d2", " "), ("d3", None)], "doc_id string, masked string")
    sinks.write_texts(df, str(tmp_path / "texts"))
    assert [p.read_text() for p in (tmp_path / "texts").glob("doc_id=d1/part-*")] == ["masked é\ntext\n"] and not list((tmp_path / "texts").glob("doc_id=d2*"))
    reports = spark.createDataFrame([("d1", "one")], "doc_id string, report string")
    for _ in range(2):
        sinks.append_log(reports, str(tmp_path / "log"), "doc_id")
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    sinks.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def test_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    assert config.load(str(tmp_path / "missing.yaml")).masks["JP_ZIP_CODE"] == "***-****"
    (tmp_path / "empty.yaml").write_text("")
    assert config.read_yaml(str(tmp_path / "empty.yaml")) == {}
    (tmp_path / "terms.dic").write_text("Alpha/alias[A1|B1]\n\nGamma\nAlpha\n", encoding="utf-8")
    (tmp_path / "c.yaml").write_text(
        "masking:\n  default_mask: '##'\ntransformer:\n  enabled: true\ndetection_strategy:\n  pattern_entities: [EMAIL_ADDRESS]\n"
        "allow_list:\n  enabled: true\n  dictionary_path: terms.dic\n  additional_terms: [Omega]\nmodels:\n  defaults: {en: m}\n"
    )
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.default_mask, c.models_enabled, c.pattern_entities, c.least_confidence, c.defaults_by_language) == ("##", True, ["EMAIL_ADDRESS"], 0.8, {"en": "m"})
    assert config.allow_terms(spark, c, str(tmp_path)) == ["Alpha", "A1", "B1", "Gamma", "Omega"]
    assert config.allow_terms(spark, config.load(raw={})) == []


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"resume_id": "1", "language": "en", "annotations": {"名前 (Name)": {"value": "v", "type": "PERSON_NAME"}, "Mail": {"value": "m", "type": "EMAIL"}}}, {"resume_id": "2", "annotations": None}]))
    rows = resumes.read_json(spark, str(tmp_path / "a.json"), resumes.ANNOTATION)
    assert [r.type for r in resumes.annotation_types(rows).collect()] == ["EMAIL", "PERSON_NAME"]
    (tmp_path / "n.json").write_text(json.dumps([{"resume_id": "1", "normalized_personal_info": {"email": {"domain": "d.org"}, "date_of_birth": {"age": 30}}}]))
    (tmp_path / "r.json").write_text(json.dumps([{"id": "1", "job_title": "Dev"}, {"id": "9"}]))
    read = lambda n, s: resumes.read_json(spark, str(tmp_path / n), s)
    got = resumes.evaluation(read("r.json", resumes.RESUME), rows, read("n.json", resumes.NORMALIZED)).collect()
    assert sorted((r.label, r.value, r.domain, r.age) for r in got) == [("Mail", "m", "d.org", 30), ("名前 (Name)", "v", "d.org", 30)]


# --- streams


def test_streams(spark, tmp_path):
    schema = "doc_id long, ts timestamp, text string"
    rows = [(1, "2024-01-01 00:01:00", "a@b.co"), (2, "2024-01-01 00:02:00", "a@b.co c@d.co"), (3, "2024-01-01 00:12:00", None)]
    spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {r.doc_id: r.masked for r in run(masking.mask_stream(stream, ["EMAIL_ADDRESS"]), "append", "masked_stream")} == {1: "****", 2: "**** ****", 3: ""}
    counts = run(masking.windowed_counts(stream, "ts", entities=["EMAIL_ADDRESS"]), "complete", "counted_stream")
    assert [(str(r.window_start), r.entity, r.n) for r in counts] == [("2024-01-01 00:00:00", "EMAIL_ADDRESS", 3)]
