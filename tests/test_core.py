import random

import pytest
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.functions import text as T
from maskwell.operators import allow, candidates, recognize


@pytest.fixture(scope="module")
def random_spans():
    rng, rows = random.Random(5), []
    for i in range(40):
        spans = []
        for _ in range(rng.randrange(0, 9)):
            start = rng.randrange(0, 20)
            entity = rng.choice(["EMAIL_ADDRESS", "JP_ZIP_CODE", "DATE", "OTHER"])
            spans.append((entity, start, start + rng.randrange(1, 8), "x", rng.choice([0.5, 0.7, 0.9]), "r"))
        rows.append((i, spans))
    return rows


def _apart(a, b):
    return a[2] <= b[1] or b[2] <= a[1]


def test_deduplicate_and_merge_match_plain_forms(spark, random_spans):
    df = spark.createDataFrame(random_spans, f"i int, s array<{S.SPAN}>")
    out = df.select("i", S.deduplicate(F.col("s")).alias("d"), S.merge_results(F.col("s")).alias("m")).collect()
    for r in out:
        spans = random_spans[r.i][1]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[4], s[1])):
            if all(_apart(s, k) for k in kept):
                kept.append(s)
        assert [tuple(x) for x in r.d] == sorted(kept, key=lambda s: s[1])
        kept, covered = [], set()
        for s in sorted(spans, key=lambda s: (-s[4], s[1] - s[2], s[1])):
            own = set(range(s[1], s[2]))
            if len(own & covered) <= 0.5 * len(own):
                kept.append(s)
                covered |= own
        assert [tuple(x) for x in r.m] == sorted(kept, key=lambda s: s[1])


def test_find_counts_code_points(spark):
    df = spark.createDataFrame([("😀 a1b22",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(S.find(F.coalesce("t", F.lit("")), r"\d+", "N", 1.0, "r")).collect()]
    assert [(s.start, s.end, s.text) for s in got[0]] == [(3, 4, "1"), (5, 7, "22")]
    assert got[1] == got[2] == []


def test_normalize_and_segments(spark):
    raw = "　Top  line\n\n\n\nEducation\n  MIT \nSkills: SQL"
    df = spark.createDataFrame([(raw,)], "t string").select(T.normalize(F.col("t")).alias("t"))
    row = df.select("t", T.segments(F.col("t")).alias("g")).first()
    assert row.t == "Top line\n\nEducation\n MIT \nSkills: SQL"
    assert [(g.text, g.section_type, g.section_id) for g in row.g] == [
        ("Top line", "header", "section_0"), ("Education", "education", "section_1"),
        ("MIT", "education", "section_1"), ("Skills: SQL", "skills", "section_2"),
    ]
    assert all(row.t[g.start : g.end] == g.text for g in row.g)


def test_mask_document(spark):
    text = "氏名 山田 太郎\n生年月日 1990年5月15日\n電話 090-1234-5678 taro@example.com"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.masked for r in recognize.mask(df).select("doc_id", "masked").collect()}
    assert got == {1: "氏名 ****\n生年月日 ****/**/**\n電話 ***-****-**** ****", 2: ""}


def test_candidates_are_verified(spark):
    text = "Education\n2015-2021\n連絡先\n〒150-0001 東京都渋谷区神宮前\nBirth 1990-13-01"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = candidates.mask_verified(candidates.verify(candidates.extract(df))).first()
    got = {(v.entity, v.status, v.reason) for v in row.verdicts}
    assert got == {
        ("JP_ZIP_CODE", "mask", "format_valid:jp_zip"),
        ("JP_ADDRESS", "mask", "section_boost:contact"),
        ("DATE_OF_BIRTH_JP", "exclude", "format_invalid:date"),
    }
    assert row.masked == "Education\n2015-2021\n連絡先\n***-**** ****\nBirth 1990-13-01"


def test_label_decoding(spark):
    tokens = [("O", 0.9, 0, 0), ("B-PER", 0.9, 0, 3), ("I-PER", 0.7, 4, 7), ("I-LOC", 0.9, 8, 9), ("O", 0.9, 9, 10), ("LOC", 0.8, 11, 16)]
    df = spark.createDataFrame([(tokens, "Ann Lee x. Paris")], "k array<struct<label:string,score:double,start:int,end:int>>, t string")
    out = df.select(S.decode_labels(F.col("k"), {"B-PER": "PERSON", "I-PER": "PERSON", "I-LOC": "LOCATION", "LOC": "LOCATION"}, F.col("t"))).first()[0]
    assert [(s.entity, s.text, round(s.score, 6)) for s in out] == [("PERSON", "Ann Lee", 0.8), ("LOCATION", "Paris", 0.8)]


def test_allow_list(spark):
    lines = spark.createDataFrame([(0, "Alpha Beta/alias[AB|A.B.]"), (1, ""), (2, "Gamma/js[x]"), (3, "AB")], "position int, value string")
    terms = allow.parse_dictionary(lines)
    assert [r.term for r in terms.orderBy("position", "nth").collect()] == ["Alpha Beta", "AB", "A.B.", "Gamma"]
    spans = spark.createDataFrame([("alphabeta",), ("delta",)], "text string")
    assert [r.text for r in allow.drop_allowed(spans, terms).collect()] == ["delta"]


def test_log_section(spark):
    rule = "=" * 60
    df = spark.createDataFrame([(f"a\n{rule}\nb\n{rule}\n[JP_ZIP_CODE] [JP_AGE] [JP_AGE]",), ("[X]",)], "t string")
    assert [r[0] for r in df.select(recognize.parse_last_log_section(F.col("t"))).collect()] == [["JP_ZIP_CODE", "JP_AGE"], []]
