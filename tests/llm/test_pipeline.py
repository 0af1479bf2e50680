import hashlib
import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from maskwell.llm import mixing, sharding
from tests.llm.test_near_dedup import brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    shutil.copy(f"{SF}/benchmark.parquet", path / "benchmark.parquet")
    pq.write_table(pq.read_table(f"{SF}/documents.parquet").slice(0, 90), path / "documents.parquet")
    return str(path)


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    known = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, small)
    assert kept.columns == names and kept.count() >= 0.95 * len(known)
    once = stages["near_dedup"](spark, docs, small)
    assert once.columns == names
    want = {i for i, _, c in brute_force([(r.doc_id, r.text) for r in known.values()], 5, 80, 100) if i == c}
    assert {r.doc_id for r in once.collect()} == want
    clean = stages["decontamination"](spark, docs, small)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    dirty = {i for i, r in known.items() if any(t in r.text for t in items)}
    assert {r.doc_id for r in clean.collect()} == set(known) - dirty
    mixed = stages["mixing"](spark, docs, small)
    assert mixed.columns == names
    # each source gives the whole words of its target, and each text is a known one or its beginning
    goals = {r.source: int(r.target) for r in mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()}
    taken: dict = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert known[r.doc_id].text.startswith(r.text)
    assert taken == goals
    placed = stages["sharding"](spark, docs, small)
    assert placed.columns == [*names, "slot", "shard"] and placed.count() == len(known)
    owners = sharding.lookup_table()
    for r in placed.collect():
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % len(owners) and r.shard == owners[r.slot]


def test_run(spark, small):
    first, again = ([*map(str, corpus_pipeline.run(spark, small).collect())] for _ in range(2))
    assert first and sorted(first) == sorted(again)


def test_empty_and_odd_tables(spark, tmp_path):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("slot", pa.string())])
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    pq.write_table(schema.empty_table(), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text, "en", "a", 1, "x"), (2, text + " more", None, None, None, None), (2, text + " more", None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "a", 0, ""), (4, "!!", "en", "a", 0, "")]
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1} and "slot_" in out[0].asDict()
