import random

import numpy as np
import pytest

from maskwell.llm import near_dedup
from maskwell.llm._text import row_slices, shingles, utf8, word_hashes
from maskwell.llm.components import connected_components
from maskwell.llm.near_dedup import _forest, band_count, deduplicate, near_duplicates

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = (out + [word] if word else out), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] if word else out


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_force(rows, k, num, den):
    """doc_id -> (n_shingles, component) over all pairs of texts."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünïcode", "日本", "A", "a"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 200]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return texts + ["", None, "   ", "one", "ONE", "one two", "One  two", "two one"]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, k, num):
    rows = list(enumerate(corpus(k)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, k, num, 100).collect()), key=str)
    assert got == brute_force(rows, k, num, 100)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (5, long), (6, long + " y"), (7, "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85, 100).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 299_998, 5, True), (6, 299_999, 5, False), (7, 1, 7, True)]
    assert got == sorted(want, key=str)
    kept = deduplicate(df, shingle_words=3, num=85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 7, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
    assert deduplicate(df).collect() == []


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 7), (3, 3)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_word_hashes_split_like_plain_python():
    import pyarrow as pa

    texts = ["", "a", " a\tb\x0bc ", None, "Ab aB", "é x y", "tail "]
    data, offsets = utf8(pa.array(texts))
    words, at = word_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    assert words[at[4]] == words[at[4] + 1]
    values, at3 = shingles(words, at, 3)
    assert np.diff(at3).tolist() == [len(shingle_set(t, 3)) for t in texts]
    assert list(row_slices(np.array([0, 5, 5, 50, 51]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_forest_of_large_groups_spans_the_same_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) > 0.06], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(90)]
    links = _forest(sets, 85, 100)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        inter = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter)
        assert find(a) != find(b)
        parent[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                assert find(a) == find(b)


def test_more_bands_for_lower_thresholds():
    assert band_count(0.85) < band_count(0.8)
    assert (1 - 0.85**5) ** band_count(0.85) <= 1e-7


def test_large_groups_go_through_blocks_and_pivots(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("HUB", 3), ("BLOCK_SHINGLES", 900), ("CHUNK", 16), ("PIVOTS", 3), ("SIG_BLOCK", 3), ("SIG_CHUNK", 8)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = list(enumerate(corpus(17, 160)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 3, 85, 100).collect()), key=str)
    assert got == brute_force(rows, 3, 85, 100)


def test_bucket_links_connect_all_agreeing_pairs(spark):
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 256, (5, 40))
    sigs = [np.where(rng.random(40) < rng.choice([0.02, 0.2, 0.4]), rng.integers(0, 256, 40), bases[rng.integers(5)]).astype(np.uint8) for _ in range(90)]
    keys = [sorted({int(k) for k in rng.integers(0, 4, 2)}) for _ in sigs]
    rows = [(i, k, s.tobytes()) for i, (k, s) in enumerate(zip(keys, sigs, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, keys array<long>, sig binary")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in near_dedup.candidate_links(df, 28).collect():
        parent[find(r.u)] = find(r.v)
    got = {(a, b) for a in range(len(rows)) for b in range(a) if find(a) == find(b)}
    parent.clear()
    for a in range(len(rows)):
        for b in range(a):
            if set(keys[a]) & set(keys[b]) and (sigs[a] == sigs[b]).sum() >= 28:
                parent[find(a)] = find(b)
    assert got == {(a, b) for a in range(len(rows)) for b in range(a) if find(a) == find(b)}


def test_texts_move_a_bounded_number_of_times(spark, monkeypatch):
    """A template with one class of near copies and unlike documents: copies of rows in
    the text stage stay below three for each row, however large the group."""
    rng = random.Random(5)
    stem = [f"s{i}" for i in range(200)]
    texts = []
    for i in range(1500):
        words = list(stem)
        for _ in range(3 if i % 50 else 20):
            words[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        texts.append((i, " ".join(words)))
    moved = []
    real = near_dedup._grouped
    monkeypatch.setattr(near_dedup, "_grouped", lambda rows, data: moved.append(rows) or real(rows, data) if data == "text" else real(rows, data))
    seen = []
    layout = near_dedup._layout
    monkeypatch.setattr(near_dedup, "_layout", lambda rows, *a: seen.append((rows.columns, layout(rows, *a).count())) or layout(rows, *a))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 85, 100).collect()}
    assert sum(got[i] == got[1] for i in got if i % 50) > 1400
    assert sum(n for columns, n in seen if "text" in columns) <= 3 * len(texts)


def test_signature_cut():
    cut = near_dedup.least_agreement(0.85, 140)
    assert 0.6 * 140 < cut < 0.72 * 140
    assert near_dedup.least_agreement(1.0, 10) == 10


def test_rows_of_one_id_or_none(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "f g h i j"), (None, "a b"), (None, "a b"), (None, None), (None, "c")]
    out = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "a b c d e"), (1, "f g h i j"), (None, "a b"), (None, None), (None, "c")], key=str)
