import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from maskwell.llm import chat, decontaminate, html_text, jpeg, language_id, mixing, quality, queries, sharding, warc
from maskwell.llm.queries import _OP6_SQL

DOCS = "doc_id long, text string, lang string, source string, size string"


# --- sharding


def test_table_follows_the_turns():
    names, slots = [f"shard-{i}" for i in range(5)], 13
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = []
    for n in names:
        offset, skip = number(f"{n}/offset") % slots, number(f"{n}/skip") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        table[next(s for s in orders[turn % 5] if s not in table)] = turn % 5
        turn += 1
    assert sharding.lookup_table(5, slots) == [table[i] for i in range(slots)]


def test_shares_and_removal():
    full = sharding.lookup_table(64)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    names = [f"shard-{i}" for i in range(64)]
    less = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 63)
    assert moved < 0.05 * len(full)
    with pytest.raises(ValueError):
        sharding.lookup_table(3, 10)


def test_assignment_edges(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, slot string")
    rows = sharding.assign(df, shards=4, slots=101).collect()
    assert len(rows) == 3 and rows[0].asDict().keys() == {"doc_id", "slot", "slot_", "shard"}
    same = {r.shard for r in rows if r.doc_id == 1}
    assert len(same) == 1
    assert sharding.assign(df.where("false")).collect() == []


# --- mixing


def plain_targets(sizes, weights, budget):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_ and budget > 1e-9:
        share = {s: budget * weights[s] / sum(weights[x] for x in open_) for s in open_}
        budget, closed = 0.0, set()
        for s in open_:
            target[s] += share[s]
            if target[s] > 2 * sizes[s]:
                budget += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                closed.add(s)
        open_ -= closed
    return target


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choices(["a", "b", "B", "é", None], [9, 1, 3, 2, 1])[0], "x") for i in range(400)]
    rows += [(900, None, None, "a", None), (901, " \t", None, "only empty", None), (None, "one two", None, "b", None), (5, "again again", "en", "a", "x"), (5, "again again", "en", "a", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, buckets=8).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in names}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = plain_targets(sizes, weights, 1.5 * sum(sizes.values()))
    taken = {}
    where = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[where[r.doc_id]]
        assert r.target == pytest.approx(want[where[r.doc_id]])
        taken[where[r.doc_id]] = taken.get(where[r.doc_id], 0) + r.taken
    assert taken == {s: int(want[s] + 1e-9) for s in names}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), buckets=5).collect()))
    mixed = mixing.emit_mix(df, buckets=8)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert {s: n for s, n in words.items()} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df.where("false")).collect() == []


def test_first_words_keep_white_space(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a\tb\n c d", 3), ("a", 1)], "t string, n int")
    assert [r.x for r in df.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()] == [" a\tb\n c", "a"]


# --- language ID


def test_language_id_against_plain_counts(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "bcdfg", "cc": "aeiou"}
    make = lambda lang, n: "".join(rng.choice(alphabets[lang] + " ") for _ in range(n))
    rows = [(i, make(lang, 200), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    grams = lambda t, n: [f" {t.lower()} "[i : i + n] for i in range(len(t) + 2 - 2)]
    tests = [make("aa", 50), make("bb", 5), make("cc", 300), None, "", "123 !?", "a", "ABCDE"]
    got = language_id.score_texts(tests, model)
    assert got[0][:3] == ["aa", "bb", "cc"] and got[0][3:6] == ["und"] * 3 and got[0][7] == "aa"
    assert ((got[1] >= 0) & (got[1] <= 1)).all() and got[1][3:6].tolist() == [0, 0, 0]
    counts = {lang: {} for lang in alphabets}
    for _, t, lang in rows:
        for n in language_id.ORDERS:
            for g in grams(t, n):
                key = (n, g if len(g) == n else None)
                counts[lang][key] = counts[lang].get(key, 0) + 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    smoothed = np.exp(model.log_probs).sum(axis=1)
    assert smoothed == pytest.approx(np.ones(3), abs=1e-3)
    assert len(set(total.values())) == 1


def test_language_id_against_a_plain_naive_bayes(spark):
    """Counts, log-probabilities, predictions and posteriors, gram by gram in plain Python."""
    rng = random.Random(5)
    multipliers = [0x9E3779B1, 0x85EBCA77]
    multipliers.append(0xC2B2AE3D)

    def bucket(gram):
        h = (sum(ord(c) * m for c, m in zip(gram, multipliers, strict=False)) + len(gram)) % 2**32
        h ^= h >> 15
        return h * 0x2C1B3C6D % 2**32 >> 16

    grams = lambda t: [bucket(x[i : i + n]) for x in [f" {t.lower()} "] for n in (2, 3) for i in range(len(x) - n + 1)]
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, make(letters, rng.randrange(1, 60)), lang) for i, (lang, letters) in enumerate([("aa", "abcdeé "), ("bb", "cdefg日 ")] * 15)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: [0.5] * (1 << 16) for lang in ("aa", "bb")}
    for _, t, lang in rows:
        for b in grams(t):
            counts[lang][b] += 1
    logs = {lang: np.log(np.array(c) / sum(c)) for lang, c in counts.items()}
    for i, lang in enumerate(model.languages):
        assert np.allclose(model.log_probs[i], logs[lang], atol=1e-5)
    texts = [make("abcdefgé日 ", rng.randrange(1, 30)) + "a" for _ in range(60)]
    langs, score = language_id.score_texts(texts, model)
    for t, lang, p in zip(texts, langs, score, strict=True):
        total = {x: sum(logs[x][b] for b in grams(t)) for x in logs}
        best = max(sorted(total), key=lambda x: total[x])
        assert lang == best and p == pytest.approx(1 / sum(np.exp(total[x] - total[best]) for x in total), abs=1e-3)


def test_language_id_with_very_many_labels_and_long_texts(spark):
    rows = [(i, "abc " * 50, f"l{i % 300}") for i in range(600)] + [(1000 + i, "xyz " * 40, "zz") for i in range(9)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == language_id.MOST_LANGUAGES and "zz" in model.languages
    df = spark.createDataFrame([(1, "xyz " * 400_000, "a"), (2, "", "b")], "doc_id long, text string, lang_pred string")
    assert [r.lang_pred for r in language_id.identify(df, model).orderBy("doc_id").collect()] == ["zz", "und"]


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    found = queries.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(found) > 200 and np.mean([r.lang_pred == r.lang for r in found]) >= 0.98
    scored = queries.op2_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) >= 0.97 and np.mean([r.predicted == r.quality for r in scored]) >= 0.95


def test_language_id_pieces_see_each_gram_once(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abc def") for _ in range(5000))
    model = language_id.LanguageModel(("x", "y"), np.random.default_rng(0).normal(size=(2, language_id.BUCKETS)).astype(np.float32) / 100, np.zeros(2))
    whole = language_id.score_texts([text, "abc"], model)[1]
    monkeypatch.setattr(language_id, "CHARS", 700)
    assert language_id.score_texts([text, "abc"], model)[1] == pytest.approx(whole, rel=1e-6)


def test_language_id_untrained_and_filter(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", "x"), (None, None, None, None, None)], DOCS)
    model = language_id.train(df)
    assert [(r.lang_pred, r.score) for r in language_id.identify(df, model).collect()] == [("und", 0.0)] * 2
    model = language_id.train(spark.createDataFrame([(1, "abc abc", "en")], "doc_id long, text string, lang string"))
    kept = language_id.filter_identified(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert language_id.identify(df.where("false"), model).collect() == []


# --- decontamination


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(pick(rng.randrange(15, 50)))) for i in range(20)] + [(50, "too short"), (51, None), (52, "")]
    docs, want = [], set()
    for i in range(60):
        words = pick(200)
        if i % 3 == 0:
            item = items[i % 20]
            planted = item[1].split()
            if i % 2:
                for p in range(2, len(planted), 6):
                    planted[p] = "changed"
            at = rng.randrange(200)
            words[at:at] = [w.upper() + "!" for w in planted]
            want.add((i, item[0]))
        elif i % 3 == 1:
            words[50:50] = items[i % 20][1].split()[:6]
        docs.append((i, " ".join(words), "en", "s", "x"))
    docs += [(100, None, None, None, None), (None, items[0][1], None, None, None), (101, "", None, None, None), (101, items[1][1], "", "", "")]
    want |= {(None, 0), (101, 1)}
    df = spark.createDataFrame(docs, DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BLOCK_WORDS, 100):
        got = decontaminate.contamination(df, benchmark, block_words=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        clean = decontaminate.decontaminate(df, benchmark, block_words=most)
        assert clean.columns == df.columns
        bad = {d for d, _ in want} - {101}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad and d[1] != items[1][1])
    assert decontaminate.contamination(df, benchmark.where("false")).collect() == []
    assert decontaminate.contamination(df.where("false"), benchmark).collect() == []


def test_decontamination_against_brute_force(spark):
    """Every item laid at every place of every document, word by word."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 7, 8, 14, 25, 40])))) for i in range(40)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if i % 2:
            part = items[rng.randrange(40)][1].split()
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, " ".join(words)))

    def overlaps(item, words):
        n = len(item)
        for start in range(-n, len(words)):
            same = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(item)]
            if n < 5:
                if all(same):
                    return True
                continue
            for a in range(0, n):
                for b in range(a + min(20, n), n + 1):
                    if sum(same[a:b]) >= 0.8 * (b - a) - 1e-9:
                        return True
        return False

    sure, possible = set(), set()
    for i, text in docs:
        for j, item in items:
            if overlaps(item.split(), text.split()):
                possible.add((i, j))
                if item in text or any(m in text for m in [item.replace(w, "other", 1) for w in set(item.split())] if len(item.split()) > 6):
                    sure.add((i, j))
    got = set()
    probe = decontaminate.build_probe(items)
    import pyarrow as pa

    for row, item, _, same, n in decontaminate.find_hits(pa.array([t for _, t in docs]), probe):
        got.add((row, item))
        assert n == len(items[item][1].split()) and same <= n
    # an overlap that shifts by a word put in is found, too, so there may be more than by plain laying over
    lcs_only = got - possible
    assert possible <= got | {p for p in possible if p not in sure} and sure <= got
    assert len(possible - got) <= 0.02 * len(possible) and len(lcs_only) <= 0.05 * len(got)


def test_items_with_a_common_stem_and_short_or_unspaced_ones():
    import time

    import pyarrow as pa

    rng = random.Random(2)
    stem, word = "which of the following is the best".split(), lambda: f"w{rng.randrange(50_000)}"
    items = [(i, " ".join(stem + [word() for _ in range(20)])) for i in range(20_000)]
    probe = decontaminate.build_probe(items)
    planted = items[77][1].split()
    planted.insert(12, "extra")
    docs = [[word() for _ in range(200)] + x + [word() for _ in range(200)] for x in (stem, planted)]
    start = time.perf_counter()
    hits = list(decontaminate.find_hits(pa.array([" ".join(d) for d in docs]), probe))
    assert time.perf_counter() - start < 5
    assert [(r, i, s) for r, i, _, s, _ in hits] == [(1, 77, 27)]
    probe = decontaminate.build_probe([(1, "what is love really"), (2, "日本の首都はどこですか"), (3, "a b c d e f")])
    texts = ["so: what IS love, really?", "what is love", "ええと、日本の首都は何処ですか。", "b a b x d e f", None, ""]
    assert [(r, i) for r, i, *_ in decontaminate.find_hits(pa.array(texts), probe)] == [(0, 0), (2, 1), (3, 2)]


def test_repeated_words_do_not_add_up_to_an_overlap():
    import pyarrow as pa

    probe = decontaminate.build_probe([(1, " ".join(f"{'abcdefgh'[i % 8]}" for i in range(24)))])
    text = " ".join("a b c d e x x x x x x".split() * 6)
    assert list(decontaminate.find_hits(pa.array([text]), probe)) == []


def test_pieces_of_long_texts_have_the_same_words(monkeypatch):
    import pyarrow as pa

    text = pa.array(["ab, cd日本の。 x" * 3000])
    whole = decontaminate.unit_hashes(*decontaminate.utf8(text))
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    parts = decontaminate.unit_hashes(*decontaminate.utf8(text))
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist()


def test_mix_of_equal_rows_meets_the_targets(spark):
    rows = [(1, "a b c", "en", "s", "x")] * 5 + [(2, "d e", "en", "t", "x"), (3, "f g h i", "en", "s", "y"), (3, "f g h i", "fr", "s", "y")]
    df = spark.createDataFrame(rows, DOCS)
    goals = {r.source: int(r.target) for r in mixing.mix(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()}
    out = mixing.emit_mix(df)
    assert out.columns == df.columns
    taken = {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert taken == goals


# --- media


def jpeg_bits(pairs):
    bits = "".join(f"{value:0{n}b}" for value, n in pairs)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


DC_TABLE = (bytes([0, 0, 12] + [0] * 13), None)


def write_jpeg(planes, sampling, width, height, quantiser, restart=0, ac=()):
    """A plain baseline writer: planes of DC levels by component, AC terms (run, size, bits) in each block."""
    dc_counts, dc_symbols = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
    dc_code = {s: (s, 4) for s in range(12)}
    ac_symbols = bytes([0x00, 0x01, 0x11, 0xF0, 0x23])
    ac_counts = bytes([0, 0, 0, 5] + [0] * 12)
    ac_code = {s: (i, 4) for i, s in enumerate(ac_symbols)}
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xFE, b"a comment") + segment(0xDB, b"\0" + bytes([quantiser] + [1] * 63))
    out += segment(0xC4, b"\0" + dc_counts + dc_symbols + b"\x10" + ac_counts + ac_symbols)
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + parts)
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    out += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\0\x3f\0")
    hm, vm = (1, 1) if len(sampling) == 1 else (max(h for h, _ in sampling), max(v for _, v in sampling))
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    pieces, now, last = [], [], [0] * len(planes)
    for m in range(wide * high):
        if restart and m and m % restart == 0:
            pieces.append(jpeg_bits(now))
            now, last = [], [0] * len(planes)
        y, x = divmod(m, wide)
        for i, (h, v) in enumerate(sampling):
            if len(sampling) == 1:
                h = v = 1
            for dy in range(v):
                for dx in range(h):
                    level = int(planes[i][y * v + dy][x * h + dx])
                    diff, last[i] = level - last[i], level
                    size = abs(diff).bit_length()
                    now.append(dc_code[size])
                    if size:
                        now.append((diff if diff > 0 else diff + (1 << size) - 1, size))
                    for symbol, bits in ac:
                        now.append(ac_code[symbol])
                        if symbol & 15:
                            now.append((bits, symbol & 15))
                    now.append(ac_code[0])
    pieces.append(jpeg_bits(now))
    for i, p in enumerate(pieces):
        out += p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(pieces) - 1 else b"")
    return out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("ac", [(), ((0x01, 1), (0xF0, 0), (0x23, 5))])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(2, 2)]])
def test_decode_general_baseline(sampling, ac, restart):
    rng = np.random.default_rng(5)
    width, height, quantiser = 75, 41, 16
    wide, high = -(-width // 8), -(-height // 8)
    planes = [rng.integers(-60, 60, (16, 16)) for _ in sampling]
    frames = jpeg.decode(write_jpeg(planes, sampling, width, height, quantiser, restart, ac))
    assert (frames[0].width, frames[0].height) == (width, height)
    want = np.clip(planes[0] * 2 + 128, 0, 255)[:high, :wide]
    assert (frames[0].thumbnail[:high, :wide] == want).all()


def test_stored_payloads_come_back():
    rng = random.Random(6)
    for n in (0, 1, 191, 192, 193, 5000, 192 * 8191, 192 * 8191 + 1):
        raw = bytes(rng.randrange(256) for _ in range(min(n, 3000))) * (n // 3000 + 1)
        payload = jpeg.pad(raw[:n])
        assert len(payload) % 192 == 0 and payload.startswith(raw[:n])
        media = jpeg.encode(payload)
        assert media[:2] == b"\xff\xd8" and media[-2:] == b"\xff\xd9"
        frames = jpeg.decode(media)
        assert b"".join(f.thumbnail.tobytes() for f in frames) == payload
    small = jpeg.encode(jpeg.pad(bytes(range(256)) * 3))
    frame = jpeg.decode(small)[0]
    start = small.index(b"\xff\xda") + 10
    assert (jpeg._sequential(small[start:-2], frame, frame.components)[:, :192] + 128 == frame.thumbnail).all()


def test_media_columns(spark):
    rows = [(1, "abc"), (1, "abc"), (None, None), (2, ""), (3, "é" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, feature string")
    got = jpeg.store_and_describe(df).collect()
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        payload = jpeg.pad(text.encode())
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature
    assert got[0][1:] == got[1][1:]
    assert jpeg.store_and_describe(df.where("false")).collect() == []
    media = spark.createDataFrame([(jpeg.encode(jpeg.pad(b"x")), 1), (b"no", 2), (None, 3), (b"\xff\xd8\xff\xd9", 4), (jpeg.encode(jpeg.pad(b"x"))[:200], 5)], "media binary, width int")
    out = jpeg.media_features(media).collect()
    assert [(r.width, r.width_, r.height) for r in out] == [(1, 1536, 8), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]
    assert out[0].error is None and all(r.error for r in out[1:])


# --- quality


def test_field_against_enumeration():
    rng = np.random.default_rng(2)
    row = np.repeat([0, 1, 2, 3], [1, 4, 6, 3])
    own = rng.normal(size=(len(row), quality.N_OWN))
    model = quality.QualityModel(rng.normal(size=quality.N_FEATURES) / 4, rng.normal(size=(2, 2)), 1, 0, 0.5)
    got = quality.marginals(own, row, model)
    unary = quality.with_neighbours(own, row) @ model.weights
    for d in range(4):
        at = np.flatnonzero(row == d)
        total, good = 0.0, np.zeros(len(at))
        for code in range(1 << len(at)):
            y = [(code >> i) & 1 for i in range(len(at))]
            s = sum(unary[i] * v for i, v in zip(at, y, strict=True)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False))
            total += np.exp(s)
            good += np.exp(s) * np.array(y)
        assert got[at] == pytest.approx(good / total)


def quality_rows(n, seed):
    rng = random.Random(seed)
    line = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(9)) + "."
    junk = [lambda: " | ".join(["Buy"] * 9), lambda: line().upper().replace(" ", "!! "), lambda: "spam " * 12]
    out = []
    for i in range(n):
        good = rng.random() < 0.8
        lines = [line() for _ in range(rng.randrange(1, 9))]
        if not good:
            lines = lines[:1] + [rng.choice(junk)() for _ in range(rng.randrange(3, 9))]
        out.append((i, "\n".join(lines), int(good)))
    return out


def test_quality_held_out(spark):
    rows = quality_rows(500, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in quality.score(df.drop("quality"), model).collect()}
    held = [(got[i], q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([r.predicted == q for r, q in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r, _ in held)


def test_quality_edges(spark, monkeypatch):
    rows = quality_rows(60, 2)
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    odd = [(None, None), (1, ""), (1, "\n\n"), (2, "x"), (3, "word " * 500_000), (4, "\r\n")]
    df = spark.createDataFrame([(*r, "s") for r in odd], "doc_id long, text string, score string")
    got = quality.score(df, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[2].score == model.base
    assert quality.score(df.where("false"), model).collect() == []
    for only in (0, 1, None):
        few = spark.createDataFrame([(1, "abc", only), (2, None, only)], "doc_id long, text string, quality int")
        assert len(quality.score(df, quality.train(few)).collect()) == len(odd)
    import pyarrow as pa

    text = pa.array(["\n".join(f"line {i} of the text" for i in range(3000)), "b", "one one long LINE! without ends " * 900, "x" * 12_000 + "\n" + "y y " * 4000])
    whole = quality.line_features(text)
    assert np.bincount(whole[2]).tolist() == [3000, 1, 1, 2]
    monkeypatch.setattr(quality, "PIECE", 5000)
    monkeypatch.setattr(quality, "row_slices", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
    assert all(np.allclose(a, b) for a, b in zip(whole, quality.line_features(text), strict=True))


# --- chat

CHAT = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "Fine.\n\nAnd you?"),
    (1, 2, "user", "> Fine.\nGood to hear.\n> And  YOU?\nMe too."),
    (1, 3, "assistant", ">> hello there.\n>> how are you?\n> good to hear.\nThanks"),
    (1, 4, "user", "> nobody said this\nhm"),
    (1, 5, None, "> Me too.\r\n\r\nAh"),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (2, 2, "user", "> Fine.\n>\n> > > deep"),
    (2, 3, "user", "  plain > text  "),
    (3, 0, "user", "x"),
    (3, 1, "user", "> x\ny"),
    (3, 2, "user", "> y\nz"),
    (3, 3, "user", "> z\n> \nx"),
    (3, 4, "user", " > z \n"),
]


def test_chat_against_sql(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    got = chat.link_quotations(df).drop("text").toPandas()
    con = duckdb.connect()
    con.register("c", df.toPandas())
    con.execute("CREATE TABLE conversations AS SELECT * FROM c")
    want = con.execute(_OP6_SQL).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda x: x[columns].astype(object).where(x[columns].notna(), None).sort_values(["conv_id", "turn"]).values.tolist()
    assert plain(got) == plain(want)
    by = {(r.conv_id, r.turn): r for r in got.itertuples()}
    assert by[1, 2].reply_to == 1 and by[1, 3].reply_to == 2 and by[1, 5].reply_to == 2 and np.isnan(by[1, 4].reply_to)
    assert by[1, 2].content == "Good to hear.\nMe too." and by[1, 2].quotes == 2 and by[1, 2].linked == 2
    assert by[1, 3].root_turn == 1 and by[1, 3].depth == 2
    assert by[3, 3].root_turn == 0 and by[3, 3].depth == 3


def test_chat_edges(spark):
    rows = [(None, 0, "u", "> a", 1), (1, None, "u", "> a", 1), (1, 0, "u", "a", 1), (1, 0, "u", "b", 1), (1, 1, "u", "> a\n" + "> q\n" * 20_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = chat.link_quotations(df).collect()
    assert len(got) == len(rows) and "depth_" in got[0].asDict()
    assert chat.link_quotations(df.where("false")).collect() == []


PARTS = [
    (1, 0, "u", "A1\nA2\n\nB1\nB2\nB3"),
    (1, 1, "u", "B2\nsomething else\nB3\nA1"),
    (1, 2, "u", "> A1\n> A2\nanswer"),
    (1, 3, "u", "> b2 \n>  B3\nanswer to an end"),
    (1, 4, "u", "> A2\n> B1\nover the blank line"),
    (1, 5, "u", "> A1\n> B1\nnot consecutive"),
    (1, 6, "u", "> B2\n> B1\nwrong order"),
    (1, 7, "u", ">> answer\n>> to come\n> A1\n> A2\n\nown one\nown two\nown three"),
    (1, 8, "u", "> own two\n>\n> own three\nyes"),
    (1, 9, "u", "> B1 B2\n> B3\nwrapped anew"),
    (1, 10, "u", "> B1\n> B2\n> B3\n> B4\none line too many"),
    (2, 0, "u", "> A1\n> A2\nanother conversation"),
    (3, 0, "u", "> L1\n> L2\nbefore its original"),
    (3, 1, "u", "L0\nL1\nL2"),
    (3, 2, "u", "L1\nL2\nL3"),
    (3, 3, "u", "> L1\n> L2"),
    (3, 4, "u", "> L1\n> L2\n> L3\n\nx\n> L1\n> L2"),
]


def test_chat_partial_quotes(spark):
    df = spark.createDataFrame(PARTS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.quotes, r.linked, r.reply_to, r.root_turn) for r in chat.link_quotations(df).collect()}
    none = {k: (q, 0, None, k[1]) for k, q in {(1, 0): 0, (1, 1): 0, (1, 5): 1, (1, 6): 1, (1, 10): 1, (2, 0): 1, (3, 1): 0, (3, 2): 0, (3, 0): 1}.items()}
    linked = {
        (1, 2): (1, 1, 0, 0), (1, 3): (1, 1, 0, 0), (1, 4): (1, 1, 0, 0), (1, 7): (2, 1, 0, 0), (1, 8): (1, 1, 7, 0), (1, 9): (1, 1, 0, 0),
        (3, 3): (1, 1, 1, 1), (3, 4): (2, 2, 2, 2),
    }
    assert got == none | linked


def test_chat_parts_of_long_texts(spark):
    lines = [f"line {i % 7} {i // 3}" for i in range(6000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join(f"> {x}" for x in lines[100:3100])), (1, 2, "u", "> " + "\n> ".join(lines[5990:]))]
    rows += [(1, 3 + i, "u", "ok\nok\nok") for i in range(3000)] + [(1, 4000 + i, "u", "> ok\n> ok\nfine") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.reply_to for r in chat.link_quotations(df).collect()}
    assert got[1] == got[2] == 0 and all(got[4000 + i] == 3 for i in range(3000))


# --- WARC

HTML = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 100_000), (6, "u", "<p>é</p>"), (6, "v", "<p>é</p>"), (None, "u", "only"), (None, "u", "only")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, 0) for r in HTML], "page_id long, url string, html string, payload_bytes int")
    got = warc.round_trip(df).collect()
    want = []
    for i, _, html in HTML:
        payload = (html or "").encode()
        ids = [j for j, _, h in HTML if (h or "").encode() == payload and j is not None]
        top = max(ids, default=None)
        revisit = top is not None and i != top
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in HTML}
    assert warc.round_trip(df.where("false")).collect() == []


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_every_split_owns_its_records_once(tmp_path, monkeypatch, width):
    monkeypatch.setattr(warc, "MEMBER", 500)
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 300, 2000]))) for _ in range(12)]
    payloads[3] = warc.MAGIC * 50
    body = b"".join(warc.make_record(i, "u", base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), "response", None, p) for i, p in enumerate(payloads))
    path = tmp_path / "a"
    path.write_bytes(body)
    if width == 1:
        body_range = range(0, len(body), 97)
        cuts = [*body_range, len(body)]
    else:
        cuts = [*range(0, len(body), width), len(body)]
    seen = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        with open(path, "rb") as f:
            seen += [(int(h["x-page-id"]), x.partition(b"\r\n\r\n")[2]) for h, x in warc.scan_range(f, a, b)]
    assert seen == list(enumerate(payloads))


def test_large_records_take_several_members(spark):
    text = "".join(random.Random(0).choices("abcdefghij", k=1000)) * 20_000
    df = spark.createDataFrame([(1, "u", text), (2, "u", "small")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert bytes(got[1].payload).decode() == text and bytes(got[2].payload) == b"small"


# --- HTML


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>menu</a></nav>", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<article><h1>T</h1><p><b>One  &eacute;<br>\n<p>two&nbsp;x</p></article><footer>f</footer>", "T\n\nOne é\n\ntwo x"),
        ("<script>var t='</p>';</script><body><p>a b c</p><p>Ti.</p></body>", "a b c\n\nTi."),
        ("<main><p>yes</p><aside>no</aside><div class='comments'><p>no</p></div><form><p>no</p></form><p>too</p></main>", "yes\n\ntoo"),
        ("<div class=ad><p>no<p>no</div><div id=content><p>yes yes yes yes</p></div>", "yes yes yes yes"),
        ("<article><p>a</p><div class='cookie-notice'>no</div><ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article><foot", "a\n\nb\n\nc\n\nd e"),
        ("<body class='no-sidebar'><div id='menu'>no</div><p>text stays</p></body>", "text stays"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='no-sidebar'><article><h1>T</h1><p>the text of the page</p></article></div>", "T\n\nthe text of the page"),
        ("<div class='layout has-sidebar'><div class='sidebar'>links</div><main><p>the text of the page</p></main></div>", "the text of the page"),
        ("<article><div class='content-header'><h1>T</h1></div><p>the text of the page</p><div class='share'>x</div></article>", "T\n\nthe text of the page"),
        ("<div class='no-sidebar'><p>" + "the text of the page " * 9 + "</p></div><div class='ad'>buy</div>", ("the text of the page " * 9).strip()),
        ("<article><p>" + "the text of the page " * 9 + "</p></article><div class='related'><article><h1>R</h1>a teaser</article></div>", ("the text of the page " * 9).strip()),
        ("<main>" + "".join(f"<article><p>{'words of an article ' * 20}{i}</p></article>" for i in "ab") + "<p>x</p></main>", "\n\n".join('words of an article ' * 20 + i for i in "ab")),
        ("<article>the text of the page<article class='comment'>the text of a reader</article></article>", "the text of the page"),
        ("<form id='aspnetForm'><div><p>" + "the text of the page " * 9 + "</p></div><input></form>", ("the text of the page " * 9).strip()),
        ("<form><p>Name<p>Password</form><p>Sign in to go on reading</p>", "Sign in to go on reading"),
        ("<div class='related-menu-none'><article><p>the text of the page</p></article></div>", "the text of the page"),
        ("<div id='page-no-header'><p>" + "the text of the page " * 9 + "</p><p>more of it</p></div>", "the text of the page " * 8 + "the text of the page\n\nmore of it"),
    ],
)
def test_hints_and_sibling_articles(html, want):
    assert html_text.main_text(html) == want


def test_unmarked_content_is_found_by_density():
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(15))
    body = "".join(f"<p>{'sentence with many words ' * 10}{i}</p>" for i in range(6)) + "<p>Short.</p>"
    html = f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><ul>{menu}</ul></div></body>"
    got = html_text.main_text(html).split("\n\n")
    assert len(got) == 7 and got[-1] == "Short." and got[0].startswith("sentence")


def test_ends_of_the_low_cluster_go_where_nothing_marks_the_content():
    body = "".join(f"<p>{'sentence with many words ' * 10}{i}</p>" for i in range(6))
    tail = "".join(f"<div><b><i>Item</i> {i}</b></div>" for i in range(8))
    html = f"<body><div>Home / About us</div><div>{tail}</div><h1>Title</h1>{body}<p>Short.</p>{body}<p>End.</p><div>{tail}</div><div>© 2024 Us</div></body>"
    got = html_text.main_text(html).split("\n\n")
    assert got[0] == "Title" and got[-1] == "End." and len(got) == 15


def test_extracted_text_against_a_labelled_set():
    """Generated pages whose main text is known line by line."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randrange(3, 12))) + "</ul>"
    for n in range(200):
        paragraphs = [sentence(rng.randrange(12, 90)) for _ in range(rng.randrange(2, 9))]
        want = [sentence(3), *paragraphs]
        body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{p}</p>\n" + (f"<div class='{rng.choice(['ad', 'share-bar', 'newsletter'])}'>{sentence(8)}</div>" if rng.random() < 0.2 else "") for p in paragraphs)
        inner = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='post'>{}</div>"]).format(body)
        html = f"<html><head><title>{sentence(4)}</title><script>var x = '<p>{word()}</p>';</script></head><body><nav>{menu()}</nav>"
        html += f"<div class='{rng.choice(['wrap', 'layout has-sidebar'])}'>{inner}<aside>{menu()}{sentence(20)}</aside></div>"
        html += f"<div id='comments'><p>{sentence(30)}</p></div><footer>{menu()}{sentence(6)}</footer></body></html>"
        assert html_text.main_text(html).split("\n\n") == want, (n, html)


def test_extract_edges(spark):
    rows = [(1, "u", "<p>" + "w " * 300_000), (None, None, None), (1, "u", "<p>a"), (1, "u", "<p>a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [r.n_chars for r in got] == [599_999, 0, 1, 1] and got[1].text == ""
    assert html_text.extract(df.where("false")).collect() == []


def test_quality_texts_from_another_frame(spark):
    rows = quality_rows(80, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    one = quality.score(df, quality.train(df, 50)).orderBy("doc_id").collect()
    two = quality.score(df, quality.train(df.drop("text"), 50, texts=df.drop("quality"))).orderBy("doc_id").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two]
