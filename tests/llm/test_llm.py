"""Corpus operators against brute force, round trips and held-out accuracy, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from pyspark.sql import functions as F
from tributary.llm import chat, jaccard, langid, lm, mixing, ogg, pieces, queries, rulefit, sharding, shingles, topk

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, shard int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows=None):
    """Nulls in every column, empty texts, repeated rows, a long text, and columns that clash with results."""
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    if rows is None:
        rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None) for i in range(40)]
        rows += [(100, None, "en", "s1"), (101, "", None, "s2"), (None, "a null id", "en", None), (102, "x " * 20_000, "en", "s0"), rows[3], rows[3], (103, " \t\n ", "de", "s0"), (104, rows[5][1], "en", "s9")]
    return spark.createDataFrame([(*r, None, 7, 7, 7) for r in rows], DOCS), rows


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    rel = con.execute(queries.ORACLE_SQL[name])
    cols, want = [d[0] for d in rel.description], rel.fetchall()
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(cols)
    assert sorted(df.columns) == order
    assert sorted(tuple(text(r[c]) for c in order) for r in df.collect()) == sorted(tuple(text(r[cols.index(c)]) for c in order) for r in want)


# 1 n-gram Jaccard join


def sets_of(text, size=3):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size=3, percent=90):
    sets = [sets_of(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = collections.defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), d if not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, n=90):
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        w = base[i % 6].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "one two"), (205, rows[0][1]), (205, rows[0][1]), (206, "word " * 3000)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    rows = near_copies(random.Random(size))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(collected(jaccard.components_of(df, size, percent), "doc_id", "n_shingles", "component_id")) == brute_components(rows, size, percent)


@pytest.mark.parametrize("heavy, rounds, shrunk", [(600, 4, 0.7), (2000, 2, 2.0)])
def test_heavy_cells_are_taken_apart_exactly(spark, monkeypatch, heavy, rounds, shrunk):
    """Near copies of several kinds that share passages, so that regions are parted by documents, and joined as pairs of blocks."""
    for k, v in {"HEAVY": heavy, "ROUNDS": rounds, "SHRUNK": shrunk, "PIVOTS": 3}.items():
        monkeypatch.setattr(jaccard, k, v)
    rng = random.Random(8)
    rows = near_copies(rng, 60)
    common = [f"c{i}" for i in range(12)]
    kinds = [[*common, *(f"k{k}x{i}" for i in range(40))] for k in range(4)]
    for i in range(70):
        w = list(kinds[i % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(12, len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(collected(jaccard.components_of(df), "doc_id", "n_shingles", "component_id")) == brute_components(rows)


def test_ids_that_are_null_repeated_or_large(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])
    rows = [(2**60 + 1, near(59)), (None, near(58)), (None, near(58)), (7, near(57)), (7, "a b c d e f"), (8, "a b c d e f"), (None, "lone words here they are"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, collected(jaccard.components_of(df, 3, 80), "doc_id", "n_shingles", "component_id")))
    assert got == sorted(map(str, [(2**60 + 1, 58, 7), (None, 58, 7), (None, 58, 7), (7, 58, 7), (7, 4, 7), (8, 4, 7), (None, 3, None), (None, 0, None), (3, 0, 3)]))
    gone = sorted(map(str, collected(jaccard.duplicates(df, 3, 80).join(df.withColumn("key", F.xxhash64("text")).distinct(), ["key"]).select("text", jaccard.F.col("key")), "text")))
    assert gone == sorted(map(str, [(near(59),), (near(58),), ("a b c d e f",), ("a b c d e f",)]))


def test_regions_by_document_pivots_lose_no_link():
    rng = random.Random(3)
    base = [rng.sample(range(10_000), 60) for _ in range(12)]
    sets = []
    for i in range(400):
        s = set(base[i % 12])
        for _ in range(rng.randrange(4)):
            s.pop()
            s.add(rng.randrange(10_000, 20_000))
        sets.append(np.array(sorted(s), np.uint64))
    j = jaccard.Join(sets, 90)
    j.region(np.arange(len(sets)))
    plain = jaccard.Join(sets, 90)
    plain.compare(np.arange(len(sets)), np.arange(len(sets)))
    assert [j.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_empty_table_of_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components_of(df).count() == 0


def test_shingle_hashes_tell_sets_apart(monkeypatch):
    texts = ["a b c d", "a b c", "A  B\tC", "a b", "ab", "", None, "a b c a b c", "é è ê", "word" * 100]
    monkeypatch.setattr(shingles, "BLOCK", 16)
    got = [tuple(x) for x in shingles.shingle_sets(texts)]
    assert [len(x) for x in got] == [len(sets_of(t)) for t in texts]
    assert (got[1] == got[2]) and len(set(got)) == len(set(map(sets_of, texts)))


# 2 SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrsth ▁\n\t.<>/0é😀　\x00한的ab�")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoding_equals_the_library(library, text):
    e = pieces.encoder(MODEL)
    ids = library.encode(text, add_eos=True)
    assert e.encode(text) == ids and e.decode(ids) == library.decode(ids)


def test_encoding_of_documents(spark, library):
    df, rows = documents(spark)
    got = sorted(map(str, collected(pieces.digests(df, MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")))
    hexed = lambda b: hashlib.sha256(b.encode()).hexdigest()
    ids = [library.encode(r[1] or "", add_eos=True) for r in rows]
    assert got == sorted(str((r[0], len(i), hexed(" ".join(map(str, i))), hexed(library.decode(i)))) for r, i in zip(rows, ids))
    both = pieces.decode(pieces.encode(df, MODEL), MODEL)
    assert sorted(map(str, collected(both, "decoded"))) == sorted(str((library.decode(i),)) for i in ids)


def test_bytes_that_are_no_text_decode_like_the_library(library):
    e = pieces.encoder(MODEL)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000), 1, 2]) for _ in range(rng.randrange(8))]
        assert e.decode(ids) == library.decode(ids), ids


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pieces.digests(empty, MODEL).count() == 0 and ogg.media_features(empty).count() == 0 and sharding.interleaved_shards(empty).count() == 0
    assert mixing.mixture(empty).count() == 0 and lm.scores(empty, F.col("doc_id") > 0).count() == 0
    assert langid.predict(empty, langid.sample(empty, F.col("doc_id") > 0)).count() == 0
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    model = rulefit.train(empty, spark.createDataFrame([], "doc_id long, quality int"), F.col("doc_id") > 0)
    assert rulefit.score(empty, model).count() == 0


# 3 Ogg


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60_000), st.integers(1, 3))
def test_ogg_round_trip(raw, streams):
    payload = raw + ogg.PAD * (max(1, -(-len(raw) // ogg.FRAME)) * ogg.FRAME - len(raw))
    media = ogg.read(ogg.write(payload, streams))
    found = ogg.demultiplex(media)
    n = len(payload) // ogg.FRAME
    assert found.payload == payload and media.bad_pages == found.lost_pages == 0 and found.times == pytest.approx([(k + 1) * ogg.FRAME / found.rate for k in range(n)])


def test_page_checksum_by_the_bitwise_rule():
    def plain(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain(data)


def test_packets_continue_over_pages_and_damage_is_found():
    big = [bytes([i]) * n for i, n in enumerate((10, 255, 70_000, 0, 510, 3))]
    pages = ogg.paginate(5, big, list(range(len(big))))
    s = ogg.read(b"".join(pages)).streams[5]
    assert s.packets == big and s.ended and s.lost == 0
    hurt = bytearray(b"".join(pages))
    hurt[len(pages[0]) + 400] ^= 1
    m = ogg.read(b"junk" + bytes(hurt))
    assert m.bad_pages >= 1 and m.skipped > 4 and m.streams[5].packets[0] == big[0] and m.streams[5].lost == 1 and set(m.streams[5].packets) <= set(big)


def test_media_query(spark):
    df, rows = documents(spark)
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = collected(ogg.media_features(df), *columns)
    want = []
    for r in rows:
        p = ogg.padded(r[1])
        media = ogg.write(p)
        x = np.frombuffer(p, np.uint8).astype(float)
        pages = sum(media.count(ogg.CAPTURE + b"\0" + bytes([f])) for f in range(8))
        text = f"seconds={len(p) / ogg.RATE:.6f};pages={pages};mean={x.mean():.4f};std={x.std():.4f};rises={(x[1:] > x[:-1]).mean():.4f}"
        want.append((r[0], len((r[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), text))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_damaged_media(spark):
    payload = b"".join(bytes([i % 251]) * ogg.FRAME for i in range(600))
    data = ogg.write(payload)
    starts = [m.start() for m in re.finditer(b"OggS\0", data)] + [len(data)]
    parts = [data[a:b] for a, b in zip(starts, starts[1:])]
    hurt = [None, b"", b"no media", data[:-1], data + b"tail"]
    hurt += [b"".join(p for j, p in enumerate(parts) if j != i) for i in range(len(parts))]
    for at in range(3, len(data), 7919):
        b = bytearray(data)
        b[at] ^= 16
        hurt.append(bytes(b))
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(hurt)], "i long, media binary")
    got = {r["i"]: r["samples"] for r in ogg.with_samples(df).collect()}
    assert len(got) == len(hurt) and all(v is None for v in got[0].asDict().values())
    assert got[4]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[4]["bad_pages"] == 0
    for i in [1, 2, 3, *range(5, len(hurt))]:
        assert got[i]["payload_bytes"] is got[i]["payload_sha256"] is got[i]["feature"] is None and got[i]["media_bytes"] == len(hurt[i])
    assert all(got[i]["lost_pages"] + got[i]["bad_pages"] + got[i]["lost_frames"] >= 1 for i in range(9, 9 + len(parts) - 6))
    for i, x in enumerate(hurt[5:], 5):  # what is left is at its place
        assert all(f == payload[k * ogg.FRAME : (k + 1) * ogg.FRAME] for k, f in ogg.demultiplex(ogg.read(x)).frames.items()), i


# 4 language ID


def test_phrases_by_substring_search():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde ") for _ in range(400)) for _ in range(3)]
    p = langid.Parser([("x", texts[:1]), ("y", texts[1:])])
    for probe in ("", "zzz", "abc", "".join(rng.choice("abcdefß ") for _ in range(3000))):
        c = p.alphabet.codes(probe)
        got = p.phrases([c])[0]
        for k, own in enumerate((texts[:1], texts[1:])):
            corpus = b"\x02".join(bytes(p.alphabet.codes(t)) for t in own)
            n = 0
            for a in range(0, len(c), langid.WINDOW):
                w, i = bytes(c[a : a + langid.WINDOW]), 0
                while i < len(w):
                    j = i
                    while j < len(w) and w[j] not in (0, 2) and w[i : j + 1] in corpus:
                        j += 1
                    i, n = max(j, i + 1), n + 1
            assert got[k] == n


def test_held_out_languages(spark):
    got = queries.op4_langid(spark, DATA).toPandas().merge(pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()


def invented(rng, letters, joint, n=260, words=60):
    """Texts of invented words of these letters."""
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(words)]
    return [joint.join(rng.choice(known) for _ in range(n)) for _ in range(24)]


def test_letters_of_all_scripts_count(spark):
    rng = random.Random(6)
    span = lambda a, b: [chr(i) for i in range(a, b)]
    made = {"zh": (span(0x4E00, 0x5100), ""), "ja": (span(0x3042, 0x3090) + span(0x6000, 0x6080), ""), "ru": (span(0x430, 0x450), " "), "el": (span(0x3B1, 0x3CA), " "), "an": (span(97, 123) + list("àéèüöñç"), " ")}
    rows = [(lang, t) for lang, (letters, joint) in made.items() for t in invented(rng, letters, joint)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.sample(df, F.col("doc_id") % 4 > 0)).filter("doc_id % 4 = 0").collect()
    assert len(got) == 30 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.5 and r["cost"] < 0.6 for r in got)


def test_languages_of_long_texts_and_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 4)
    monkeypatch.setattr(langid, "TEXTS", 6)
    rng = random.Random(7)
    rows = [("book", t) for t in invented(rng, "abcdefg", " ", n=3000)[:8]]
    rows += [(f"l{k}", t) for k in range(9) for t in invented(rng, "abcdefghijklmnop", " ", n=80)[:8]]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    labelled = langid.sample(df, F.col("doc_id") % 4 > 0)
    assert [lang for lang, _ in labelled] == sorted({lang for lang, _ in rows}) and all(len(t) <= langid.SAMPLE // 4 for _, texts in labelled for t in texts)
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(df, labelled).collect())


def test_language_of_odd_texts(spark):
    df, rows = documents(spark)
    got = langid.predict(df, langid.sample(df, F.col("doc_id") < 30))
    by = {r["text"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == len(rows) and by[None] == by[""] == by[" \t\n "] == ("und", 0.0) and by["a null id"][0] in ("de", "en")


# 5 LM scoring


def test_base_scores_and_probabilities(spark):
    df, rows = documents(spark)

    training = F.coalesce(F.col("doc_id") % 10 != 0, F.lit(True))
    c = collections.Counter()
    for d, t, *_ in rows:
        if d is None or d % 10:
            c.update(WORD.findall(low(t)))
            c[None] += 1
    n, mass = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = []
    for d, t, *_ in rows:
        w = [*WORD.findall(low(t)), None]
        want.append((str(d), len(w), sum(c[x] > 0 for x in w), n, f"{sum(math.log10((c[x] + 0.1) / mass) for x in w):.6f}"))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}") for r in lm.scores(df, training).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("page, bucket", [(lm.PAGE, lm.BUCKET), (500, 700)])
def test_scores_equal_the_definition(spark, monkeypatch, page, bucket):
    """Rare and frequent pairs and triples, in one page or many; the walk by its definition, over counts of everything."""
    rng = random.Random(4)
    phrases = [[f"w{rng.randrange(4000)}" for _ in range(6)] for _ in range(900)]
    rows = [(i, " ".join(w for _ in range(12) for w in rng.choice(phrases))) for i in range(400)] + [(900, None), (901, "w1 never w2"), (None, "w3 w4"), (5, "w5")]
    rows += [(2**60 + 1, "w1 w2 w1 w2 " * 300)]
    monkeypatch.setattr(lm, "PAGE", page)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    texts = [["<", *WORD.findall(low(t)), ">"] for _, t in rows]
    for d, t in zip((r[0] for r in rows), texts):
        if d is None or d % 10:
            one.update(t[1:])
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    starts = sum(d is None or d % 10 != 0 for d, _ in rows)
    mass = sum(one.values()) + 0.1 * (len(one) + 1)
    kept = {2: {g: c for g, c in two.items() if c >= lm.LEAST}, 3: {g: c for g, c in three.items() if c >= lm.LEAST}}
    after = collections.defaultdict(list)
    for g in [*kept[2], *kept[3]]:
        after[g[:-1]].append(g[-1])
    cache = {}

    def p(h, w):
        if not h:
            return (one[w] + 0.1) / mass
        c = two[h] if len(h) == 2 else starts if h == ("<",) else one[h[0]]
        if (*h, w) in kept[len(h) + 1]:
            return (kept[len(h) + 1][*h, w] - 0.75) / c
        if h not in cache:
            cache[h] = (1 - sum(p(h, v) for v in after[h])) / (1 - sum(p(h[1:], v) for v in after[h]))
        return cache[h] * p(h[1:], w)

    want = [sum(math.log10(p(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t))) for t in texts]
    got = lm.scores(df, F.coalesce(F.col("doc_id") % 10 != 0, F.lit(True))).collect()
    assert len(kept[3]) > 1000
    for h in [(), ("<",), ("<", "w5"), *list(kept[2])[:20], *list(two)[-5:]]:  # all next tokens and the unseen word
        assert sum(p(h, w) for w in one) + p(h, "unseen") == pytest.approx(1)
    assert sorted((str(r["doc_id"]), f"{r['score']:.5f}") for r in got) == sorted((str(d), f"{w:.5f}") for (d, _), w in zip(rows, want))


# 6 and 9 sharding, mixing


def test_shards_match_the_mixture(spark):
    df, rows = documents(spark)
    got = sharding.interleaved_shards(df, 8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    many, _ = documents(spark, [(i, "x", "en", "big" if i % 3 else f"s{i % 2}") for i in range(240)])
    names = {r["doc_id"]: r["source"] for r in many.collect()}
    mix = collections.Counter((r["shard"], names[r["doc_id"]]) for r in sharding.interleaved_shards(many, 8).collect())
    assert all(abs(n - 20 if s == "big" else n - 5) <= 1 for (_, s), n in mix.items())


def test_mixture_reaches_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(400, None, "en", "a"), (401, "", "en", None)]
    df, _ = documents(spark, rows)
    got = mixing.mixture(df).collect()
    name = {r[0]: r[3] for r in rows}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = name[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    clash = df.withColumns({"target": F.lit(1), "source_size": F.lit(2), "__src": F.lit("x"), "__row": F.lit(3), "a.b": F.lit(4), "__block": F.lit(5)})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and mixed.filter("target = 1 and __src = 'x' and __block = 5").count() == mixed.count() > 0
    goal, left, weight = 1.5 * sum(size.values()), {}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    left = dict(weight)
    want = {}
    while True:
        rest = goal - sum(want.values())
        over = [s for s in left if rest * left[s] / sum(left.values()) > 2 * size[s]]
        if not over:
            want |= {s: rest * left[s] / sum(left.values()) for s in left}
            break
        for s in over:
            want[s] = 2.0 * size[s]
            del left[s]
    assert len(got) == len(rows) and all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 6 for s in want)
    assert sorted(map(tuple, mixing.mixture(df).collect())) == sorted(map(tuple, got))
    assert set(mixing.mixed_documents(df).columns) == set(df.columns)


def test_small_sources_reach_their_targets_beside_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1 << 12)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(3000, 9000), "en", "abcdef"[i % 6]) for i in range(480)]  # blocks of 1,000 words
    small = {"t1": 50, "t2": 300, "t3": 1_000, "t4": 3_000, "t5": 9_000}
    for name, n in small.items():
        rows += [(1000 + len(rows) + k, "w " * (n // 5), "en", name) for k in range(5)]
    df, _ = documents(spark, rows)
    name = {r[0]: r[3] for r in rows}
    taken, target = collections.Counter(), {}
    for r in mixing.mixture(df).collect():
        taken[name[r["doc_id"]]] += r["taken"]
        target[name[r["doc_id"]]] = r["target"]
    assert all(target[s] == 2 * n for s, n in small.items())
    assert all(abs(taken[s] - target[s]) <= 0.015 * target[s] + 3 for s in target)


# 7 top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (205, rows[1][1]), (206, [1.0, 2.0]), (207, []), (208, [0.0] * 6)]
    rows += [(220, [2.0**40, -1.0, 0.3]), (221, [2.0**20, 5.0, 0.0, 1.0]), (240, [3.0**60, 1.0]), (241, [-(2.0**30)] * 6), (2**60 + 1, rows[3][1])]
    got = sorted(collected(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5), "query_id", "rank", "vec_id", "score"))
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in sorted(i for i in v if i % 20 == 0):
        s = sorted(((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q))[:5]
        want += [(q, k + 1, i, min(max(-n, -(2**63)), 2**63 - 1)) for k, (n, i) in enumerate(s)]
    assert got == want


def test_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (16, 32))
    x = np.concatenate([c + rng.integers(-3, 4, (64, 32)) for c in centres]).astype(float)
    ids = np.arange(len(x))
    s, i, visits = topk.best(x[::40], ids[::40], x, ids, 10, block=32)
    assert visits < len(x[::40]) * (len(x) // 32) // 2
    full = x[::40] @ x.T
    full[np.arange(len(full)), ids[::40]] = -np.inf
    assert (np.sort(full, 1)[:, ::-1][:, :10] == s).all()
    big = np.array([[2.0**25] * 3, [2.0**25 - 1] * 3, [1.0] * 3])  # beyond exact floats
    s, i, _ = topk.best(big, np.arange(3), big * 2**10, np.arange(3), 2)
    assert s.dtype == object and int(s[0][0]) == 3 * 2**25 * (2**25 - 1) * 2**10


# 8 quality


def test_quality_on_held_out_rows(spark):
    got = queries.op8_rulefit(spark, DATA).toPandas().merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 5 and (held.predicted == held.quality).mean() > 0.85 and got.score.between(0, 1).all()


def test_rules_in_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(rulefit.STATISTICS)))
    y = ((x[:, 3] > 0.3) | (x[:, 7] < -1)).astype(float)
    m = rulefit.fit(x, y)
    z = m.bias + sum(w * r.holds(x) for r, w in zip(m.rules, m.weights))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"__q_{s} double" for s in rulefit.STATISTICS))
    got = np.array([r[0] for r in df.select(m.column()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == y).mean() > 0.95 and len(m.rules) < 150
    assert rulefit.fit(x, np.ones(len(x))).column() is not None and rulefit.fit(x[:0], y[:0]).rules == []


def test_statistics_by_python(spark):
    df, rows = documents(spark, [(i, t, "en", "s") for i, t in enumerate([None, "", " ", "A b", "one two two two one two", "x\ny\nx\nx\n", "É9 $$ <a> (ok)!", "l 1\n\n\nl 1", "w " * 3000, "Ä\tü  ü\rZ9"])])
    got = {r["doc_id"]: r for r in rulefit.with_statistics(df).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w, n, lines = WORD.findall(t), max(1, len(t)), t.split("\n")
        pairs = list(zip(w, w[1:]))
        again = lambda xs: (len(xs) - len(set(xs))) / max(1, len(xs))
        want = dict(
            chars=math.log1p(len(t)), words=math.log1p(len(w)), word_length=len(t) / max(1, len(w)), upper=sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in t) / n,
            digits=sum(c in "0123456789" for c in t) / n, symbols=sum(not (c.isalpha() or c.isnumeric() or c in " \t\n\r\v\f.,;:'\"()-") for c in t) / n, lines=t.count("\n") / n,
            distinct=len(set(w)) / max(1, len(w)), longest_run=sum(a == b for a, b in pairs) / max(1, len(w)), repeated_lines=again(lines), repeated_pairs=again(pairs))
        if len(w) < 2:
            want.pop("longest_run")
        for name, v in want.items():
            assert got[i]["__q_" + name] == pytest.approx(v), (i, name)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(500, 30))
    m = (m - m.mean(0)) / m.std(0)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * m[:, 0] - m[:, 1] + 0.5)))).astype(float)
    w, b = rulefit.lasso(m, y, 0.0)
    p = 1 / (1 + np.exp(-(m @ w + b)))
    g = m.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-6 and (np.abs(g[w == 0]) <= rulefit.PENALTY + 1e-6).all() and np.allclose(g[w != 0], -rulefit.PENALTY * np.sign(w[w != 0]), atol=1e-6)
    loss = lambda w, b: np.mean(np.log1p(np.exp(-(2 * y - 1) * (m @ w + b)))) + rulefit.PENALTY * np.abs(w).sum()
    assert all(loss(w, b) <= loss(w + rng.normal(size=30) * s, b + rng.normal() * s) for s in (1e-3, 1e-2, 0.1) for _ in range(20))


def test_label_samples_are_bounded(spark, monkeypatch):
    rows = [(i % 50, f"text {i % 70}", "en", "s") for i in range(2000)]
    df, _ = documents(spark, rows)
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(3000)], "doc_id long, quality int")
    assert rulefit._few(labels, F.xxhash64("doc_id", "quality"), 100).count() == 100 and rulefit._few(labels, F.xxhash64("doc_id"), 10**6).count() == 3000
    monkeypatch.setattr(rulefit, "ROWS", 40)
    got = rulefit.score(df, rulefit.train(df, labels, F.col("doc_id") >= 0)).select("score").distinct().collect()
    assert all(0 <= r[0] <= 1 for r in got)


def test_quality_of_odd_texts(spark):
    df, rows = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = rulefit.score(df, rulefit.train(df, labels, F.col("doc_id") >= 0))
    by = {r["text"]: r["score"] for r in got.collect()}
    assert got.count() == len(rows) and by[None] == by[""] and all(0 <= s <= 1 for s in by.values()) and set(df.columns) <= set(got.columns)


# 10 chat


ODD = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]", "[[INST]]", "<s><s>", "", None, " [/SYS]", "a\nb  ", "[ROLE]x[TEXT]y[/ROLE]", "[TEXT", "\\\\[/ROLE]", "é😀"]


def test_turns_come_back_from_the_formatted_text(spark):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "[ROLE]", "us\\er"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(ODD)) for c in [*range(60), None] for t in range(rng.randint(1, 6))]
    rows += rows[:3]
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        state, ok = "start", True
        for *_, r, _x in turns:
            state = chat.MOVES.get((state, r))
            ok &= state is not None
            if not ok:
                break
        assert got[c]["valid"] == (ok and state in chat.FINAL)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from tributary.plans.scratch import Scratch

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, columns = Scratch(spark, "test"), docs.columns
    at = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        if name != p.STAGES[-1][0]:
            assert out.columns == columns
        docs = scratch.save(out, name)
        at[name] = docs.toPandas()
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id").quality
    kept = at["quality"]
    good = labels[labels == 1].index
    assert set(good) & set(at["language_id"].doc_id) == set(good)
    assert len(set(good) - set(kept.doc_id)) <= 0.02 * len(good) and labels.reindex(kept.doc_id).eq(0).sum() <= 0.35 * labels.eq(0).sum()
    rows = list(zip(kept.doc_id.tolist(), kept.text))
    want = {c for *_, c in brute_components(rows, p.SHINGLE, p.SIMILARITY)}
    assert set(at["near_duplicates"].doc_id) == want and len(at["near_duplicates"]) == len(want)
    times = at["mixing"].doc_id.value_counts()
    assert times.max() <= 2 and set(times.index) <= want and len(at["sentencepiece"]) == len(at["mixing"])
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = dict(rows)
    assert all(r.n_tokens == len(sp.encode(text[r.doc_id])) + 1 for r in at["sentencepiece"].itertuples())


def test_nearest_duplicates_of_repeated_rows(spark):
    import corpus_pipeline as p

    long = "one two three four five six seven eight nine ten"
    df, _ = documents(spark, [(1, long, "en", "s"), (1, long, "en", "s"), (2, long, "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")])
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, df, DATA).collect()) == [1, 3, 4]
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (2, "another clean text of seven words", "en", "s"), (2, "another clean text of seven words", "en", "s"), (None, "a row without an id stays", "en", "s"), (None, long, "en", "s")]
    df, _ = documents(spark, rows)
    got = sorted((str(r["doc_id"]), r["text"]) for r in p.near_duplicates(spark, df, DATA).collect())
    assert got == [("1", long), ("2", "another clean text of seven words"), ("None", "a row without an id stays")]


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p
    from tributary.plans.scratch import Scratch

    docs, scratch = spark.read.parquet(f"{DATA}/documents.parquet"), Scratch(spark, "test")
    names = ["target", "source_size", "__src", "__row", "__key", "__h", "__score", "score", "size", "root", "digest", "fit"]
    odd = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    odd = odd.unionByName(spark.createDataFrame([(None, None, None, None, None, *[2] * len(names)), (1, "", "en", "a", 0, *[0] * len(names)), (None, "word " * 30_000, None, None, 1, *[1] * len(names))], odd.schema))
    for table in (odd, odd.limit(0)):
        for name, stage in p.STAGES:  # every stage on the whole table
            out = scratch.save(stage(spark, table, DATA), f"{name}{table is odd}")
            if name != p.STAGES[-1][0]:
                assert out.columns == odd.columns and (out.count() > 0) == (table is odd)
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted({int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)}) == list(range(1, 11))
    assert json.dumps(sorted(entry.oracle_sql()))
