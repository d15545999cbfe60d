"""Operators that SQL can't express, against plain Python that follows their definitions row by row."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import langid, media, quality_model, quality_rules, stages
from stratagraph.llm.common import mix64
from tests.llm.test_operators import BMP, SCHEMA, WORD, documents

# language


def grams(text):
    """Hashes of n-grams within words, blanks at a word's ends included, by the definition."""
    points = [ord(c) for c in f" {text.lower()} "]
    letters = [p if 65 <= p <= 90 or 97 <= p <= 122 or p >= 192 else 32 for p in points]
    out = []
    for size in (3, 4):
        for i in range(len(letters) - size + 1):
            own = letters[i : i + size]
            if 32 not in own[1:-1]:
                code = 0
                for k, p in enumerate(own):
                    code |= p << 16 * k
                out.append((code + size) % 2**64)
    return mix64(np.array(out, np.uint64)).tolist()


def test_language_matches_brute_force(spark):
    table = [(i, t, lang) for i, t, lang, *_ in documents() if not (t and len(t) > 100_000)]
    table += [(2000 + i, f"fremde wörter der sprache {i} und the of", "de") for i in range(5)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(3)
    known = [(t, lang) for _, t, lang in table if t is not None and lang is not None]
    sizes = collections.Counter(lang for _, lang in known)
    docs = {lang: collections.Counter(g for t, own in known if own == lang for g in set(grams(t))) for lang in sizes}
    rate = {lang: {g: n / sizes[lang] for g, n in c.items()} for lang, c in docs.items()}
    kept = {}
    for lang, c in docs.items():
        need = min(langid.MIN_DOCS, max(1, sizes[lang] // 10))
        kept[lang] = {g for g, n in c.items() if n >= need and rate[lang][g] >= langid.RATE * max(r.get(g, 0) for r in rate.values())}
    positions = langid.LanguageFilter.size(max(map(len, kept.values())))

    def places(g):
        low, high = g & 0xFFFFFFFF, g >> 32 | 1
        return [(low + i * high) % 2**64 % positions for i in range(langid.HASHES)]

    bits = {lang: {p for g in own for p in places(g)} for lang, own in kept.items()}
    false = {lang: (len(b) / positions) ** langid.HASHES for lang, b in bits.items()}
    model = langid.fit(frame)
    assert model.languages == sorted(sizes) and model.false_rate.tolist() == pytest.approx([false[x] for x in sorted(sizes)])
    for r in langid.predict(frame, model, carry=["doc_id", "text"]).collect():
        own = grams(r.text or "")
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {}
        for lang in sorted(sizes):
            hits = sum(all(p in bits[lang] for p in places(g)) for g in own)
            p = false[lang]
            share[lang] = min(1.0, max(0.0, (hits - len(own) * p) / (len(own) * (1 - p)))) if own else 0.0
        best = max(sorted(share), key=lambda x: share[x])
        first, second = sorted(share.values(), reverse=True)[:2]
        assert r.lang_pred == best and r.share == pytest.approx(first, abs=1e-9) and r.score == pytest.approx(first / (first + second) if first else 0.0, abs=1e-9), r.text


def test_no_gram_is_left_out():
    assert langid.LanguageFilter.size(10) == langid.LEAST and langid.LanguageFilter.size(10**6) == 1 << 24 and langid.LanguageFilter.size(10**9) == langid.MOST
    grams_ = np.unique(np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64))
    made = langid.LanguageFilter.build({"a": grams_})
    assert all((made.masks[at, 0] & 1).all() for at in made.positions(grams_)) and made.false_rate[0] < 0.03


# weak supervision


def test_posteriors_match_estimation_row_by_row(spark):
    rng = random.Random(31)
    table = [(i, t) for i, t, *_ in documents() if not (t and len(t) > 100_000)]
    for i in range(3000, 3080):
        words = [rng.choice(["house", "tree", "WALK", "%%", "!!!!", "a", "&|<>", "stone", "of"]) for _ in range(rng.randint(1, 90))]
        table.append((i, " ".join(words * rng.choice([1, 1, 3]))))
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    rules = quality_rules.rules()
    votes = {r.doc_id: [r[k] for k in rules] for r in quality_rules.measured(frame, carry=["doc_id"]).select("doc_id", *[v.alias(k) for k, v in rules.items()]).collect()}
    size = len(rules)
    cast = [sum(v[k] != 0 for v in votes.values()) for k in range(size)]
    start, weight = quality_rules.PRIOR
    accuracy, good = [start] * size, quality_rules.START_GOOD
    for _ in range(quality_rules.ROUNDS):
        post = {}
        for i, v in votes.items():
            odds = math.log(good / (1 - good)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, accuracy))
            post[i] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        fresh = []
        for k in range(size):
            right = sum(post[i] if v[k] > 0 else 1 - post[i] for i, v in votes.items() if v[k])
            pull = weight * cast[k] + 1
            fresh.append(min(0.99, max(0.55, (right + start * pull) / (cast[k] + pull))))
        good = min(0.95, max(0.05, sum(post.values()) / len(post)))
        if max(abs(a - b) for a, b in zip(fresh, accuracy)) < 1e-9:
            break
        accuracy = fresh
    got = quality_rules.judged(frame, carry=["doc_id"]).collect()
    assert len(got) == len(table) and {r.kept for r in got} == {True, False}
    for r in got:
        odds = math.log(good / (1 - good)) + sum(x * math.log(a / (1 - a)) for x, a in zip(votes[r.doc_id], accuracy))
        want = 1 / (1 + math.exp(-odds))
        assert r.posterior == pytest.approx(want, abs=1e-6)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (r.kept == (not failed and want >= 0.5) or abs(want - 0.5) < 1e-6)


# kernel ridge


def test_kernel_ridge_matches_a_dense_solution(spark):
    rng = random.Random(37)
    rows = []
    for i in range(300):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["house", "tree", "river"] if good or rng.random() < 0.3 else ["AAA!!", "%%", "12"]) for _ in range(rng.randint(3, 40)))
        rows.append((quality_model.statistics(text).tolist(), int(good)))
    frame = spark.createDataFrame(rows, "stats array<double>, y int").repartition(4)
    model = quality_model.fit(frame)
    stats, y = np.array([s for s, _ in rows]), np.array([v for _, v in rows], float)
    assert np.allclose(model.mean, stats.mean(0), atol=1e-5) and np.allclose(model.spread, np.maximum(stats.std(0), 1e-3), atol=1e-5)
    x = model.features(stats)
    centred = np.clip((stats - model.mean) / model.spread, -6, 6)
    assert np.allclose(x[:, 1:], np.cos(centred @ model.turn + model.phase) * math.sqrt(2 / (quality_model.FEATURES - 1))) and (x[:, 0] == 1).all()
    ridge = quality_model.RIDGE * len(rows) * np.eye(quality_model.FEATURES)
    ridge[0, 0] *= 1e-6
    weights = np.linalg.solve(x.T @ x + ridge, x.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-3)
    raw = np.clip(x @ model.weights, quality_model.LOW, quality_model.HIGH)
    at = np.minimum(((raw - quality_model.LOW) / (quality_model.HIGH - quality_model.LOW) * quality_model.BINS).astype(int), quality_model.BINS - 1)
    used = sorted(set(at.tolist()))
    count, total = [int((at == b).sum()) for b in used], [float(y[at == b].sum()) for b in used]
    # the isotonic mean of a bin: the largest, over beginnings, of the smallest, over ends, mean of a run that holds it
    means = [max(min(sum(total[a : b + 1]) / sum(count[a : b + 1]) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    assert sorted({round(m, 9) for m in means}) == pytest.approx(sorted({round(v, 9) for v in model.values.tolist()}))
    for v, k in zip(model.values, model.knots):
        mine = [i for i, m in enumerate(means) if abs(m - v) < 1e-9]
        centre = [quality_model.LOW + (used[i] + 0.5) * (quality_model.HIGH - quality_model.LOW) / quality_model.BINS for i in mine]
        assert k == pytest.approx(sum(c * count[i] for c, i in zip(centre, mine)) / sum(count[i] for i in mine))
    assert np.allclose(model.score(stats), np.interp(raw, model.knots, model.values))


# media


def test_stored_forms_and_features(spark):
    bmp = BMP.decode("ascii")
    texts = {1: "plain text", 2: None, 3: f"x {bmp} and {bmp}", 4: "é" * 200, 5: f"x {bmp} and {bmp}"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in media.read_samples(media.stored_samples(frame)).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        lines = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")]
        stored = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
        carved = [] if "BM" not in (text or "") else [f"image/bmp@{k}+{len(bmp)}" for k in range(len(raw)) if raw[k : k + len(bmp)] == bmp.encode()]
        rough = sum(abs(a - b) for a, b in zip(payload, payload[1:]))
        want = f"image/png;corrected=1;chunks={'+'.join(f'{k.decode()}:{len(d)}' for k, d in parts)};carved={len(carved)}[{','.join(carved)}];64x{len(payload) // 64};max={max(payload)};sum={sum(payload)};ink={sum(b > 0 for b in payload)};rough={rough}"
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), want)
    assert "carved=2[" in got[3].feature and tuple(got[3])[1:] == tuple(got[5])[1:]


# stages


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    names = ["lang_pred", "score", "share", "held_out", "n_lines", "n_dropped", "size", "source_size", "target", "copies", "id", "rep", "h1", "n_shingles", "component_id", "kept", "__x"]
    frame = spark.createDataFrame(documents(n=60), SCHEMA).withColumns({n: F.lit(n) for n in names})
    odd = frame.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint"))
    frame = frame.unionByName(frame.filter("doc_id in (4, 1001)")).unionByName(odd)
    frame.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0, name
        got = out.collect()
        assert all(r[n] == n for r in got for n in names), name
        ids = collections.Counter(r.doc_id for r in got)
        if name == "lines":
            assert ids == collections.Counter(r.doc_id for r in docs.collect())
        if name == "near":
            assert ids[None] == 1 and ids[4] == 1 and ids[1000] == ids[1002] == 1 and ids[1001] == 2
    last = stages.pieces(spark, docs, "").collect()
    assert len(last) == docs.count() and {r.n_tokens for r in last if r.doc_id in (1000, 1001)} == {1}


def test_language_stage_keeps_what_the_filters_know(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    rows = frame.collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(spark.createDataFrame(learned, SCHEMA))
    names, _, shares = model.predict([r.text for r in rows])
    want = {r.doc_id for r, n, s in zip(rows, names, shares) if n != "und" and s >= stages.MIN_SHARE}
    assert {r.doc_id for r in stages.language(spark, frame, "").collect()} == want and WORD
