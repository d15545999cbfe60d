"""The ten operators on small inputs, against brute force, exact round trips and the libraries."""

import base64
import collections
import hashlib
import io
import random
import re
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import langid, linededup, media, mixing, mphf, neardup, piece, quality_model, quality_rules, tokenbin, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed=1, n=120):
    rng = random.Random(seed)
    words = {"en": "the of and house tree walking over under river stone bright".split(), "de": "der die und haus baum gehen über unter fluß stein hell".split()}
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    for i in range(n, n + 12):
        rows.append((i, rows[i % 7][1] + ("\nCommon line" if i % 2 else "\n  common LINE\t"), "en", "s0", 0))
    long = "word " * 30_000
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t", "en", "s1", 3), (1003, long, "en", None, len(long)), (1004, long, "en", None, len(long)), (1005, "12 34 !?", "en", "s2", 8), (1006, "<|endoftext|> </s> ▁x  y é😀", "en", "s2", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    # columns of names that operators use, repeated rows
    frame = frame.withColumns({"size": F.lit("x"), "score": F.lit(7), "n_lines": F.lit(1), "id": F.lit("i"), "key": F.lit(0), "_text": F.lit(None).cast("string"), "_source": F.lit("q"), "n_words": F.lit(2), "kept": F.lit(True), "held_out": F.lit(1), "shingles": F.lit(1), "target": F.lit(0)})
    return frame.unionByName(frame.filter("doc_id = 5")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: str(sorted(r.items(), key=str)))


def test_perfect_hash_is_minimal_and_survives_bytes():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    made = mphf.PerfectHash.from_bytes(mphf.PerfectHash.build(keys).to_bytes())
    assert sorted(made.slots(keys)) == list(range(len(keys)))
    assert mphf.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        mphf.PerfectHash.build(np.array([1, 1], np.uint64))


# 1


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lengths_rule_and_warc_fields(version):
    odd = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nhttp://x/ 1.2.3.4 20010203040506 text/html 3\nabc"
    data = warc.arc_file([({"URL": "http://a/", "Archive-date": "20010203040506"}, odd), ({"URL": "http://b/", "Content-type": "image/gif"}, b"")], version, "f.arc")
    found = list(warc.parse_arc(data))
    assert [r.block for r in found[1:]] == [odd, b""] and found[0].first and {r.version for r in found} == {version}
    made = [warc.parse_warc(x) for x in warc.arc_to_warc(data, "f.arc", {1: warc.Original("<urn:uuid:1>", "http://a/", "20010203040506")})]
    assert [r.type for r in made] == ["warcinfo", "response", "revisit"]
    assert made[1].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and made[1].payload == odd.split(b"\r\n\r\n", 1)[1]
    assert made[1].headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(made[1].payload).digest()).decode()
    assert len({r.headers["WARC-Record-ID"] for r in made}) == 3
    assert [made[2].headers[f"WARC-Refers-To{x}"] for x in ("", "-Target-URI", "-Date")] == ["<urn:uuid:1>", "http://a/", "2001-02-03T04:05:06Z"]
    assert [r.type for r in map(warc.parse_warc, warc.arc_to_warc(data, "f.arc"))][2] == "resource"
    for broken in (data[:-2], data.replace(b"filedesc", b"file"), data.replace(b" 0 strata", b" 0 strata", 1)[:40]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_pages_round_trip(spark):
    table = [(3, "http://a b/\n", "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (5, "u", "é\n" * 9), (1, None, "x"), (None, "n", "x"), (9, "u", "y" * 100_000)]
    got = warc.pages_round_trip(spark.createDataFrame(table, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))).collect()
    first = {}
    for page, _, html in table:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html in table:
        body = (html or "").encode()
        revisit = page != first[html or ""]
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(want)
    assert warc.pages_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    small = warc.pages_round_trip(spark.createDataFrame(table, "page_id bigint, url string, html string"), min_bytes=2).filter("payload_bytes < 2 and record_type = 'revisit'")
    assert small.count() == 0


def test_archives_refer_to_records_and_are_the_same_again(spark):
    table = [(3, "http://a b/", "x"), (1, "http://c/", "x"), (2, "u", None), (4, "v", ""), (5, "w", "z")]
    frame = spark.createDataFrame(table, "page_id bigint, url string, html string")
    made = []
    for parts in (1, 4):
        folder = warc.fresh_dir(spark, "warc")
        warc.write_archives(warc.with_first(frame.repartition(parts)), folder).collect()
        found = []
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).collect():
            found += [warc.parse_warc(x) for x in warc.members(bytes(r.content))]
        made.append({r.http["x-page-id"]: r.headers for r in found if r.type != "warcinfo"})
    ids = [{k: (h["WARC-Record-ID"], h.get("WARC-Refers-To")) for k, h in x.items()} for x in made]
    assert ids[0] == ids[1] and len({i for i, _ in ids[0].values()}) == 5
    assert ids[0]["3"][1] == ids[0]["1"][0] and ids[0]["4"][1] == ids[0]["2"][0] and ids[0]["5"][1] is None
    assert made[0]["3"]["WARC-Refers-To-Target-URI"] == "http://c/" and made[0]["3"]["WARC-Target-URI"] == "http://a%20b/"


def test_members_are_read_in_slices():
    """A member costs the same in a file ten times as long, whatever slice its end falls into."""
    parts = [bytes([i % 251]) * (i * 37 % 900) for i in range(400)]
    data = b"".join(zlib.compress(x, 1, 31) for x in parts)
    for step in (1, 7, 64, 1 << 16):
        assert list(warc.members(data, step)) == parts
    with pytest.raises(ValueError):
        list(warc.members(data[:-3]))

    fed = []
    real = zlib.decompressobj

    class Fed:
        def __init__(self, *a):
            self.own = real(*a)

        def decompress(self, piece):
            fed.append(len(piece))
            return self.own.decompress(piece)

        eof = property(lambda self: self.own.eof)
        unused_data = property(lambda self: self.own.unused_data)

    warc.zlib.decompressobj = Fed
    try:
        costs = []
        for times in (1, 10):
            fed.clear()
            n = sum(1 for _ in warc.members(data * times, 512))
            costs.append(sum(fed) / n)
    finally:
        warc.zlib.decompressobj = real
    assert costs[1] < costs[0] * 1.1


# 2


def test_language(docs, empty):
    got = langid.identify(docs, carry=["doc_id", "lang"]).collect()
    assert len(got) == docs.count()
    plain = [r for r in got if r.doc_id < 120]
    assert sum(r.lang == r.lang_pred for r in plain) >= 0.97 * len(plain)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1000, 1001, 1002, 1005}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), carry=["doc_id"]).collect()} == {"und"}


def test_language_filter_bits_are_those_of_single_filters():
    rng = np.random.default_rng(5)
    grams = {f"l{i:02d}": rng.integers(0, 2**64, 2000, dtype=np.uint64) for i in range(11)}
    made = langid.LanguageFilter.build(grams)
    assert made.masks.shape == (langid.LEAST, 2)
    for i, name in enumerate(made.languages):
        at = made.positions(grams[name])
        assert all((made.masks[p, i // 8] >> (i % 8) & 1).all() for p in at)
    assert all(made.false_rate < 1e-3)


# 3


def brute_components(table, words, percent):
    sets = {}
    for i, text in table:
        found = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(found[j : j + words]) for j in range(max(1, len(found) - words + 1))} if found else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("words", "block"), [(4, 512), (5, 8)])
def test_near_duplicates_match_brute_force(spark, words, block):
    rng = random.Random(7)
    table = [(i, t) for i, t, *_ in documents()]
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    for i in range(2000, 2090):  # a family around the threshold, most of it not all alike
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        table.append((i, " ".join(own)))
    table += [(3000, "A b c"), (3001, "a  B\tc"), (3002, "a b"), (3003, None)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").withColumns({"n_shingles": F.lit(1), "component": F.lit(2)}).repartition(3)
    want = brute_components(table, words, 80)
    got = neardup.near_duplicates(frame, words, 80, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "")], "doc_id bigint, text string")
    got = collections.Counter(tuple(r) for r in neardup.near_duplicates(frame).collect())
    assert got == collections.Counter({(None, 2, None, True): 2, (7, 2, 7, True): 2, (9, 0, 9, True): 1})
    assert collections.Counter(r.doc_id for r in neardup.keep_first(frame).collect()) == collections.Counter({None: 2, 7: 1, 9: 1})
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id in (1003, 1004)").count() == 1


def test_repeated_ids_with_different_texts(spark):
    """No text is lost that is near no other; each group keeps one row."""
    near = " ".join(f"n{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    table = [(7, near, 1), (7, "totally other words that are near nothing at all", 2), (8, near + " end", 3), (9, other, 4), (9, other, 4), (9, other.upper(), 5), (10, other + " end", 6), (11, "", 7), (11, "", 8), (11, other + " stop", 9), (None, near, 10), (12, "only one", 11)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string, n int").withColumns({"id": F.lit(1), "rep": F.lit(2), "h1": F.lit(3)}).repartition(3)
    got = collections.Counter((r.doc_id, r.n) for r in neardup.keep_first(frame).collect())
    # of 9's equal sets the smallest text stays, which is the one in upper case; 11's empty rows stay, its other text goes
    assert got == collections.Counter([(7, 1), (7, 2), (9, 5), (11, 7), (11, 8), (None, 10), (12, 11)])
    found = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(frame).collect())
    assert found == collections.Counter([(7, 7), (7, 7), (8, 7), (9, 9), (9, 9), (9, 9), (10, 9), (11, 11), (11, 11), (11, 9), (None, None), (12, 12)])


def test_shared_counts_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(29)
    for n in (1, 2, 30):
        sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)]
        got = neardup.shared_counts(sets, (n + 1) // 2)
        for i, row in enumerate(got.tolist()):
            assert row[:i] + row[i + 1 :] == [len(np.intersect1d(sets[i], b)) for j, b in enumerate(sets) if j != i]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# 4


def test_pieces_equal_the_library():
    coder = piece.PieceCodec(piece.public_tokenizers.path(piece.MODEL))
    rng = random.Random(11)
    texts = [t or "" for _, t, *_ in documents()] + ["", " ", "  ", "\n", " \n ", "a" * 400, " " * 90, "日本語 ñandú\r\n\x00"]
    alphabet = " \n▁aeithnsr.,!ÉéЖ日😀01<>/_-=()\t"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(list(coder.ids)) for _ in range(9)).replace("▁", " ") for _ in range(400)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == coder.library.encode(text, add_eos=True), text
        assert coder.decode(ids) == coder.library.decode(ids)
    piece_memo = coder.spaced
    assert len(piece_memo) <= piece.MEMO


def test_piece_digests(docs, empty):
    got = {r.doc_id: r for r in piece.round_trip_digests(docs).collect()}
    assert (got[1000].n_tokens, got[1000].ids_sha256) == (1, hashlib.sha256(b"2").hexdigest())
    ids = {r.doc_id: r.ids for r in piece.encode_documents(docs).collect()}
    assert all(hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest() == r.ids_sha256 for i, r in got.items())
    assert piece.round_trip_digests(empty).count() == 0


# 5


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 3, "budget": 200}, {"index_min": 1, "shard_keys": 50, "budget": 900}])
def test_common_lines_match_brute_force(docs, limits):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: x.strip(space).translate(lower)
    for least in (2, 10):
        count = collections.Counter(k for _, t in table for k in {key(x) for x in (t or "").split("\n")})
        want = []
        for i, t in table:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not key(x) or count[key(x)] < least]
            want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
        got = linededup.drop_common_lines(docs.select("doc_id", "text", "lang", "n_lines"), least, **limits)
        assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == collections.Counter(want)


def test_common_lines_of_nothing_and_equal_first_halves(spark, empty):
    assert linededup.drop_common_lines(empty).count() == 0
    counts = spark.createDataFrame([(5, 1, 10), (5, 2, 20), (6, 3, 30)], "h bigint, f bigint, n bigint")
    parts = {r.shard: bytes(r.data) for r in linededup.build_shards(counts, 1).collect()}
    asked = np.array([[5, 1], [5, 2], [6, 3], [6, 4], [9, 9]], np.uint64)
    assert linededup.LineIndex(parts, 1).counts(asked).tolist() == [10, 20, 30, 0, 0]


# 6


def test_word_encoder_equals_the_library():
    coder = tokenbin.WordEncoder(tokenbin.public_tokenizers.path(tokenbin.VOCABULARY))
    rng = random.Random(13)
    alphabet = "abzABZéÉ ́ıİſßΣς'’“…\n\t\r 　.,!?;:<|>endoftext0129²٣日本😀-_/\x00ﬁ"
    texts = [t or "" for _, t, *_ in documents()] + ["<|endoftext|>", "a <|ENDOFTEXT|> b", "it's don'T a'll ,.!w .. İ? ǅ", "word…,"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, coder.type).tolist() == coder.library.encode(text, add_special_tokens=False).ids, text


def test_id_files(spark, docs, empty, monkeypatch):
    table = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] or ""))
    coder = tokenbin.WordEncoder(tokenbin.public_tokenizers.path(tokenbin.VOCABULARY))
    want, start, ids = [], 0, {}
    for i, text in table:
        own = [*coder.library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
        ids[i] = own
    got = tokenbin.id_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    assert tokenbin.id_files(empty).count() == 0
    folder = tokenbin.fresh_dir(spark, "t")
    manifest = tokenbin.cut(tokenbin.write_shards(docs, folder))
    asked = spark.createDataFrame([(3,), (1006,), (77777,), (5,), (None,), (-4,)], "doc_id bigint")
    got = tokenbin.lookup(spark, folder, manifest, asked)
    assert sorted((r.doc_id, r.repeat, r.ids) for r in got.collect()) == [(3, 0, ids[3]), (5, 0, ids[5]), (5, 1, ids[5]), (1006, 0, ids[1006])]
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lookup_of_a_key_that_spans_shards(spark):
    """Rows of one key in several shards are all found."""
    kind = np.dtype("<u2")
    folder = tokenbin.fresh_dir(spark, "t")
    files, root = tokenbin.pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    packs = [([1, 7, 7], [0, 0, 1]), ([7, 7], [2, 3]), ([7, 9], [4, 0])]
    spans = []
    for n, (keys, repeats) in enumerate(packs):
        with files.open_output_stream(f"{root}/ids-000000-{n:05d}.bin") as out:
            out.write(tokenbin.Shard.write(keys, repeats, [np.array([k, r], kind).tobytes() for k, r in zip(keys, repeats)], kind))
        spans.append((f"ids-000000-{n:05d}.bin", keys[0], keys[-1]))
    manifest = spark.createDataFrame(spans, "shard string, first_key bigint, last_key bigint")
    got = tokenbin.lookup(spark, folder, manifest, spark.createDataFrame([(7,), (9,), (8,)], "doc_id bigint")).collect()
    assert sorted((r.doc_id, r.repeat, r.ids) for r in got) == [(7, i, [7, i]) for i in range(5)] + [(9, 0, [9, 0])]


def test_a_wrong_key_with_an_equal_fingerprint_is_not_found():
    kind = np.dtype("<u2")
    shard = tokenbin.Shard(tokenbin.Shard.write([4, 6], [0, 0], [b"\1\0", b"\2\0"], kind))
    shard.fingerprints = np.full(2, (tokenbin._hashed(np.array([5]), np.array([0]))[0] >> np.uint64(32)).astype(np.uint32))
    assert (shard.find(np.array([5]), np.zeros(1, np.uint32))[0] < 0).all()


def test_shard_finds_each_key_and_no_other():
    kind = np.dtype("<u2")
    keys = [None, None, *range(0, 4000, 2)]
    payloads = [np.arange(i % 5 + 1, dtype=kind).tobytes() for i in range(len(keys))]
    shard = tokenbin.Shard(tokenbin.Shard.write(keys, [0, 1] + [0] * 2000, payloads, kind))
    offsets, lengths = shard.find(shard.keys, shard.repeats, shard.nulls)
    assert lengths.tolist() == [len(p) // 2 for p in payloads] and offsets.tolist() == np.cumsum([0, *lengths[:-1]]).tolist()
    assert (shard.find(np.arange(1, 4000, 2), np.zeros(2000, np.uint32))[0] < 0).all()


# 7


def test_rules_counts_match_brute_force(docs, empty):
    text = " ".join(f"a{i}" for i in range(12))
    extra = docs.sparkSession.createDataFrame([(1, f"{text} x {text}\n{text}"), (2, "% # % <a> |\n% # % <a> |\n\n \n%"), (3, "same " * 40), (4, None)], "doc_id bigint, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    for r in quality_rules.measured(frame, carry=["doc_id", "text"]).collect():
        words = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = collections.Counter(windows)
        covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
    judged = quality_rules.judged(frame, carry=["doc_id"])
    assert quality_rules.judged(docs).count() == docs.count()
    assert not judged.filter("kept and base_failed").count() and judged.filter("doc_id = 1000").first().base_failed
    assert quality_rules.judged(empty, carry=["doc_id"]).count() == 0


def test_estimation_finds_good_and_bad_rules():
    rng = np.random.default_rng(17)
    truth = rng.random(20_000) < 0.8
    rules = [(0.95, 0.9), (0.9, 0.8), (0.85, 0.9), (0.6, 0.9)]
    votes = np.stack([np.where(rng.random(len(truth)) < cover, np.where((rng.random(len(truth)) < right) == truth, 1, -1), 0) for right, cover in rules], 1)
    base, weights = quality_rules.estimate(sorted(collections.Counter(map(tuple, votes.tolist())).items()), prior=(0.85, 0.0))
    accuracy = 1 / (1 + np.exp(-weights))
    assert np.abs(accuracy - [r for r, _ in rules]).max() < 0.05
    verdict = base + votes @ weights > 0
    assert (verdict == truth).mean() > 0.93
    assert quality_rules.estimate([])[0] == 0.0


# 8


def test_kernel_ridge(spark, docs, empty):
    rng = random.Random(19)
    table, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(["house", "tree", "river", "stone"]) if good else rng.choice(["AAA!!", "%%", "12"]) for _ in range(rng.randint(5, 60))]
        table.append((i, " ".join(words)))
        labels.append((i, int(good)))
    labels += [(3, 1), (3, 0), (None, 1), (5, None)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("stats", F.lit(1))
    got = {r.doc_id: r for r in quality_model.scored(frame, marks).collect()}
    held = [(got[i].score, y) for i, y in labels[:400] if got[i].held_out]
    assert len(got) == 400 and len(held) > 40 and all((s >= 0.5) == y for s, y in held)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    odd = quality_model.scored(docs, marks).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality_model.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert quality_model.scored(empty, marks).count() == 0


def test_pooling_is_isotonic():
    x, y = quality_model.pooled(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]), np.array([0.1, 0.2, 0.3, 0.4]))
    assert (np.diff(y) >= 0).all() and len(x) == len(y) == 3 and y[1] == pytest.approx(2 / 3)


# 9


def shared_out(sizes, weights, most):
    """Targets in plain Python: the excess of full sources goes to the others by weight, until none is above."""
    full, out = set(), [0.0] * len(sizes)
    while True:
        rest = sum(sizes) - sum(most * sizes[i] for i in full)
        some = [i for i in range(len(sizes)) if i not in full]
        for i in some:
            out[i] = rest * weights[i] / sum(weights[j] for j in some)
        above = {i for i in some if out[i] > most * sizes[i]}
        for i in above:
            out[i] = most * sizes[i]
        full |= above
        if not above:
            return out


def test_targets_stop_at_three_times_the_size(spark):
    assert shared_out([100, 1, 10], [1, 2, 3], 3) == pytest.approx([78, 3, 30])
    for sizes in ([10, 10, 10], [100, 1, 10], [0, 5], [5, 0, 0, 0, 90, 1, 2], [0, 0], [7] * 9):
        rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "__mix_source string, size bigint")
        got = {r["__mix_source"]: (r.source_size, r.target) for r in mixing.source_table(rows, mixing.WEIGHTS, 3.0).collect()}
        want = shared_out(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3)
        assert {s: n for s, (n, _) in got.items()} == {f"s{i}": n for i, n in enumerate(sizes)}
        assert [got[f"s{i}"][1] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(docs, empty):
    got = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 3 for r in got)
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(r.size == words[r.doc_id] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r.size for r in by[s]) for s in names]
    want = shared_out(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    for s, size, target in zip(names, sizes, want, strict=True):
        assert {r.source_size for r in by[s]} == {size} and all(r.target == pytest.approx(target) for r in by[s])
        taken, longest = sum(r.size * r.copies for r in by[s]), max(r.size for r in by[s])
        assert abs(taken - target) <= longest
    again = mixing.mix(docs.repartition(7), carry=["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mix(empty).count() == 0
    plain = docs.drop("size", "target")
    out = mixing.emitted(mixing.mix(plain), plain.columns)
    assert out.count() == sum(r.copies for r in got)


def test_mix_matches_brute_force(spark):
    """Copies row by row: sort, whole copies of long documents, one offset, prefix sums."""
    rng = random.Random(23)
    table = [(i, "w " * rng.choice([0, 3, 20, 40, 41, 300]) + "x", f"s{rng.randrange(5)}") for i in range(700)]
    table += [(700 + i, "long " * 4000, "s1") for i in range(3)] + [(710, "word " * 9000, "s4"), (711, None, "empty"), (712, " ", "empty"), (713, "a b", None), (714, "a b", None)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.mix(frame, carry=["doc_id"]).collect()}
    facts = frame.select("doc_id", F.xxhash64(F.lit(0), "doc_id", "text").alias("turn"), F.xxhash64(F.lit(0), F.coalesce("source", F.lit("\0null"))).alias("draw")).collect()
    turn, draw = {r.doc_id: r.turn for r in facts}, {r.doc_id: (r.draw % (1 << 30)) / (1 << 30) for r in facts}
    by = collections.defaultdict(list)
    for i, text, source in table:
        by[source].append((len(WORD.findall(text or "")), turn[i], i))
    names = sorted(s for s in by if s is not None) + [None]
    sums = [sum(n for n, _, _ in by[s]) for s in names]
    for s, total, target in zip(names, sums, shared_out(sums, [(1, 2, 3)[i % 3] for i in range(len(names))], 3), strict=True):
        own = sorted(by[s])
        longs = [x for x in own if x[0] * 200 > target and x[0] * 2000 > total]
        rate, left, want = target / total if total else 1.0, 0.0, {}
        for n, _, i in sorted(longs, reverse=True):
            asked = left + rate * n
            want[i] = max(0, min(3, int(asked / n + 0.5) if asked > 0 else 0))
            left = asked - want[i] * n
        others = total - sum(n for n, _, _ in longs)
        share = max(0.0, min(3.0, (rate * others + left) / others)) if others else rate
        for k, (_, _, i) in enumerate(x for x in own if x not in longs):
            want[i] = int(draw[i] + (k + 1) * share) - int(draw[i] + k * share)
        assert {i: got[i].copies for i in want} == want, s
        if s not in ("empty", None):
            assert abs(sum(n * want[i] for n, _, i in own) - target) < 0.02 * target


# 10


def wav(n):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(bytes(n))
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00?\x00ab\xff\x00c\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def test_sniffing_corrects_and_carves():
    png = media.store(bytes(64))
    for data, kind in ((png, "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (BMP, "image/bmp"), (wav(8), "audio/wav")):
        assert media.sniff(data, "text/plain") == (kind, [])
        assert media.sniff(data[:-1], "text/plain")[0] == "text/plain"
        inside = b"GIF89a RIFF xx" + data + b"tail" + GIF
        assert media.sniff(inside, "d") == ("d", [(14, len(data), kind), (14 + len(data) + 4, len(GIF), "image/gif")])
    broken = bytearray(png)
    broken[20] ^= 1
    assert media.sniff(bytes(broken), "d") == ("d", []) and media.sniff(None, None) == (None, []) and media.sniff(b"", "a") == ("a", [])


def test_zip_is_carved():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "x" * 50)
    assert media.sniff(b"..." + out.getvalue() + b"..", None)[1] == [(3, len(out.getvalue()), "application/zip")]


def test_stored_samples(spark, docs, empty):
    got = {r.doc_id: r for r in media.read_samples(media.stored_samples(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1003].feature == got[1004].feature and got[1003].media_sha256 == got[1004].media_sha256
    assert got[1000].payload_bytes == 64 and media.read_samples(media.stored_samples(empty)).count() == 0
    frame = spark.createDataFrame([(1, bytearray(GIF), "image/png"), (2, None, None)], "k int, c binary, t string")
    assert [(r.k, r.media_type, r.corrected) for r in media.sniffed(frame, "c", "t", ["k"]).orderBy("k").collect()] == [(1, "image/gif", True), (2, None, False)]
