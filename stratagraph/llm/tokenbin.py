"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by their key, so that shards, in the order of their names,
hold documents in ascending order. A shard is one file of bounded size::

    magic "STIDS1\\0\\0", number of documents n, number of ids t, bytes an id (2 or 4), bytes of the hash
    keys           n x int64, ascending (a null key has the smallest value and a flag)
    repeats        n x uint32: how many earlier rows of the shard's run have the same key
    perfect hash   over mixed (key, repeat)
    fingerprints   n x uint32, by slot
    documents      n x uint32, by slot: the document's place in keys and repeats
    offsets        n x uint64, by slot: ids of the shard before the document
    lengths        n x uint32, by slot
    payload        t raw little-endian ids

A lookup hashes the key to its slot, compares the stored fingerprint, then the key itself, which the slot's
document number names, and slices the payload: constant time, no search. Shards are named by partition
and number; a task that runs again writes the same files under its own names and renames them.

Null and empty texts hold the end id only. Null keys come first. Rows with equal keys are ordered by a hash of their
text, and each has its own entry; where one key's rows (or those without one) are many they fill several partitions, in
each of which they are numbered from 0. Keys are
whole numbers (others raise an error when they can't be cast). Very long texts are encoded whole, a batch of Arrow
ending after a few megabytes. Other columns, whatever their names, aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_LOWER, cut, fresh_dir, in_arrow, mix64
from .mphf import PerfectHash

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"STIDS1\0\0"
#: Ids after which a shard is closed.
SHARD_IDS = 4_000_000
MEMO = 300_000
#: Documents whose words are looked up together.
PART = 128
MEMO_CHARS = 64
#: Marks that may follow a word.
MARKS = b".,;:!?"
NULL_KEY = -(2**63)
#: Bytes as the letters that byte-level vocabularies write them with: printable ones as they are, the others
#: in order from U+0100; here a blank stays, as it parts words.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)} | {32: " "}
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """The tokenizers library, with a bounded memo of words.

    The vocabulary's rules never join characters across white space, so that a text's ids are those of its words,
    one after another; nor across the end of a run of letters, so that marks after a word are looked up on their
    own. Lower case is part of the rules, and A-Z are lowered first unless the text may hold a special token's
    string. Unknown words of letters only are encoded together, as one text of words: each word ends with the
    first id that ends words. All others are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library spin
        self.library = Tokenizer.from_file(path)
        # for words of letters alone, given in the vocabulary's letters: the same merges, cut at blanks
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters.model._resize_cache(0)  # each word comes once
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @staticmethod
    def _plain(word: bytes) -> bool:
        """Latin, Greek or Cyrillic letters only, also after the rules' normal form and lower case."""
        text = word.decode()
        return word.isalpha() or text.isalpha() and max(text) < "\u0530" and "\u03a3" not in text and unicodedata.normalize("NFC", text).lower().isalpha()

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Plain words, a few hundred to a text; the ids that end words say where each one ends."""
        texts = []
        for i in range(0, len(words), 400):
            raw = b" ".join(words[i : i + 400])
            if not raw.isascii() or raw.lower() != raw:
                raw = unicodedata.normalize("NFC", raw.decode()).lower().encode()
            texts.append(raw.decode("latin-1").translate(BYTE_LETTERS))
        got = [np.array(x.ids, self.type) for x in self.letters.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, self.type)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.type.itemsize
        if len(stops) != len(words):
            return self._singly(words)
        raw, stops = ids.tobytes(), stops.tolist()
        return {w: raw[i:j] for w, i, j in zip(words, [0, *stops[:-1]], stops, strict=True)} if words else {}

    def _singly(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(x.ids, self.type).tobytes() for w, x in zip(words, got, strict=True)}

    def _learn(self, fresh: set[bytes]) -> list[bytes]:
        """Puts new words into the memo; those that it gives are for this part only."""
        memo, before, plain_word = self.memo, self.before, self._plain
        out: dict[bytes, bytes] = {}
        plain: set[bytes] = set()
        other: set[bytes] = set()
        cut: list[tuple[bytes, bytes, bytes]] = []
        for word in fresh:
            if word in before:
                out[word] = before[word]
                continue
            core = word.rstrip(MARKS)
            if not core or not (core.isalpha() or plain_word(core)):
                other.add(word)
            elif len(core) == len(word):
                plain.add(word)
            else:
                marks = word[len(core) :]
                cut.append((word, core, marks))
                if core not in memo:
                    plain.add(core)
                if marks not in memo:
                    other.add(marks)
        out |= self._letters(list(plain))
        out |= self._singly(list(other))
        for word, core, marks in cut:
            out[word] = (out[core] if core in out else memo[core]) + (out[marks] if marks in out else memo[marks])
        memo.update(out)
        return [w for w in out if len(w) > MEMO_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as raw bytes, without the end id."""
        raw = [t.encode() for t in texts]
        split = [(r if b"<|" in r else r.translate(BYTE_LOWER)).replace(b"\n", b" ").split(b" ") for r in raw]
        if len(self.memo) > MEMO:
            self.memo, self.before = {}, self.memo
        self.memo[b""] = b""
        memo, out = self.memo, []
        for at in range(0, len(split), PART):
            part = split[at : at + PART]
            fresh = set().union(*part).difference(memo)
            long = self._learn(fresh) if fresh else ()
            look = memo.__getitem__
            out += [b"".join(map(look, own)) for own in part]
            for word in long:
                del memo[word]
        return out

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _hashed(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return mix64(mix64(keys.astype(np.int64).view(np.uint64)) + repeats.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Shard:
    """A shard's bytes, and lookups in them."""

    def __init__(self, data: bytes):
        magic, n, total, width, size = struct.unpack_from("<8sQQII", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, self.n = 32, n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.repeats = take("<i8", n), take("<u4", n)
        self.nulls = take("u1", n).astype(bool)
        self.hash = PerfectHash.from_bytes(take("u1", size).tobytes())
        self.fingerprints, self.documents, self.offsets, self.lengths = take("<u4", n), take("<u4", n), take("<u8", n), take("<u4", n)
        self.ids = take(f"<u{width}", total)

    @staticmethod
    def write(keys: list[int | None], repeats: list[int], payloads: list[bytes], kind: np.dtype) -> bytes:
        n = len(keys)
        nulls = np.array([k is None for k in keys], np.uint8)
        numbers = np.array([NULL_KEY if k is None else k for k in keys], "<i8")
        again = np.array(repeats, "<u4")
        hashed = _hashed(numbers, again) ^ nulls.astype(np.uint64)
        made = PerfectHash.build(hashed)
        slots = made.slots(hashed)
        lengths = np.array([len(p) // kind.itemsize for p in payloads], np.int64)
        by_slot = {"prints": np.zeros(n, "<u4"), "documents": np.zeros(n, "<u4"), "offsets": np.zeros(n, "<u8"), "lengths": np.zeros(n, "<u4")}
        by_slot["prints"][slots] = (hashed >> np.uint64(32)).astype(np.uint32)
        by_slot["documents"][slots] = np.arange(n)
        by_slot["offsets"][slots] = np.cumsum(lengths) - lengths
        by_slot["lengths"][slots] = lengths
        index = made.to_bytes()
        head = struct.pack("<8sQQII", MAGIC, n, int(lengths.sum()), kind.itemsize, len(index))
        return b"".join([head, numbers.tobytes(), again.tobytes(), nulls.tobytes(), index, *(by_slot[k].tobytes() for k in ("prints", "documents", "offsets", "lengths")), *payloads])

    def first_repeats(self, keys: np.ndarray) -> np.ndarray:
        """The number with which each key's rows begin in this shard (a key's run may have begun in one before)."""
        start = int(self.nulls.sum())
        at = start + np.searchsorted(self.keys[start:], keys, "left")
        at[at >= self.n] = 0
        return np.where(self.keys[at] == keys, self.repeats[at], 0).astype(np.uint32) if self.n else np.zeros(len(keys), np.uint32)

    def find(self, keys: np.ndarray, repeats: np.ndarray, nulls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length for each key; -1 where the shard hasn't the key."""
        nulls = np.zeros(len(keys), bool) if nulls is None else nulls
        hashed = _hashed(keys, repeats) ^ nulls.astype(np.uint64)
        slots = self.hash.slots(hashed)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == (hashed[known] >> np.uint64(32)).astype(np.uint32)
        document = self.documents[slots[known]]
        known[known] = (self.keys[document] == keys[known]) & (self.repeats[document] == repeats[known]) & (self.nulls[document] == nulls[known])
        offsets, lengths = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        offsets[known], lengths[known] = self.offsets[slots[known]], self.lengths[slots[known]]
        return offsets, lengths


def write_shards(docs: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards; shard (its name), part, number, n_docs, n_ids, first_key, last_key, in the shared folder."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    # rows of one key, or without one, may fill several partitions: they are parted by text, equal ones by their place
    rows = rows.select("*", F.xxhash64("text").alias("turn"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("key").asc_nulls_first(), F.col("turn"), F.col("place")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        coder = encoder(path)
        end = coder.pack([END])
        done, keys, repeats, payloads, size, number = [], [], [], [], 0, 0
        last, run_length = object(), 0

        def close() -> None:
            nonlocal keys, repeats, payloads, size, number
            if not keys:
                return
            name = f"ids-{part:06d}-{number:05d}.bin"
            with files.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                out.write(Shard.write(keys, repeats, payloads, coder.type))
            files.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            done.append((name, part, number, len(keys), size, keys[0], keys[-1]))
            keys, repeats, payloads, size, number = [], [], [], 0, number + 1

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, ids in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                run_length = run_length + 1 if k == last else 0
                last = k
                keys.append(k)
                repeats.append(run_length)
                payloads.append(ids + end)
                size += len(payloads[-1]) // coder.type.itemsize
                if size >= SHARD_IDS:
                    close()
        close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "part", "number", "n_docs", "n_ids", "first_key", "last_key"]
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    return rows.transform(in_arrow, run, "shard string, part int, number int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Adds start: ids of all shards before. First within a part, then over parts, whose number is bounded."""
    from pyspark.sql import Window

    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.withColumn("part_start", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return manifest.withColumn("local", local).join(before, "part").select(*manifest.columns, (F.col("part_start") + F.col("local")).alias("start"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, repeat, start, n_tokens, ids_crc32 of every document, each looked up through the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    name = F.regexp_extract("path", r"(ids-\d+-\d+\.bin)$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                offsets, lengths = shard.find(shard.keys, shard.repeats, shard.nulls)
                if (offsets < 0).any():
                    raise ValueError(f"{name}: a key isn't in the index")
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([name] * shard.n), pa.array(shard.keys, mask=shard.nulls), pa.array(shard.repeats.astype(np.int64)), pa.array(offsets), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", key, "repeat", "offset", "n_tokens", "ids_crc32"])

    rows = files.select(name.alias("shard"), "content").transform(in_arrow, run, f"shard string, {key} bigint, repeat bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    starts = shard_starts(manifest).select("shard", F.col("start").alias("shard_start"))
    return rows.join(starts, "shard").select(key, "repeat", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, repeat, ids of the wanted keys (a repeated key has a row for each of its rows; null keys are never asked for).

    Keys are routed by the first keys of the shards, sorted and broadcast (some 16 bytes a shard), with a binary search:
    no range join, whatever the number of shards. A key that many rows have spans several shards and goes to each of
    them. Routed keys are dealt out by shard in parts of bounded size, so that a shard that is asked for often is read by
    several tasks, and a task opens the shards that it is asked for, and no others.
    """
    spans = manifest.select("shard", "first_key", "last_key").collect()
    spans = sorted((r["first_key"] if r["first_key"] is not None else NULL_KEY, r["last_key"] if r["last_key"] is not None else NULL_KEY, r["shard"]) for r in spans)
    shared = spark.sparkContext.broadcast((np.array([a for a, _, _ in spans], np.int64), np.array([b for _, b, _ in spans], np.int64), [n for _, _, n in spans]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, names = shared.value
        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = np.searchsorted(last, asked, "left"), np.searchsorted(first, asked, "right")
            count = np.maximum(high - low, 0)
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(np.repeat(asked, count))], names=["shard", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, shard = None, None
        for batch in batches:
            names, asked = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if names[a] != name:
                    name = names[a]
                    with files.open_input_stream(f"{root}/{name}") as content:
                        shard = Shard(content.read())
                found, repeats, ids = [], [], []
                rest, again = asked[a:b].astype(np.int64), shard.first_repeats(asked[a:b].astype(np.int64))
                while len(rest):  # repeats of a key follow one another
                    offsets, lengths = shard.find(rest, again)
                    some = offsets >= 0
                    rest, again, offsets, lengths = rest[some], again[some], offsets[some], lengths[some]
                    found += rest.tolist()
                    repeats += again.tolist()
                    ids += [shard.ids[x : x + n].astype(np.int64) for x, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                    again = again + np.uint32(1)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(repeats, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=[key, "repeat", "ids"])

    wanted = keys.select(F.col(key).cast("bigint").alias("key")).filter("key is not null").distinct()
    routed = wanted.transform(in_arrow, route, "shard string, key bigint")
    routed = routed.repartition(F.col("shard"), F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("shard", "key")
    return routed.transform(in_arrow, run, f"{key} bigint, repeat bigint, ids array<bigint>")


def id_files(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards, reads them back: key, start, n_tokens, ids_crc32 a row."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "ids")
    manifest = cut(write_shards(docs, folder, path, key, text))
    if manifest.isEmpty():
        return manifest.select(F.col("first_key").alias(key), F.lit(0).cast("bigint").alias("repeat"), F.col("n_ids").alias("start"), F.col("n_ids").alias("n_tokens"), F.col("n_ids").alias("ids_crc32"))
    return read_shards(spark, folder, manifest, key)
