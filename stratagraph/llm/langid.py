"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter a language, stored by position: each position holds a mask with one bit a language, so
that a look-up of an n-gram (the AND of the masks at its hash positions) returns all languages that
contain it at once. A text's n-grams are looked up in one vectorised pass; for each language the
popcount of its bit is corrected for false positives, (hits - n * p) / (1 - p), with p the share of set
positions to the power of hashes. Languages' corrected shares, less what the best other language shares,
decide; ties go to the smallest name.

Fitting takes a bounded sample of labelled rows: PER_LANGUAGE documents a language, those with the smallest
hashes of id and text. An n-gram enters a language's filter if it is found in at least MIN_DOCS of its
sample and at a rate that is a fair share of its rate over all languages (RATE), so that stray passages
of another language don't count. No n-gram is left out: the filters' size is the power of two that holds those of the
language with the most at about 2.6 % false positives, between LEAST and MOST positions; beyond MOST false positives
grow, for which the popcounts are corrected. Only the filters are broadcast. They are filled from n-grams that
stream to the driver, a partition at a time.

Null texts and texts without a letter are "und" with score 0; so are all texts if nothing was learned, and
texts whose letters' n-grams are in no language get the smallest language name with score 0. Ties go to the smallest
name. Very long texts are looked up whole, CHUNK characters of a batch's texts (or one text) at a time. Repeated rows get
equal predictions; in the sample they count as so many rows. Empty tables give no rows. Rows with a null id are
predicted like others, held_out false. Columns named lang_pred, score, share and held_out are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, in_arrow, mix64

SIZES = (3, 4)
PER_LANGUAGE = 1500
MIN_DOCS = 3
RATE = 0.5
#: Positions of a filter at least and at most, and for each of its n-grams.
LEAST, MOST, EACH = 1 << 20, 1 << 26, 8.7
HASHES = 3
UNDETERMINED = "und"
#: Characters whose n-grams are in memory at once (a longer text alone).
CHUNK = 200_000


def chunks(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about CHUNK characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within words of the texts, and how many each text has."""
    codes, counts = [], []
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32) for t in texts]
    for own in points:
        letters = own.astype(np.uint64)
        letters[(own < 65) | ((own > 90) & (own < 97)) | ((own > 122) & (own < 192))] = 32
        total = 0
        for size in SIZES:
            if len(letters) < size:
                continue
            gram = np.zeros(len(letters) - size + 1, np.uint64)
            for i in range(size):
                gram |= letters[i : len(letters) - size + 1 + i] << np.uint64(16 * i)
            inner = np.ones(len(gram), bool)  # no blank but at the ends, and not both ends alone
            for i in range(1, size - 1):
                inner &= letters[i : len(letters) - size + 1 + i] != 32
            gram = gram[inner]
            codes.append(gram + np.uint64(size))
            total += len(gram)
        counts.append(total)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    return mix64(flat), np.array(counts, np.int64)


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # (positions, bytes): a bit a language
    false_rate: np.ndarray

    @staticmethod
    def size(grams: int) -> int:
        """Positions for so many n-grams of the language with the most."""
        return int(min(MOST, max(LEAST, 1 << int(np.ceil(np.log2(max(1.0, grams * EACH)))))))

    def positions(self, hashes: np.ndarray) -> list[np.ndarray]:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return [((low + np.uint64(i) * high) & np.uint64(len(self.masks) - 1)).astype(np.int64) for i in range(HASHES)]

    @classmethod
    def empty(cls, languages: list[str], positions: int = LEAST) -> LanguageFilter:
        return cls(languages, np.zeros((positions, max(1, -(-len(languages) // 8))), np.uint8), np.zeros(len(languages)))

    def add(self, language: int, grams: np.ndarray) -> None:
        for at in self.positions(grams):
            self.masks[at, language // 8] |= np.uint8(1 << language % 8)

    def filled(self) -> LanguageFilter:
        """Self, with false positive rates by how full each language's bits are."""
        full = [np.count_nonzero(self.masks[:, i // 8] & np.uint8(1 << i % 8)) / len(self.masks) for i in range(len(self.languages))]
        self.false_rate = np.array(full) ** HASHES
        return self

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilter:
        made = cls.empty(sorted(grams), cls.size(max(map(len, grams.values()), default=0)))
        for i, name in enumerate(made.languages):
            made.add(i, grams[name])
        return made.filled()

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of each text's n-grams in each language."""
        hashes, counts = gram_hashes(texts)
        at = self.positions(hashes)
        starts = np.cumsum(counts) - counts
        out = np.zeros((len(texts), len(self.languages)))
        some = counts > 0
        for word in range(self.masks.shape[1]):
            column = np.ascontiguousarray(self.masks[:, word])
            found = column[at[0]]
            for more in at[1:]:
                found &= column[more]
            for i in range(word * 8, min(len(self.languages), word * 8 + 8)):
                bit = (found >> np.uint8(i % 8)) & np.uint8(1)
                sums = np.add.reduceat(bit, starts[some], dtype=np.int64) if some.any() else np.zeros(0, np.int64)
                rate = self.false_rate[i]
                out[some, i] = np.clip((sums - counts[some] * rate) / (counts[some] * (1 - rate)), 0, 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (0 to 1: its part of the shares of the two best) and its corrected share."""
        plain = [t or "" for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        shares = np.concatenate([self.shares(plain[part]) for part in chunks(plain)]) if plain else np.zeros((0, len(self.languages)))
        best = shares.argmax(1)
        top = np.sort(shares, axis=1)[:, ::-1]
        second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(top))
        names, scores, own = [], [], []
        for t, b, x, y in zip(plain, best.tolist(), top[:, 0].tolist(), second.tolist(), strict=True):
            if any(map(str.isalpha, t)):
                names.append(self.languages[b])
                scores.append(x / (x + y) if x > 0 else 0.0)
                own.append(x)
            else:
                names.append(UNDETERMINED)
                scores.append(0.0)
                own.append(0.0)
        return names, scores, own


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageFilter:
    """Learns from labelled rows: a bounded sample, document counts of n-grams by language, then filters."""
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return LanguageFilter.empty([])
    # about half as many again by a share of the hashes, then the smallest exactly
    keep = F.lit(False)
    turn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    for name, total in totals.items():
        keep = keep | ((F.col("lang") == name) & (turn <= int(min(1.0, 1.5 * per_language / total + 30 / total) * (1 << 30))))
    some = rows.filter(keep).withColumn("turn", turn)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "key"))).filter(F.col("rank") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: dict[str, list[np.ndarray]] = {}
            for part in chunks(texts):
                hashes, counts = gram_hashes(texts[part])
                for name, own in zip(names[part], np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
                    held.setdefault(name, []).append(np.unique(own))
            for name, parts in held.items():
                grams, docs = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(docs, pa.int64())], names=["lang", "gram", "docs"])

    sizes = {n: min(t, per_language) for n, t in totals.items()}
    counts = some.select("text", "lang").transform(in_arrow, run, "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    of = F.create_map(*[x for n, s in sizes.items() for x in (F.lit(n), F.lit(float(s)))])
    counts = counts.withColumn("rate", F.col("docs") / of[F.col("lang")])
    highest = counts.groupBy("gram").agg(F.max("rate").alias("highest"))
    need = F.least(F.lit(MIN_DOCS), F.greatest(F.lit(1), F.floor(of[F.col("lang")] / 10)))
    counts = counts.join(highest, "gram").filter((F.col("docs") >= need) & (F.col("rate") >= RATE * F.col("highest")))
    counts = cut(counts.select("lang", "gram"))
    most = counts.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 0
    made = LanguageFilter.empty(sorted(totals), LanguageFilter.size(most))
    number = F.create_map(*[x for i, n in enumerate(made.languages) for x in (F.lit(n), F.lit(i))])
    packed = counts.select(number[F.col("lang")].alias("lang"), "gram").transform(in_arrow, _packed, "lang int, grams binary")
    for r in packed.toLocalIterator():
        made.add(r["lang"], np.frombuffer(r["grams"], np.uint64))
    return made.filled()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw n-grams by language, a few thousand in a row."""
    for batch in batches:
        languages, grams = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        own = np.unique(languages)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([grams[languages == i].astype(np.int64).tobytes() for i in own], pa.binary())], names=["lang", "grams"])


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, lang_pred, score, share (replacing columns of these names)."""
    own = ("lang_pred", "score", "share")
    carry = [c for c in (carry or docs.columns) if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = shared.value.predict(batch.column(0).to_pylist())
            columns = [*(batch.column(i + 1) for i in range(len(carry))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *own])

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(text).cast("string").alias("__lang_text"), *carry).transform(in_arrow, run, f"{head}, lang_pred string, score double, share double")


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, carry: list[str] | None = None) -> DataFrame:
    """Fits on rows whose id's crc32 isn't ``held`` modulo ``modulus``, then predicts all rows; adds held_out."""
    out_of = F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False))
    model = fit(docs.filter(~out_of))
    carry = [c for c in (carry or docs.columns)]
    return predict(docs, model, carry=carry).withColumn("held_out", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)))
