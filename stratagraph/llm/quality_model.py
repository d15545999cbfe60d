"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (sizes, shares of character classes, variety, repetition, shape of lines) are
standardised over the training rows. FEATURES cosines with frequencies drawn from a normal distribution
approximate a Gaussian kernel of width BANDWIDTH. Each partition sums its part of the normal equations;
the parts are whole numbers (fixed point), so that sums don't depend on their order, and meet in one
aggregation of FEATURES squared rows, however large the input is. Raw scores of training rows are counted
in BINS bins, and pooling adjacent violators over the bins gives the calibration, a rising line.

Training rows are rows with a label that isn't null; a row with several different labels counts once for
each; repeated labels count once. Null and empty texts have statistics 0 and get a score like others. Without
any label every score is 0.5. Rows with a null id are scored, held_out false. Repeated rows get equal scores (and, if
labelled, count as often as they are there). Very long texts are measured whole. Equal raw scores have equal calibrated
ones. Columns but key, text and label, whatever their names, aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, in_arrow

FEATURES, BANDWIDTH, RIDGE = 128, 3.0, 1e-3
BINS, LOW, HIGH = 2000, -1.0, 2.0
SCALE = float(1 << 24)
_CLASS = np.zeros(256, np.uint8)  # of bytes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 stop, 7 other ASCII sign, 8 blank, 9 line feed, 10 beyond ASCII
for _chars, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#*$%&|<>", 4), (b"!?", 5), (b".,;:", 6), (b"\"'()-/@[\\]^_`{}~=+", 7), (b" \t\x0b\x0c\r", 8), (b"\n", 9), (range(128, 256), 10)):
    _CLASS[list(_chars)] = _kind
STATISTICS = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "stop", "sign", "wide", "variety", "echo", "again", "runs", "log_line", "dup_lines", "alone", "capital")


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of a text; all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11)
    chars = max(1, int(kinds[:8].sum() + kinds[10]))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    echo = float((hashed[1:] == hashed[:-1]).mean()) if n > 1 else 0.0
    spans = hashed[:-3] * np.uint64(3) + hashed[1:-2] * np.uint64(5) + hashed[2:-1] * np.uint64(7) + hashed[3:] * np.uint64(11) if n > 3 else hashed[:0]
    again = 1 - len(np.unique(spans)) / len(spans) if len(spans) else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    capital = sum(65 <= w[0] <= 90 for w in words) / n
    return np.array([
        np.log(n), min(float(lengths.mean()), 30.0), kinds[1] / chars, kinds[3] / chars, min(kinds[4] / n, 4.0), min(kinds[5] / n, 4.0), kinds[6] / n if kinds[6] < 4 * n else 4.0,
        kinds[7] / chars, kinds[10] / chars, min(len(np.unique(hashed)) / n**0.5, 40.0), echo, again, float((lengths == 1).mean()),
        np.log(n / len(lines)), 1 - len(set(lines)) / len(lines), float((lengths > 20).mean()), capital,
    ])


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, stats array<double>: one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            flat = pa.array(rows.reshape(-1), pa.float64())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["key", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).transform(in_arrow, run, f"key {kind}, stats array<double>")


class KernelModel:
    """Standardisation, Fourier features, weights and calibration; a few hundred numbers."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draws = np.random.default_rng(7)
        self.mean, self.spread = mean, spread
        self.turn = draws.normal(0, 1 / BANDWIDTH, (len(mean), FEATURES - 1))
        self.phase = draws.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights = np.zeros(FEATURES)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.turn + self.phase) * (2 / (FEATURES - 1)) ** 0.5
        return np.hstack([np.ones((len(stats), 1)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def _stats(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def pooled(count: np.ndarray, total: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of bins by pooling adjacent violators: the pools' centres and means."""
    pools: list[list[float]] = []  # count, total, weighted centre
    for n, t, c in zip(count.tolist(), total.tolist(), centre.tolist(), strict=True):
        pools.append([n, t, n * c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([c / n for n, _, c in pools]), np.array([t / n for n, t, _ in pools])


def fit(rows: DataFrame) -> KernelModel | None:
    """rows: stats, y (0 or 1). Read three times; cut them before if they are dear."""
    spread = [F.struct(F.avg(F.get("stats", i)).alias("m"), F.stddev_pop(F.get("stats", i)).alias("s")).alias(f"c{i}") for i in range(len(STATISTICS))]
    first = rows.agg(F.count("*").alias("n"), *spread).first()
    if not first["n"]:
        return None
    model = KernelModel(np.array([round(first[f"c{i}"]["m"], 6) for i in range(len(STATISTICS))]), np.array([max(round(first[f"c{i}"]["s"], 6), 1e-3) for i in range(len(STATISTICS))]))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)
    upper = np.triu_indices(FEATURES)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, some = np.zeros((FEATURES, FEATURES)), np.zeros(FEATURES), False
        for batch in batches:
            x, y = shared.value.features(_stats(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            left += x.T @ x
            right += x.T @ y
            some |= bool(len(y))
        if some:
            values = np.round(np.concatenate([left[upper], right]) * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    sums = rows.select("stats", "y").transform(in_arrow, equations, "place int, value bigint").groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy(float) / SCALE
    left = np.zeros((FEATURES, FEATURES))
    left[upper] = sums[: len(upper[0])]
    left = left + np.triu(left, 1).T
    n = first["n"]
    model.weights = np.linalg.solve(left + RIDGE * n * np.diag([1e-6] + [1.0] * (FEATURES - 1)), sums[len(upper[0]) :])
    fitted = context.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            at = np.minimum(((fitted.value.raw(_stats(batch.column(0))) - LOW) / (HIGH - LOW) * BINS).astype(int), BINS - 1)
            count += np.bincount(at, minlength=BINS)
            total += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False).astype(float), minlength=BINS).astype(np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used])], names=["bin", "n", "t"])

    bins = rows.select("stats", "y").transform(in_arrow, binned, "bin int, n bigint, t bigint").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas().sort_values("bin")
    centre = LOW + (bins["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.values = pooled(bins["n"].to_numpy(float), bins["t"].to_numpy(float), centre)
    return model


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted. Learns from rows that aren't held out."""
    stats = cut(measured(docs, key, text))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)")
    known = known.filter(crc_mod("key", modulus) != held).distinct()
    train = cut(stats.join(known, "key").select("stats", "y"))
    model = fit(train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(_stats(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["key", "score"])

    kind = stats.schema["key"].dataType.simpleString()
    out = stats.transform(in_arrow, run, f"key {kind}, score double")
    held_out = F.coalesce(crc_mod("key", modulus) == held, F.lit(False))
    return out.select(F.col("key").alias(key), held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
