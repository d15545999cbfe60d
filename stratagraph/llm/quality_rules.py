"""Quality rules by weak supervision, with built-in functions only.

Counts of the whole text feed rules that vote for a good document (1), against it (-1) or abstain (0).
Votes are counted by pattern (at most 3 to the number of rules, whatever the input's size); on that small
table expectation-maximisation estimates each rule's accuracy, the share of its votes that agree with the
hidden label, and the share of good documents. A document's posterior follows from its votes alone as a
weighted sum. It is kept if the posterior is at least one half and it doesn't fail the base rules.

Words are runs of characters other than ASCII white space. n_repeat_words counts words in windows of
WINDOW words that are found twice or more in the text, the first included; windows are compared by 64-bit
hashes within one text. Null texts have no words and fail; so do texts of fewer than 20 words. Repeated
rows get equal verdicts and count as so many votes. A posterior of just one half keeps the document. Very long texts are
counted whole; their windows' hashes are sorted within the row. Columns of the names in OWN are replaced, those that begin
with __rule_ must not be there, others are kept. On an empty table there are no patterns and no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

SYMBOLS = "#*$%&|<>"
OTHERS = SYMBOLS + ".,;:!?-'\"()[]{}/\\@_=+~^`"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Columns that judged() makes; columns of these names aren't carried.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")
#: Prior votes: an accuracy starts at, and is drawn to, PRIOR[0] with the weight of PRIOR[1] of all votes.
PRIOR = (0.95, 0.25)
START_GOOD = 0.8
ROUNDS = 200


def let(value: Column, body) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the hashes in the text's order."""

    def covered(rows: Column) -> Column:
        again = F.filter(rows, lambda e, k: F.coalesce(F.get(rows, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(rows, k + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda e: e["i"])), total)

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(rows, covered))


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns and the counts that base rules and votes need."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in OWN]
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*carry, value.alias("__rule_text"))
    words = F.array_remove(F.split(F.translate("__rule_text", SPACE[1:], " " * (len(SPACE) - 1)), " "), "")
    lines = F.filter(F.split("__rule_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select(*carry, "__rule_text", words.alias("__rule_words"), lines.alias("__rule_lines"))
    n = F.size("__rule_words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__rule_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def count(chars: str) -> Column:
        return (F.length("__rule_text") - F.length(F.translate("__rule_text", chars, ""))).cast("bigint")

    rows = rows.select(
        *carry,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("__rule_words", "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("__rule_lines") - F.size(F.array_distinct("__rule_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("__rule_lines").cast("bigint").alias("__rule_n_lines"),
        F.size(F.array_distinct("__rule_words")).cast("bigint").alias("__rule_distinct"),
        count("!?").alias("__rule_marks"),
        count(OTHERS).alias("__rule_others"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__rule_upper"),
        hashes.alias("__rule_hashes"),
    )
    return rows.withColumn("n_repeat_words", repeated_words(F.col("__rule_hashes"))).drop("__rule_hashes")


def rules() -> dict[str, Column]:
    """Votes. Thresholds are shares of the whole text's words, lines or characters; variety is distinct words by the root of all."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "__rule_n_lines"))

    def vote(against: Column, good: Column | None = None) -> Column:
        out = F.when(against, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0)

    symbols, marks = F.col("n_symbols") / n, F.col("__rule_marks") / n
    upper, others = F.col("__rule_upper") / chars, F.col("__rule_others") / chars
    repeats, dups, distinct = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("__rule_distinct") / F.sqrt(n)
    return {
        "symbols": vote(symbols > 0.1),
        "letters": vote(others > 0.15),
        "marks": vote(marks > 0.15),
        "upper": vote(upper > 0.25),
        "repeats": vote(repeats > 0.3),
        "variety": vote(distinct < 2),
        "lines": vote(dups > 0.4),
        "length": vote(F.col("n_words") < MIN_WORDS),
        "word_length": vote((chars / n < 2.5) | (chars / n > 14)),
        "surface": vote(
            (symbols > 0.06) | (marks > 0.1) | (upper > 0.2) | (others > 0.12) | (repeats > 0.3) | (distinct < 2),
            (symbols <= 0.02) & (marks <= 0.03) & (upper <= 0.12) & (others <= 0.1) & (repeats <= 0.25) & (distinct >= 3) & (F.col("n_words") >= MIN_WORDS),
        ),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], prior: tuple[float, float] = PRIOR) -> tuple[float, np.ndarray]:
    """Log odds of a good document and of each rule's accuracy, by expectation-maximisation over vote patterns."""
    size = len(patterns[0][0]) if patterns else 0
    if not patterns:
        return 0.0, np.zeros(0)
    votes = np.array([p for p, _ in patterns], float)
    count = np.array([n for _, n in patterns], float)
    cast = (count[:, None] * (votes != 0)).sum(0)
    accuracy, good = np.full(size, prior[0]), START_GOOD
    for _ in range(ROUNDS):
        odds = np.log(good / (1 - good)) + votes @ np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        right = (count[:, None] * ((votes > 0) * post[:, None] + (votes < 0) * (1 - post[:, None]))).sum(0)
        weight = prior[1] * cast + 1
        fresh = np.clip((right + prior[0] * weight) / (cast + weight), 0.55, 0.99)
        good = float(np.clip((count * post).sum() / count.sum(), 0.05, 0.95))
        if np.abs(fresh - accuracy).max() < 1e-9:
            break
        accuracy = fresh
    return float(np.log(good / (1 - good))), np.log(accuracy / (1 - accuracy))


def judged(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, the counts, base_failed, posterior, kept.

    The counts are cut, as votes are read from them twice; carry few columns where texts are large.
    """
    rows = cut(measured(docs, text, carry))
    own = rules()
    found = rows.select(*[v.alias(k) for k, v in own.items()]).groupBy(*own).count().collect()
    order = sorted(((tuple(r[k] for k in own), r["count"]) for r in found), reverse=True)
    base, weights = estimate(order)
    odds = F.lit(base)
    for (_, vote), weight in zip(own.items(), weights.tolist(), strict=False):
        odds = odds + vote * F.lit(round(weight, 9))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    return rows.drop("__rule_n_lines", "__rule_distinct", "__rule_marks", "__rule_others", "__rule_upper")
