"""Fitting answers into a token budget; a token is four characters of JSON or text, rounded up."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The order in which answers shorten their lists, and the steps by which a change context is shortened.
TRIM_ORDER = ("docs_likely_needing_updates", "recommended_tests", "low_confidence", "medium_confidence", "high_confidence", "edges", "nodes")
LADDER = (
    "historical_evidence", "docs_likely_needing_updates", "low_confidence", "medium_confidence", "changes.symbols", "changes.file_node",
    "changes.line_ranges", "high_confidence", "recommended_tests", "changes",
)
MINIMUM = 64
#: Characters that a row of an answer has at least as JSON.
ROW_CHARS = 60


def tokens(value: object) -> int:
    return (len(value if isinstance(value, str) else json.dumps(value)) + 3) // 4


def _lists(result: dict, order: tuple[str, ...]):
    for label in order:
        for holder in (result, *(v for v in result.values() if isinstance(v, dict))):
            if isinstance(holder.get(label), list):
                yield label, holder[label]
                break


def fit(result: dict, budget: int, order: tuple[str, ...] = TRIM_ORDER, left: dict[str, int] | None = None) -> dict:
    """Drops from the tails of lists, the least wanted list first, until the JSON fits; says what was dropped.

    left: rows by list that were cut before.

    A list's excess is found by bisection on its kept length, as a longer list never has shorter JSON.
    """
    dropped: dict[str, int] = {}
    result |= {"budget": budget, "token_heuristic": "ceil(characters / 4)", "truncation": {"applied": False, "budget": budget, "within_budget": True, "dropped": dropped}}
    for label, items in list(_lists(result, order)):
        if len(json.dumps(result)) <= 4 * budget:
            break
        whole = list(items)
        low, high = 0, len(whole)  # the longest prefix that fits, 0 if none does
        while low < high:
            middle = (low + high + 1) // 2
            items[:] = whole[:middle]
            dropped[label] = len(whole) - middle
            if not dropped[label]:
                del dropped[label]
            low, high = (middle, high) if len(json.dumps(result)) <= 4 * budget else (low, middle - 1)
        items[:] = whole[:low]
        if len(whole) > low:
            dropped[label] = len(whole) - low
    for label, n in (left or {}).items():
        if n:
            dropped[label] = dropped.get(label, 0) + n
    result["truncation"]["applied"] = bool(dropped)
    result["token_estimate"] = tokens(result)
    result["truncation"]["within_budget"] = result["token_estimate"] <= budget
    return result


def room(budget: int) -> int:
    """Rows of an answer that can fit into a budget at most; more needn't leave the executors."""
    return 4 * budget // ROW_CHARS + 1


def rungs(rows: DataFrame, partition: list[str], order: list, step: str, size: str, budget: int) -> DataFrame:
    """Rows that a ladder keeps: those of the last steps first, within a step from the front, while their sizes fit.

    step: 0 for what goes first. The row form of ladder(), for answers whose lists are too long to collect.
    """
    total = F.sum(size).over(Window.partitionBy(*partition).orderBy(F.desc(step), *order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).filter(F.col("used") <= 4 * budget)


def ladder(result: dict, budget: int, steps: tuple[str, ...] = LADDER) -> dict:
    """fit() in steps: a name is a list that loses its tail; ``changes.x`` takes x from the records of changes, the last first.

    A record stays when its details go, so that what changed is the last to be lost.
    """
    dropped: dict[str, int] = {}
    result |= {"budget": budget, "token_heuristic": "ceil(characters / 4)", "truncation": {"applied": False, "budget": budget, "within_budget": True, "dropped": dropped}}
    for label in steps:
        if len(json.dumps(result)) <= 4 * budget:
            break
        parent, _, field = label.partition(".")
        items = next((x for _, x in _lists(result, (parent,))), [])
        whole = [x.get(field) for x in items] if field else list(items)
        places = [i for i, x in enumerate(whole) if x] if field else range(len(whole))

        def keep(n: int, items=items, whole=whole, places=places, field=field, label=label) -> bool:
            if field:
                for k, i in enumerate(places):
                    items[i][field] = whole[i] if k < n else [] if isinstance(whole[i], list) else None
            else:
                items[:] = whole[:n]
            dropped.pop(label, None)
            if n < len(places):
                dropped[label] = len(places) - n
            return len(json.dumps(result)) <= 4 * budget

        low, high = 0, len(places)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if keep(middle) else (low, middle - 1)
        keep(low)
    result["truncation"]["applied"] = bool(dropped)
    result["token_estimate"] = tokens(result)
    result["truncation"]["within_budget"] = result["token_estimate"] <= budget
    return result


def prefix(rows: DataFrame, partition: list[str], order: list, size: str, budget: int, overhead: int = 0) -> DataFrame:
    """Rows whose running size, in order, stays within four times the budget less the overhead."""
    total = F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).filter(F.col("used") + overhead <= 4 * budget)


def select_facts(sections: list[tuple[str, list[str]]], budget: int, header: str = "Project brief") -> dict:
    """Whole facts in section order; one that doesn't fit is passed over, later smaller ones may still fit.

    If facts were passed over, a second pass keeps room for the longest report of omissions there could be.
    """
    if budget < MINIMUM:
        raise ValueError(f"budget must be at least {MINIMUM} tokens")

    def footer(counts: dict[str, int]) -> str:
        return f"\nTruncated to fit {budget} tokens\n" + "".join(f"- {t}: {n} fact(s) not shown\n" for t, n in sorted(counts.items()))

    def choose(room: int) -> tuple[list[tuple[str, list[str]]], dict[str, int]]:
        used, shown, left = len(header) + 1, [], {}
        for title, facts in sections:
            kept: list[str] = []
            for fact in facts:
                cost = len(fact) + 3 + (0 if kept else len(title) + 2)
                if used + cost <= room:
                    kept.append(fact)
                    used += cost
            if len(kept) < len(facts):
                left[title] = len(facts) - len(kept)
            if kept:
                shown.append((title, kept))
        return shown, left

    shown, left = choose(4 * budget)
    if left:
        shown, left = choose(4 * budget - len(footer({t: len(f) for t, f in sections if f})))
    text = header + "\n" + "".join(f"\n{t}\n" + "".join(f"- {x}\n" for x in facts) for t, facts in shown) + (footer(left) if left else "")
    return {"sections": shown, "dropped": left, "text": text, "token_estimate": tokens(text), "within_budget": tokens(text) <= budget}
