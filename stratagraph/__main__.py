"""Command line: python -m stratagraph COMMAND ... ; answers are JSON."""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratagraph")
    out.add_argument("--root", default=".")
    out.add_argument("--store")
    out.add_argument("--no-auto-index", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        command = commands.add_parser(name)
        for names, options in arguments:
            command.add_argument(*names, **options)

    limit = (("--limit",), {"type": int, "default": 20})
    depth = (("--depth",), {"type": int, "default": 2})
    tokens = (("--budget",), {"type": int, "default": 10_000})
    way = (("--direction",), {"choices": ("in", "out", "both"), "default": "both"})
    add("index", (("--full",), {"action": "store_true"}))
    for name in ("status", "freshness", "overview", "report", "verify-memory"):
        add(name)
    add("search", (("query",), {}), (("--type",), {"action": "append"}), limit)
    add("find-symbol", (("name",), {}), (("--exact",), {"action": "store_true"}), limit)
    add("explain-file", (("path",), {}))
    add("trace-config", (("name",), {}))
    add("trace-symbol", (("name",), {}), depth, way, tokens)
    add("trace-data-flow", (("name",), {}), depth, way, tokens)
    add("impact", (("target",), {}), depth, tokens)
    add("co-change", (("path",), {}), limit)
    add("churn", limit)
    add("ownership", (("--path",), {}), limit)
    add("docs-for-code", (("target",), {}), limit)
    add("code-for-docs", (("path",), {}), (("--heading",), {}), limit)
    add("change-context", (("--base",), {}), tokens)
    add("brief", (("--budget",), {"type": int, "default": 2000}))
    add("read-memory", (("--topic",), {}), limit)
    add("write-memory", (("summary",), {}), *[((f"--{k}",), {"action": "append", "default": []}) for k in ("decisions", "assumptions", "open_questions", "changed_files", "next_steps")])
    return out


def run(engine, a: argparse.Namespace):
    """The answer of a command. All but index, status, freshness and memory writing need fresh facts."""
    if a.command == "index":
        return engine.index(incremental=not a.full)
    if a.command in ("status", "freshness"):
        return getattr(engine, a.command)()
    if a.command == "write-memory":
        return engine.write_memory(a.summary, **{k: getattr(a, k) for k in ("decisions", "assumptions", "open_questions", "changed_files", "next_steps")})
    engine.require_fresh()
    return {
        "overview": lambda: engine.overview(), "report": lambda: engine.report(), "verify-memory": lambda: engine.verify_memory(),
        "search": lambda: engine.search(a.query, a.limit, a.type), "find-symbol": lambda: engine.find_symbol(a.name, a.exact, a.limit),
        "explain-file": lambda: engine.explain_file(a.path), "trace-config": lambda: engine.trace_config(a.name),
        "trace-symbol": lambda: engine.trace_symbol(a.name, a.depth, a.direction, a.budget), "trace-data-flow": lambda: engine.trace_data_flow(a.name, a.depth, a.direction, a.budget),
        "impact": lambda: engine.impact(a.target, a.depth, a.budget), "co-change": lambda: engine.co_change(a.path, a.limit), "churn": lambda: engine.churn(a.limit),
        "ownership": lambda: engine.ownership(a.path, a.limit), "docs-for-code": lambda: engine.docs_for_code(a.target, a.limit), "code-for-docs": lambda: engine.code_for_docs(a.path, a.heading, a.limit),
        "change-context": lambda: engine.change_context(a.base, a.budget), "brief": lambda: engine.brief(a.budget), "read-memory": lambda: engine.read_memory(a.topic, a.limit),
    }[a.command]()


def main() -> int:
    a = _parser().parse_args()
    from pyspark.sql import SparkSession

    from .engine import Engine, StaleError

    spark = SparkSession.builder.appName("stratagraph").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    try:
        answer = run(Engine(spark, a.root, a.store, auto_index=not a.no_auto_index), a)
    except StaleError as error:
        print(json.dumps(error.result, default=str, indent=1))
        return 2
    print(answer if isinstance(answer, str) else json.dumps(answer, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
