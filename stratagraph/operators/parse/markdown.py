"""Markdown: ATX and setext headings as nested sections, links, fences, inline code and task items.

A subset of CommonMark by lines: reference links, HTML blocks and indented code aren't read.
"""

from __future__ import annotations

import re

from .model import Parsed

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_LINK = re.compile(r"(?<!!)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'(][^)]*)?\)")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?(.*)$")
_TASK = re.compile(r"\b(?:TODO|FIXME)\b")


def parse(path: str, content: str) -> Parsed:
    out = Parsed(path, "markdown")
    lines = content.splitlines()
    sections: list[dict] = []
    links, codes, fences, tasks = [], [], [], []
    fence: dict | None = None
    for number, line in enumerate(lines, 1):
        if fence is not None:
            if re.match(rf" {{0,3}}{re.escape(fence['mark'][0])}{{{len(fence['mark'])},}}[ \t]*$", line):
                fences.append({"language": fence["language"], "start_line": fence["line"], "end_line": number})
                fence = None
            continue
        if found := _FENCE.match(line):
            fence = {"mark": found[1], "language": found[2].strip() or None, "line": number}
            continue
        if found := _ATX.match(line):
            sections.append({"level": len(found[1]), "title": (found[2] or "").strip(), "start": number})
        elif number > 1 and re.match(r" {0,3}(=+|-+)[ \t]*$", line) and lines[number - 2].strip() and not _ATX.match(lines[number - 2]) and not _ITEM.match(lines[number - 2]):
            sections.append({"level": 1 if "=" in line else 2, "title": lines[number - 2].strip(), "start": number - 1})
        links += [{"href": m[2], "text": m[1], "line": number} for m in _LINK.finditer(line)]
        codes += [{"kind": "inline_code", "value": m[2].strip(), "line": number} for m in _CODE.finditer(line) if m[2].strip()]
        if (item := _ITEM.match(line)) and _TASK.search(item[1]):
            tasks.append({"text": item[1].strip(), "line": number})
    if fence is not None:
        fences.append({"language": fence["language"], "start_line": fence["line"], "end_line": len(lines)})
    references = sorted([{"kind": "link", "value": x["href"], "line": x["line"]} for x in links] + codes, key=lambda r: r["line"])
    title = sections[0]["title"] if sections and sections[0]["level"] == 1 else None
    name = path.rsplit("/", 1)[-1]
    document = out.node("MarkdownDocument", name, path, 1 if lines else None, len(lines) or None, "markdown", {"title": title, "links": links, "references": references, "code_blocks": fences, "heading_count": len(sections)})
    open_: list[dict] = []
    used: dict[str, int] = {}
    for i, own in enumerate(sections):
        own["end"] = next((s["start"] - 1 for s in sections[i + 1 :] if s["level"] <= own["level"]), len(lines))
        while open_ and open_[-1]["level"] >= own["level"]:
            open_.pop()
        own["chain"] = [*(open_[-1]["chain"] if open_ else []), own["title"]]
        qualified = f"{path}#{'/'.join(own['chain'])}"
        used[qualified] = used.get(qualified, 0) + 1
        if used[qualified] > 1:
            qualified += f"@{used[qualified]}"
        inner = [r for r in references if _owner(sections, i, r["line"])]
        own["id"] = out.node("MarkdownSection", own["title"], qualified, own["start"], own["end"], "markdown", {"level": own["level"], "references": inner})
        out.edge("CONTAINS", open_[-1]["id"] if open_ else document, own["id"], own["start"], own["end"])
        out.text(own["title"], "\n".join(lines[own["start"] - 1 : own["end"]]), own["id"])
        open_.append(own)
    for task in tasks:
        holder = max((s for s in sections if s["start"] <= task["line"] <= s["end"]), key=lambda s: s["start"], default=None)
        own = out.node("Task", task["text"][:120], f"{path}#task:{task['line']}", task["line"], task["line"], "markdown", {"raw": task["text"]})
        out.edge("CONTAINS", holder["id"] if holder else document, own, task["line"])
    return out


def _owner(sections: list[dict], i: int, line: int) -> bool:
    """Whether section i is the last that starts before the line."""
    return sections[i]["start"] <= line and (i + 1 == len(sections) or line < sections[i + 1]["start"])
