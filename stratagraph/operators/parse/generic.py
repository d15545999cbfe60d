"""Every file: its folders, itself and its text (not of structured files, whose values may be secret)."""

from __future__ import annotations

import posixpath

from .model import Parsed

UNSEARCHED = (".json", ".toml", ".yaml", ".yml", ".env")


def parse(path: str, content: str) -> Parsed:
    out = Parsed(path, "generic")
    parts, parent = path.split("/"), None
    for i in range(1, len(parts)):
        folder = "/".join(parts[:i])
        own = out.node("Directory", parts[i - 1], folder, path=folder)
        if parent is not None:
            out.edge("CONTAINS", parent, own)
        parent = own
    lines = content.count("\n") + (not content.endswith("\n") if content else 0)
    file = out.node("File", parts[-1], path, 1 if content else None, lines or None)
    if parent is not None:
        out.edge("CONTAINS", parent, file)
    name = posixpath.basename(path).lower()
    if not path.lower().endswith(UNSEARCHED) and not name.startswith((".env", "dockerfile")):
        out.text(parts[-1], content, file)
    return out
