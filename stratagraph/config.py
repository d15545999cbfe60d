"""Settings of a source tree."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

CONFIG_NAME = ".stratagraph/config.json"


@dataclass(frozen=True)
class Config:
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    max_file_size_bytes: int = 2_000_000
    history_window: int = 500
    history_max_files: int = 50

    @classmethod
    def load(cls, root: str | Path) -> Config:
        """From the tree's file, if there is one. Unknown keys and wrong types are errors."""
        path = Path(root) / CONFIG_NAME
        if not path.exists():
            return cls()
        given = json.loads(path.read_text(encoding="utf-8"))
        known = {f.name for f in fields(cls)}
        if not isinstance(given, dict) or (unknown := set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown)) if isinstance(given, dict) else 'not an object'}")
        for name in ("include_patterns", "exclude_patterns"):
            if name in given:
                if not all(isinstance(x, str) for x in given[name]):
                    raise ValueError(f"{name} must be a list of strings")
                given[name] = tuple(given[name])
        for name in ("max_file_size_bytes", "history_window", "history_max_files"):
            if name in given and (not isinstance(given[name], int) or isinstance(given[name], bool) or given[name] < 1):
                raise ValueError(f"{name} must be a positive number")
        return cls(**given)
