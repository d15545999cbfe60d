"""Paths: ancestors, normal form, test files, languages, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file name ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".php": "php", ".sh": "bash", ".bash": "bash",
    ".go": "go", ".java": "java", ".rb": "ruby", ".md": "markdown", ".markdown": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".html": "html", ".css": "css", ".sql": "sql", ".txt": "text", ".env": "dotenv", ".ini": "ini",
}


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def joined(base: Column, reference: Column) -> Column:
    """A relative reference from a file's folder, with . and .. taken away; null where it leaves the root."""
    folder = F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1)
    whole = F.when(reference.startswith("/"), F.split(F.ltrim(reference, F.lit("/")), "/")).otherwise(F.concat(folder, F.split(reference, "/")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(a: Column, x: Column) -> Column:
        up = F.struct(F.slice(a["parts"], 1, F.greatest(F.size(a["parts"]) - 1, F.lit(0))).alias("parts"), (a["out"] | (F.size(a["parts"]) == 0)).alias("out"))
        stay = F.struct(a["parts"].alias("parts"), a["out"].alias("out"))
        down = F.struct(F.concat(a["parts"], F.array(x)).alias("parts"), a["out"].alias("out"))
        return F.when(x.isin("", "."), stay).when(x == "..", up).otherwise(down)

    return F.aggregate(whole, start, step, lambda a: F.when(~a["out"], F.array_join(a["parts"], "/")))


def language(path: Column) -> Column:
    """By name (Dockerfile, Makefile), then by ending; null if unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when((name == "dockerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile"), "dockerfile").when(name == "makefile", "makefile").otherwise(F.try_element_at(known, ending))


def is_test_file(path: Column) -> Column:
    """A test-like name, or a folder of tests on the way."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.rlike(r"^test_|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|^test\.[a-z]+$") | F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec)/")


def module_name(path: Column) -> Column:
    """Dotted Python module name; __init__ stands for its folder."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def ignore_regex(pattern: str, base: str = "") -> tuple[re.Pattern, bool] | None:
    """(regex over paths from the root, negated) of one line of an ignore file; None for blanks and comments.

    A pattern without an inner slash matches at any depth below its file's folder; a trailing slash matches folders
    only (here: something below them); ** spans folders, * and ? don't cross a slash.
    """
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.lstrip("\\") if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    prefix = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return re.compile(f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '(?:/|$)'}"), negated


class IgnoreRules:
    """Mandatory patterns can't be negated; of the others the last that matches wins. Layers carry their folder."""

    def __init__(self, mandatory: list[str], layers: list[tuple[str, list[str]]]):
        self.mandatory = [r for p in mandatory if (r := ignore_regex(p))]
        self.rules = [r for base, lines in layers for p in lines if (r := ignore_regex(p, base))]

    def ignored(self, path: str) -> bool:
        if any(r.search(path) for r, _ in self.mandatory):
            return True
        out = False
        for rule, negated in self.rules:
            if rule.search(path):
                out = not negated
        return out

    def prunes(self, folder: str) -> bool:
        """Whether nothing below the folder (with a slash at its end) can be taken: no rule may take it back."""
        below = folder + "x"
        if any(r.search(below) for r, _ in self.mandatory if r.search(folder)):
            return True
        return not any(negated for _, negated in self.rules) and any(r.search(folder) for r, _ in self.rules)
