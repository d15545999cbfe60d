"""Other languages by patterns: JavaScript, TypeScript, PHP, Bash, Go, Java and Ruby.

No syntax tree: definitions are found line by line after comments and strings are blanked out (same length, so
that lines and columns stay); their ends by matching braces (or `end` in Ruby). Calls are names before a
parenthesis within a definition. They resolve to a function of the file, then to a class of the file (a constructor), and
else wait for what the file's imports bind, or for a unique name over all files, as for Python. Imports of Go and Java name
packages and are resolved over all files. What patterns can't see (computed names, nested generics,
here-documents) is missed, not guessed.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from dataclasses import dataclass

from ...ids import node_key
from .model import Parsed

_WORD = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    name: str
    functions: tuple[str, ...]
    classes: tuple[str, ...] = ()
    variables: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    env: tuple[str, ...] = ()
    new: str | None = None
    line_comment: str = r"//[^\n]*"
    block_comment: str | None = r"/\*.*?\*/"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    ends: str = "brace"
    endings: tuple[str, ...] = ("",)


_JS = Language(
    "javascript",
    functions=(rf"(?:^|[^.\w])function\s*\*?\s*(?P<name>{_WORD})\s*\(", rf"(?:^|\s)(?:const|let|var)\s+(?P<name>{_WORD})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|{_WORD})\s*(?::[^=\n]+)?=>"),
    classes=(rf"(?:^|\s)(?:class|interface)\s+(?P<name>{_WORD})",),
    variables=(rf"^(?:export\s+)?(?:const|let|var)\s+(?P<name>{_WORD})\s*(?::[^=\n]+)?=(?![^\n]*=>)",),
    imports=(r"\bfrom\s*(?P<q>['\"])(?P<spec>[^'\"]+)(?P=q)", r"\brequire\(\s*(?P<q>['\"])(?P<spec>[^'\"]+)(?P=q)\s*\)", r"^\s*import\s*(?P<q>['\"])(?P<spec>[^'\"]+)(?P=q)"),
    env=(rf"\bprocess\.env\.(?P<name>{_WORD})", r"\bprocess\.env\[\s*['\"](?P<name>\w+)['\"]\s*\]"),
    new=rf"\bnew\s+(?P<name>{_WORD})\s*\(",
    strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    endings=("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts"),
)
LANGUAGES: dict[str, Language] = {
    ".js": _JS, ".jsx": _JS, ".mjs": _JS, ".cjs": _JS,
    ".ts": (_TS := Language(**(_JS.__dict__ | {"name": "typescript"}))), ".tsx": _TS,
    ".php": Language("php", (r"\bfunction\s+&?(?P<name>\w+)\s*\(",), (r"\b(?:class|interface|trait)\s+(?P<name>\w+)",), (r"^\$(?P<name>\w+)\s*=[^=>]", r"^\s*const\s+(?P<name>\w+)\s*="), (r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?(?P<q>['\"])/?(?P<spec>[^'\"]+)(?P=q)",), (r"\bgetenv\(\s*['\"](?P<name>\w+)['\"]",), r"\bnew\s+(?P<name>\w+)", r"(?://|#(?!\[))[^\n]*"),
    ".sh": (_SH := Language("bash", (r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?", r"^\s*function\s+(?P<name>[\w-]+)\s*\{?"), variables=(r"^(?:export\s+)?(?P<name>[A-Za-z_]\w*)=",), line_comment=r"(?m)(?:^|(?<=\s))#[^\n]*", block_comment=None)), ".bash": _SH,
    ".go": Language("go", (r"^func\s+(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(",), (r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b",), (r"^(?:var|const)\s+(?P<name>\w+)\b",), (r"^\s*(?:import\s+)?(?:\w+\s+)?(?P<q>\")(?P<spec>[\w./-]+)(?P=q)\s*$",), strings=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'"),
    ".java": Language("java", (r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*(?:<[^>\n]+>\s*)?[\w<>\[\],.? ]+\s(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*\{",), (r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)",), (), (r"^\s*import\s+(?P<static>static\s+)?(?P<spec>[\w.]+(?:\.\*)?)\s*;",), (r"\bSystem\.getenv\(\s*\"(?P<name>\w+)\"",), r"\bnew\s+(?P<name>\w+)"),
    ".rb": Language("ruby", (r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)",), (r"^\s*(?:class|module)\s+(?P<name>[A-Z]\w*)",), (r"^\s*(?P<name>[A-Z]\w*)\s*=[^=]",), (r"\brequire_relative\s+(?P<q>['\"])(?P<spec>[^'\"]+)(?P=q)",), (r"\bENV\[\s*['\"](?P<name>\w+)['\"]", r"\bENV\.fetch\(\s*['\"](?P<name>\w+)['\"]"), r"\b(?P<name>[A-Z]\w*)\.new\b", r"#[^\n]*", None, ends="end", endings=("", ".rb")),
}
_KEYWORDS = {
    "if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "async", "super", "sizeof", "print", "echo", "isset",
    "empty", "array", "list", "func", "defer", "select", "range", "make", "len", "cap", "append", "do", "elsif", "unless", "until", "puts", "require",
    "include", "define", "import", "class", "else", "try", "throw", "foreach", "match", "and", "or", "not", "in", "of", "case", "delete", "void",
    "yield", "synchronized", "getenv",
}
_RESERVED = {
    "if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "do", "else", "try", "throw", "foreach", "case",
    "unless", "until", "elsif",
}
_TEST_NAME = re.compile(r"^test_|_test\.\w+$|\.(test|spec)\.\w+$|^Test\w*\.java$|\w+Test\.(java|php)$|_spec\.rb$")
_TEST_CASE = re.compile(r"(?m)^\s*(?:it|test)\(\s*(['\"`])(.+?)\1")


def is_test(path: str) -> bool:
    return bool(_TEST_NAME.search(posixpath.basename(path))) or any(p in ("test", "tests", "__tests__", "spec") for p in path.split("/")[:-1])


def _blank(text: str, pattern: str | None, flags: int = 0) -> str:
    """Matches as blanks of the same shape."""
    return text if pattern is None else re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=flags)


def _masked(language: Language, text: str) -> tuple[str, str]:
    """(without comments, without comments and strings). Strings and comments are told apart by which comes first."""
    comments = "|".join(x for x in (language.block_comment, language.line_comment.replace("(?m)", "")) if x)
    both = re.compile(f"(?P<s>{language.strings})|(?P<c>{comments})", re.S | re.M)
    shape = lambda s: re.sub(r"[^\n]", " ", s)
    plain = both.sub(lambda m: m[0] if m["s"] is not None else shape(m[0]), text)
    bare = both.sub(lambda m: shape(m[0]), text)
    return plain, bare


def _end(language: Language, bare: str, at: int) -> int:
    """Where the definition that begins at ``at`` ends."""
    if language.ends == "end":
        depth, at = 0, bare.rfind("\n", 0, at) + 1
        for m in re.finditer(r"(?m)^\s*(?P<open>(?:def|class|module|if|unless|while|until|case|begin|for)\b)|\bdo\b(?=\s*(?:\|[^|\n]*\|)?\s*$)|(?P<close>\bend\b)", bare[at:]):
            depth += -1 if m["close"] else 1
            if depth <= 0:
                return at + m.end()
        return len(bare)
    start = bare.find("{", at)
    line_end = bare.find(";", at)
    if start < 0 or 0 <= line_end < start:
        stop = bare.find("\n", at)
        return len(bare) if stop < 0 else stop
    depth = 0
    for m in re.finditer(r"[{}]", bare[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start + m.end()
    return len(bare)


_FROM = re.compile(rf"\bimport\s+(?:type\s+)?(?:(?P<one>{_WORD})\s*,?\s*)?(?:\{{(?P<some>[^}}]*)\}}|\*\s+as\s+(?P<all>{_WORD}))?\s*from\s*(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)")
_REQUIRE = re.compile(rf"\b(?:const|let|var)\s+(?:(?P<all>{_WORD})|\{{(?P<some>[^}}]*)\}})\s*=\s*require\(\s*(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)\s*\)")
_NAMED = re.compile(rf"^(?:type\s+)?(?P<symbol>{_WORD})(?:\s*(?:\bas\b|:)\s*(?P<local>{_WORD}))?$")


def _bindings(path: str, plain: str) -> dict[str, dict]:
    """What import and require bind in the file: by local name the symbol, and the files it may come from (none for packages)."""
    out: dict[str, dict] = {}
    for found in [*_FROM.finditer(plain), *_REQUIRE.finditer(plain)]:
        spec, paths = found["spec"], []
        if spec.startswith("."):
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
            paths = [base + ending for ending in _JS.endings if ending or posixpath.splitext(base)[1]]
        if local := found["all"]:
            out[local] = {"kind": "module", "module": spec, "symbol": "*", "paths": paths}
        if local := found.groupdict().get("one"):
            out[local] = {"kind": "symbol", "module": spec, "symbol": "default", "paths": paths}
        for part in (found["some"] or "").split(","):
            if named := _NAMED.match(part.strip()):
                out[named["local"] or named["symbol"]] = {"kind": "symbol", "module": spec, "symbol": named["symbol"], "paths": paths}
    return out


def _default_export(bare: str) -> str | None:
    found = re.search(rf"\bexport\s+default\s+(?:async\s+)?(?:function\s*\*?\s*|class\s+)?(?P<name>{_WORD})", bare)
    return found["name"] if found and found["name"] not in ("function", "class", "async") else None


def _package(bare: str) -> str:
    found = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", bare)
    return found[1] if found else ""


def parse(path: str, content: str) -> Parsed:
    language = LANGUAGES[posixpath.splitext(path)[1].lower()]
    out = Parsed(path, language.name)
    plain, bare = _masked(language, content)
    starts = [0, *(m.end() for m in re.finditer("\n", content))]
    line_of = lambda at: bisect_right(starts, at)
    lines = content.splitlines()
    module = posixpath.splitext(path)[0]
    module_id = node_key("Module", posixpath.basename(module), module, path)
    spans: list[tuple[int, int, str, str, str]] = []  # start, end, kind, name, id
    found = [(m.start("name"), "Class", m["name"], None) for p in language.classes for m in re.finditer(p, bare, re.M)]
    found += [(m.start("name"), "Function", m["name"], (m.groupdict().get("owner") or "").split()) for p in language.functions for m in re.finditer(p, bare, re.M)]
    local: dict[str, str] = {}
    classes: dict[str, str] = {}
    members: dict[tuple[str, str], str] = {}
    done: set[tuple[int, str]] = set()
    for at, kind, name, owner in sorted(found, key=lambda x: x[0]):
        if name in _RESERVED or (at, name) in done:
            continue
        done.add((at, name))
        end = _end(language, bare, at)
        holders = [s for s in spans if s[0] < at < s[1]]
        holder = holders[-1] if holders else None
        cls = holder[3] if holder and holder[2] == "Class" else owner[-1].lstrip("*") if owner else None
        own_kind = "Method" if kind == "Function" and cls else kind
        qualified = ".".join([module, *([cls] if cls and not holder else []), *(s[3] for s in holders), name])
        number = line_of(at)
        own = out.node(own_kind, name, qualified, number, line_of(max(at, end - 1)), language.name, {"signature": lines[number - 1].strip()[:200]})
        parent = holder[4] if holder else classes.get(cls, module_id) if cls else module_id
        out.edge("CONTAINS" if parent != module_id else "DEFINES", parent, own, number)
        spans.append((at, end, own_kind, name, own))
        if own_kind == "Class":
            classes[name] = own
        elif own_kind == "Method":
            members[cls, name] = own
        else:
            local.setdefault(name, own)
    if language.name in ("javascript", "typescript", "java", "php"):  # methods have no keyword
        for start, end, kind, cls, own in [s for s in spans if s[2] == "Class"]:
            for m in re.finditer(rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<name>{_WORD})\s*\([^;{{}}\n]*\)\s*(?::[^{{\n]+)?\{{", bare[start:end]):
                name, at = m["name"], start + m.start("name")
                inner = [s for s in spans if s[0] < at < s[1]]
                if name in _RESERVED or (cls, name) in members or not inner or inner[-1][4] != own:
                    continue
                stop = _end(language, bare, at)
                method = out.node("Method", name, f"{module}.{cls}.{name}", line_of(at), line_of(stop - 1), language.name, {"signature": lines[line_of(at) - 1].strip()[:200]})
                out.edge("CONTAINS", own, method, line_of(at))
                members[cls, name] = method
                spans.append((at, stop, "Method", name, method))
    for pattern in language.variables:
        for m in re.finditer(pattern, bare, re.M):
            if not any(s[0] < m.start("name") < s[1] for s in spans) and m["name"] not in local:
                out.edge("DEFINES", module_id, out.node("Variable", m["name"], f"{module}.{m['name']}", line_of(m.start("name")), line_of(m.start("name")), language.name), line_of(m.start("name")))

    def scope(at: int) -> tuple[str, str | None]:
        """(innermost callable or module, class around it)."""
        around = sorted((s for s in spans if s[0] < at < s[1]), key=lambda s: s[0])
        return next((s[4] for s in reversed(around) if s[2] != "Class"), module_id), next((s[3] for s in reversed(around) if s[2] == "Class"), None)

    pending: list[dict] = []

    def call(at: int, name: str, construct: bool, mine: bool = False) -> None:
        owner, cls = scope(at)
        number, target = line_of(at), None
        if construct:
            if name in classes:
                out.edge("INSTANTIATES", owner, classes[name], number, confidence=0.9)
            else:
                pending.append({"caller_id": owner, "name": name, "line": number})
            return
        target = members.get((cls, name)) if mine or language.name in ("java", "ruby") and cls else None
        target = target or (None if mine else local.get(name))
        if target:
            if target != owner or name in local:
                out.edge("CALLS", owner, target, number, confidence=0.9)
        elif not mine and language.name != "bash":
            pending.append({"caller_id": owner, "name": name, "line": number})

    defined = {at for at, _ in done} | {s[0] for s in spans}
    if language.name == "bash":
        for name in local:
            for m in re.finditer(rf"(?m)(?:^|[;&|(`]|\$\()\s*(?P<name>{re.escape(name)})(?=\s|$|[;&|)])(?!\s*\(\))", bare):
                if m.start("name") not in defined:
                    call(m.start("name"), name, False)
    else:
        made = {m.start("name"): m["name"] for m in re.finditer(language.new, bare)} if language.new else {}
        for at, name in made.items():
            call(at, name, True)
        for m in re.finditer(rf"(?P<self>(?:\bthis\.|\$this->|\bself\.))?(?<![\w$.>:\\])?(?P<name>{_WORD})\s*\(", bare):
            at, name = m.start("name"), m["name"]
            before = bare[max(0, at - 2) : at]
            if at in made or at in defined or name in _KEYWORDS or (not m["self"] and (before.endswith((".", "->", "::")) or bare[at - 1 : at] in ("$", "@"))):
                continue
            call(at, name, False, bool(m["self"]))
    for pattern in language.env:
        for m in re.finditer(pattern, plain):
            out.edge("READS_ENV", scope(m.start())[0], out.env(m["name"], line_of(m.start())), line_of(m.start()))
    external: list[str] = []
    packages: list[dict] = []  # resolved over all files, by package
    for pattern in language.imports:
        for m in re.finditer(pattern, plain, re.M):
            spec, number = m["spec"], line_of(m.start("spec"))
            if language.name in ("go", "java"):
                packages.append({"kind": "go" if language.name == "go" else "static" if m["static"] else "wildcard" if spec.endswith(".*") else "class", "spec": spec, "line": number})
                continue
            if language.name in ("javascript", "typescript") and not spec.startswith("."):
                external.append(spec)
                continue
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
            for ending in language.endings:
                other = target + ending
                out.edge("IMPORTS", module_id, node_key("Module", posixpath.basename(posixpath.splitext(other)[0]), posixpath.splitext(other)[0], other), number)
    test = is_test(path)
    if test and language.name in ("javascript", "typescript"):
        used: dict[str, int] = {}
        for m in _TEST_CASE.finditer(plain):
            used[m[2]] = used.get(m[2], 0) + 1
            title = m[2] if used[m[2]] == 1 else f"{m[2]}@{used[m[2]]}"
            out.edge("DEFINES", module_id, out.node("TestCase", m[2][:120], f"{module}.{title}", line_of(m.start()), None, language.name), line_of(m.start()))
    out.node("Module", posixpath.basename(module), module, 1 if lines else None, len(lines) or None, language.name, {"pending": pending, "imports": _bindings(path, plain) if language.name in ("javascript", "typescript") else {}, "default_export": _default_export(bare) if language.name in ("javascript", "typescript") else None, "package": _package(bare) if language.name == "java" else None, "package_imports": packages, "external_imports": sorted(set(external)), "is_test_file": test})
    if test:
        out.node("TestFile", posixpath.basename(path), path, 1, len(lines) or None, language.name)
    return out
