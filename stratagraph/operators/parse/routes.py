"""Routes of web frameworks and commands of command-line programs."""

from __future__ import annotations

import ast
import posixpath
import re

from . import light
from .model import Parsed
from .python_code import module_of

_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "all")
_EXPRESS = re.compile(rf"\b(?:app|router)\.({'|'.join(_METHODS)})\(\s*(['\"`])([^'\"`$]*)\2\s*,\s*(.*)")


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _arguments(bare: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of the arguments from ``at`` up to the call's closing bracket; none where it isn't closed."""
    depth, start, out = 0, at, []
    for m in re.finditer(r"[(){}\[\],]", bare[at:]):
        if m[0] in "([{":
            depth += 1
        elif m[0] != ",":
            depth -= 1
        if depth < 0 or m[0] == "," and not depth:
            text = bare[start : at + m.start()]
            if text.strip() or depth >= 0:
                out.append((start + len(text) - len(text.lstrip()), start + len(text.rstrip())))
            if depth < 0:
                return out
            start = at + m.end()
    return []


def parse_routes(path: str, content: str) -> Parsed:
    """Flask decorators in Python; app.METHOD and router.METHOD calls in JavaScript and TypeScript."""
    out = Parsed(path, "routes")
    if path.lower().endswith(".py"):
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return out  # the code parser warns
        for node in ast.walk(tree):
            if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                continue
            for mark in node.decorator_list:
                if not (isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args):
                    continue
                where, verb = _literal(mark.args[0]), mark.func.attr.lower()
                if where is None or not where.startswith("/") or verb not in ("route", *_METHODS):
                    continue
                listed = next((k.value for k in mark.keywords if k.arg == "methods"), None)
                verbs = [v for e in getattr(listed, "elts", []) if (v := _literal(e))] or (["GET"] if verb == "route" else [verb.upper()])
                for v in verbs:
                    out.node("Route", f"{v.upper()} {where}", f"{v.upper()} {where}", mark.lineno, node.lineno, "python", {"handler": node.name, "handler_line": node.lineno, "framework": "flask"})
        return out
    language = "typescript" if path.lower().endswith((".ts", ".tsx")) else "javascript"
    masked = light._masked(light.LANGUAGES[posixpath.splitext(path)[1].lower()], content)[1]
    begins = 0
    for number, line in enumerate(content.split("\n"), 1):
        at, begins = begins, begins + len(line) + 1
        if found := _EXPRESS.search(line):
            last = found[4].rstrip().rstrip(";").rstrip(")").split(",")[-1].strip()
            inline = "=>" in found[4] or "function" in found[4]
            about = {"framework": "express", "inline": inline} | ({} if inline or not re.fullmatch(r"[\w$.]+", last) else {"handler": last})
            name = f"{found[1].upper()} {found[3]}"
            given = _arguments(masked, at + found.start(4))
            last_line = number + content.count("\n", at, given[-1][1]) if given else number
            route = out.node("Route", name, name, number, last_line, language, about)
            if len(given) == 1 and re.match(r"(async\s+)?(function\b|\([^{]*=>|[\w$]+\s*=>)", masked[given[0][0] : given[0][1]]):
                first = number + content.count("\n", at, given[0][0])
                own = out.node("Function", f"{name} callback", f"{posixpath.splitext(path)[0]}#route:{name}@{first}", first, last_line, language, {"framework": "express", "route": name, "synthetic_identity": "literal-route-and-source-span"})
                out.edge("HANDLES_ROUTE", route, own, number, confidence=0.9)
    return out


def parse_cli(path: str, content: str) -> Parsed:
    """click and typer commands with their groups in front."""
    out = Parsed(path, "cli")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return out
    text = content
    if "click" not in text and "typer" not in text:
        return out
    functions = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    groups: dict[str, tuple[str | None, str]] = {}  # variable -> parent variable, name
    for node in tree.body:  # app.add_typer(sub, name="x")
        call = node.value if isinstance(node, ast.Expr) else None
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "add_typer" and call.args and isinstance(call.args[0], ast.Name) and isinstance(call.func.value, ast.Name):
            name = next((_literal(k.value) for k in call.keywords if k.arg == "name"), None) or call.args[0].id
            groups[call.args[0].id] = (call.func.value.id, name)
    found: list[tuple[ast.FunctionDef, str | None, str]] = []
    for function in functions:
        for mark in function.decorator_list:
            call = mark if isinstance(mark, ast.Call) else None
            target = call.func if call else mark
            if not (isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.attr in ("command", "group")):
                continue
            given = _literal(call.args[0]) if call and call.args else next((_literal(k.value) for k in call.keywords if k.arg == "name"), None) if call else None
            name = given or function.name.lower().replace("_", "-")
            parent = None if target.value.id in ("click", "typer") else target.value.id
            if target.attr == "group":
                groups[function.name] = (parent, "" if parent is None else name)
            else:
                found.append((function, parent, name))
    for function, parent, name in found:
        chain, at, guard = [name], parent, set()
        while at in groups and at not in guard:
            guard.add(at)
            if groups[at][1]:
                chain.insert(0, groups[at][1])
            at = groups[at][0]
        whole = " ".join(chain)
        out.node("CLICommand", whole, f"{module_of(path)}:{whole}", function.lineno, function.end_lineno, "python", {"handler": function.name})
    return out
