"""Python by its own syntax tree: modules, classes, functions, variables, imports, calls, environment reads, tests, tables.

Calls resolve in a fixed order: a function of the file, a class of the file, an import; what is left is
pending and resolves over all files by name (operators.resolve). Pending calls, imports and model facts are in
the module's metadata.
"""

from __future__ import annotations

import ast
import posixpath
import re

from ...ids import node_key
from .model import Parsed

_TEST = re.compile(r"^test_|_test\.py$|^tests?\.py$")


def module_of(path: str) -> str:
    bare = path.removesuffix(".py").removesuffix("/__init__")
    return bare.replace("/", ".")


def is_test(path: str) -> bool:
    return bool(_TEST.search(posixpath.basename(path))) or any(p in ("test", "tests", "__tests__") for p in path.split("/")[:-1])


class _Scopes(ast.NodeVisitor):
    def __init__(self, out: Parsed, module: str, module_id: str, source: list[str]):
        self.out, self.module, self.module_id, self.source = out, module, module_id, source
        self.stack: list[tuple[str, str, str]] = []  # kind, name, id
        self.local: dict[str, str] = {}  # top functions
        self.classes: dict[str, str] = {}
        self.methods: dict[tuple[str, str], str] = {}
        self.imports: dict[str, dict] = {}
        self.external: list[str] = []
        self.pending: list[dict] = []
        self.calls: list[tuple[str, str | None, ast.Call]] = []
        self.reads: list[tuple[str, str, int]] = []
        self.models: list[dict] = []
        self.operations: list[dict] = []

    def owner(self) -> str:
        return next((i for kind, _, i in reversed(self.stack) if kind != "Class"), self.module_id)

    def _definition(self, node, kind: str) -> None:
        names = [n for _, n, _ in self.stack] + [node.name]
        qualified = ".".join([self.module, *names])
        test = kind != "Class" and node.name.startswith("test") and is_test(self.out.path)
        own = self.out.node("TestCase" if test else kind, node.name, qualified, node.lineno, node.end_lineno, "python", {"signature": self.source[node.lineno - 1].strip()[:200]})
        parent = self.stack[-1][2] if self.stack else self.module_id
        self.out.edge("CONTAINS" if self.stack else "DEFINES", parent, own, node.lineno)
        if not self.stack:
            (self.classes if kind == "Class" else self.local)[node.name] = own
        elif self.stack[-1][0] == "Class" and kind != "Class":
            self.methods[self.stack[-1][1], node.name] = own
        self.stack.append((kind, node.name, own))
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node):  # noqa: N802
        for s in node.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
            if any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in targets) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str) and s.value.value:
                self.models.append({"class": node.name, "table": s.value.value, "line": s.lineno})
        self._definition(node, "Class")

    def visit_FunctionDef(self, node):  # noqa: N802
        self._definition(node, "Method" if self.stack and self.stack[-1][0] == "Class" else "Function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Assign(self, node):  # noqa: N802
        if not self.stack:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    own = self.out.node("Variable", target.id, f"{self.module}.{target.id}", node.lineno, node.end_lineno, "python")
                    self.out.edge("DEFINES", self.module_id, own, node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        for name in node.names:
            self.imports[name.asname or name.name.split(".")[0]] = {"kind": "module", "module": name.name if name.asname else name.name.split(".")[0], "line": node.lineno}
            self.external.append(name.name)

    def visit_ImportFrom(self, node):  # noqa: N802
        base = node.module or ""
        if node.level:
            package = self.out.path.split("/")[:-1]
            package = package[: len(package) - node.level + 1]
            base = ".".join([*package, *([base] if base else [])])
        for name in node.names:
            self.imports[name.asname or name.name] = {"kind": "symbol", "module": base, "symbol": name.name, "line": node.lineno}
        self.external.append(base)

    def visit_Call(self, node):  # noqa: N802
        owner = self.owner()
        cls = next((n for kind, n, _ in reversed(self.stack) if kind == "Class"), None)
        self.calls.append((owner, cls, node))
        text = ast.unparse(node.func)
        self._operation(owner, text.split("."), node)
        if text in ("os.getenv", "os.environ.get", "getenv", "environ.get") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.reads.append((owner, node.args[0].value, node.lineno))
        self.generic_visit(node)

    def _operation(self, owner: str, parts: list[str], node: ast.Call) -> None:
        """Reads and writes of SQLAlchemy models by their usual patterns."""
        first = node.args[0] if node.args else None
        model = first.id if isinstance(first, ast.Name) else None
        mode, pattern = "read", None
        if len(parts) >= 3 and parts[1] == "query":
            model, pattern = parts[0], "Model.query.*"
        elif parts == ["select"]:
            pattern = "select(Model)"
        elif "session" in parts[:-1] and parts[-1] == "get":
            pattern = "session.get(Model, ...)"
        elif "session" in parts[:-1] and parts[-1] in ("add", "merge"):
            model = first.func.id if isinstance(first, ast.Call) and isinstance(first.func, ast.Name) else None
            mode, pattern = "write", f"session.{parts[-1]}(Model(...))"
        if model and pattern:
            self.operations.append({"source_id": owner, "model": model, "mode": mode, "line": node.lineno, "pattern": pattern})

    def tables(self) -> None:
        """A Table for each literal of a class whose name is the only one of the file."""
        own = [n for n in self.out.nodes if n["type"] == "Class"]
        for fact in self.models:
            named = [n for n in own if n["name"] == fact["class"]]
            if len(named) != 1:
                continue
            about = {"framework": "sqlalchemy", "model": named[0]["qualified_name"], "model_id": named[0]["id"]}
            table = self.out.node("Table", fact["table"], f"{named[0]['qualified_name']}.__table__:{fact['table']}", fact["line"], fact["line"], "sql", about)
            self.out.edge("DEPENDS_ON", named[0]["id"], table, fact["line"], fact["line"], metadata={"relation": "maps-table"})

    def visit_Subscript(self, node):  # noqa: N802
        if isinstance(node.ctx, ast.Load) and ast.unparse(node.value) in ("os.environ", "environ") and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            self.reads.append((self.owner(), node.slice.value, node.lineno))
        self.generic_visit(node)

    def resolve(self) -> None:
        for owner, cls, call in self.calls:
            line, target, kind = call.lineno, None, "CALLS"
            if isinstance(call.func, ast.Name):
                name = call.func.id
                if name in self.local:
                    target = self.local[name]
                elif name in self.classes:
                    target, kind = self.classes[name], "INSTANTIATES"
                elif (bound := self.imports.get(name)) and bound["kind"] == "symbol":
                    self._speculate(owner, bound["module"], bound["symbol"], line)
                    continue
                else:
                    self.pending.append({"caller_id": owner, "name": name, "line": line})
                    continue
            elif isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name):
                base = call.func.value.id
                if base == "self" and cls:
                    target = self.methods.get((cls, call.func.attr))
                elif (bound := self.imports.get(base)):
                    module = bound["module"] if bound["kind"] == "module" else f"{bound['module']}.{bound['symbol']}"
                    self._speculate(owner, module, call.func.attr, line)
                    continue
            if target:
                self.out.edge(kind, owner, target, line, confidence=0.9)

    def _speculate(self, owner: str, module: str, symbol: str, line: int) -> None:
        """Ids that the symbol would have in each place where its module can be."""
        for path in (module.replace(".", "/") + ".py", module.replace(".", "/") + "/__init__.py"):
            self.pending.append({"caller_id": owner, "line": line, "function_id": node_key("Function", symbol, f"{module}.{symbol}", path), "class_id": node_key("Class", symbol, f"{module}.{symbol}", path)})


def parse(path: str, content: str) -> Parsed:
    out = Parsed(path, "python")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as error:
        out.warnings.append(f"{path}: invalid Python at line {getattr(error, 'lineno', '?')}")
        return out
    lines = content.splitlines()
    module = module_of(path)
    module_id = node_key("Module", module.rsplit(".", 1)[-1], module, path)
    scopes = _Scopes(out, module, module_id, lines or [""])
    scopes.visit(tree)
    scopes.resolve()
    scopes.tables()
    for owner, name, line in scopes.reads:
        out.edge("READS_ENV", owner, out.env(name, line), line)
    for bound in {b["module"]: b for b in scopes.imports.values() if b["module"]}.values():
        for target in (bound["module"].replace(".", "/") + ".py", bound["module"].replace(".", "/") + "/__init__.py"):
            out.edge("IMPORTS", module_id, node_key("Module", bound["module"].rsplit(".", 1)[-1], bound["module"], target), bound["line"])
    about = {"imports": scopes.imports, "external_imports": sorted(set(scopes.external)), "pending": scopes.pending, "orm_models": scopes.models, "orm_operations": scopes.operations, "is_test_file": is_test(path)}
    out.node("Module", module.rsplit(".", 1)[-1], module, 1 if lines else None, len(lines) or None, "python", about)
    if is_test(path):
        out.node("TestFile", posixpath.basename(path), path, 1, len(lines) or None, "python")
    return out
