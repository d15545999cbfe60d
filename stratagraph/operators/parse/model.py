"""What a parser gives."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ...ids import edge_key, node_key


@dataclass
class Parsed:
    path: str
    parser: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    texts: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def node(self, kind: str, name: str, qualified_name: str = "", start: int | None = None, end: int | None = None, language: str | None = None, metadata: dict | None = None, path: str | None = None) -> str:
        """Adds a node and gives its id; path '' makes it the repository's."""
        own = self.path if path is None else path
        key = node_key(kind, name, qualified_name, own)
        self.nodes.append({"id": key, "type": kind, "name": name, "qualified_name": qualified_name or None, "path": own, "start_line": start, "end_line": end, "language": language, "metadata": json.dumps(metadata or {}, sort_keys=True), "confidence": 1.0, "extractor": self.parser})
        return key

    def edge(self, kind: str, source: str, target: str, start: int | None = None, end: int | None = None, confidence: float = 1.0, metadata: dict | None = None, inferred: bool = False) -> None:
        self.edges.append({"id": edge_key(kind, source, target, self.path, start), "type": kind, "source_node_id": source, "target_node_id": target, "path": self.path, "start_line": start, "end_line": end, "metadata": json.dumps(metadata or {}, sort_keys=True), "confidence": confidence, "extractor": self.parser, "is_inferred": inferred})

    def text(self, name: str, content: str, node: str | None) -> None:
        self.texts.append({"path": self.path, "name": name, "content": content, "node_id": node})

    def env(self, name: str, line: int | None) -> str:
        return self.node("EnvVar", name, name, metadata={"observation": {"path": self.path, "line": line}}, path="")
