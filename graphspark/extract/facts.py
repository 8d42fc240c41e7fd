"""What an extractor says about one file."""

from __future__ import annotations

import hashlib
import json

from graphspark.schema import EXTERNAL

Scope = tuple[str, ...]


class Facts:
    """Collects the rows of a file. Nodes are merged by id, edges by type, ends and place.

    A node ``a.py#f.x`` is the symbol x in scope ``a.py:f``; ``a.py#`` is the file; ``#external:m.x`` is outside.
    """

    def __init__(self, file: str, source: str):
        self.file, self.source = file, source
        self.source_hash = hashlib.sha256(source.encode()).hexdigest()[:12]
        self.nodes: dict[str, dict] = {}
        self.edges: dict[tuple, dict] = {}
        self.transforms: list[dict] = []
        lines = source.count("\n") + 1
        self._put(self.id(), "File", file, (1, 0), (lines, 0), file, "", 0)

    def id(self, *path: str) -> str:
        return f"{self.file}#{'.'.join(path)}"

    def scope(self, path: Scope) -> str:
        return f"{self.file}:{'.'.join(path)}" if path else self.file

    def place(self, at: tuple[int, int]) -> str:
        return f"{self.file}:{at[0]}:{at[1]}"

    def _put(self, node: str, kind: str, name: str, at: tuple[int, int], end: tuple[int, int], scope: str, annotation: str, is_param: int) -> str:
        known = self.nodes.get(node)
        if known is None:
            self.nodes[node] = {"id": node, "kind": kind, "name": name, "location": self.place(at), "end_location": self.place(end), "scope": scope, "type_annotation": annotation, "source_hash": self.source_hash, "is_param": is_param}
        else:
            known["type_annotation"] = known["type_annotation"] or annotation
            known["is_param"] = max(known["is_param"], is_param)
        return node

    def node(self, kind: str, name: str, scope: Scope, at: tuple[int, int], end: tuple[int, int] | None = None, annotation: str = "", is_param: bool = False) -> str:
        return self._put(self.id(*scope, name), kind, name, at, end or at, self.scope(scope), annotation, int(is_param))

    def external(self, name: str, at: tuple[int, int]) -> str:
        return self._put(EXTERNAL + name, "External", name, at, at, "", "", 0)

    def edge(self, kind: str, source: str, target: str, at: tuple[int, int], code: str, **meta: object) -> None:
        key = (kind, source, target, at)
        meta = {k: v for k, v in meta.items() if v is not None}
        if key in self.edges:
            said = json.loads(self.edges[key]["metadata"]) | meta
            self.edges[key]["metadata"] = json.dumps(said, ensure_ascii=False)
            return
        number = len(self.edges) + 1
        self.edges[key] = {"id": f"{self.file}!E{number:05d}", "edge_type": kind, "from_node": source, "to_node": target, "location": self.place(at), "code": code, "metadata": json.dumps(meta, ensure_ascii=False), "raw_to_node": target}

    def transform(self, kind: str, op: str, at: tuple[int, int], code: str, inputs: list[str], outputs: list[str], branch: str | None = None) -> None:
        number = len(self.transforms) + 1
        self.transforms.append({"id": f"{self.file}!T{number:05d}", "kind": kind, "op": op, "op_node": "", "location": self.place(at), "inputs": inputs, "outputs": outputs, "branch": branch, "code": code})

    def resolve(self, name: str, scope: Scope) -> str | None:
        """The node of a name, looked for from the inner scope out to the file."""
        for k in range(len(scope), -1, -1):
            node = self.id(*scope[:k], name)
            if node in self.nodes:
                return node
        return None
