"""Python sources as a table of facts. The parser runs once for each distinct object; everything after it is relational.

Walks over a tree differ in which fields they follow. FOLLOWED says so for each of them; fields that no walk follows, such as
the right side of an assignment, are not part of the model.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes deeper than this keep their type alone.
DEPTH = 50
FACTS = "object string, fact string, seq int, name string, label string, line long, col long, scope string, ids array<int>, n long"

FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
LOOPS = ("For", "AsyncFor")

#: Child fields that the model has, by node type; EVERY holds for all types where the field is a list of nodes.
EVERY = ("body", "orelse", "handlers")
HELD = {
    **dict.fromkeys(FUNCTIONS, ("decorator_list", "returns", "annotations")),
    "ClassDef": ("bases", "decorator_list"),
    "Assign": ("targets",),
    "AnnAssign": ("target", "annotation"),
    "AugAssign": ("target",),
    **dict.fromkeys(("Expr", "Return", "Yield", "YieldFrom", "Attribute"), ("value",)),
    "Call": ("func", "args", "keywords"),
    "Subscript": ("value", "slice"),
    "BinOp": ("left", "right"),
    "Compare": ("left", "comparators"),
    "BoolOp": ("values",),
    "UnaryOp": ("operand",),
    **dict.fromkeys(("List", "Tuple", "Set"), ("elts",)),
    "Dict": ("keys", "values"),
    **dict.fromkeys(("If", "While", "IfExp"), ("test",)),
    **dict.fromkeys(LOOPS, ("iter", "target")),
    "ExceptHandler": ("type",),
}
#: Fields that a walk follows: by type, or for all other types under None.
FOLLOWED = {
    "complexity": {None: (*EVERY, "values", "elts", "args", "value", "test", "func", "left", "right", "target", "iter", "slice")},
    "uses": {
        "Assign": (),
        "AnnAssign": ("annotation",),
        "AugAssign": ("target",),
        **dict.fromkeys(FUNCTIONS, ("returns", "annotations", "decorator_list", "body")),
        **dict.fromkeys(LOOPS, ("iter", "body", "orelse")),
        None: (*EVERY, "args", "keywords", "elts", "keys", "values", "func", "value", "slice", "left", "right", "comparators", "test", "operand"),
    },
    "definitions": {**dict.fromkeys((*FUNCTIONS, "ClassDef"), ("body",)), None: EVERY},
    "imports": {None: ("body",)},
    "counts": {**dict.fromkeys((*FUNCTIONS, "ClassDef"), ("body",)), None: ()},
    "symbols": {
        **dict.fromkeys((*FUNCTIONS, "ClassDef", "ExceptHandler"), ("body",)),
        **dict.fromkeys((*LOOPS, "While", "If", "With", "AsyncWith"), ("body", "orelse")),
        "Try": EVERY[:1] + EVERY[2:] + EVERY[1:2],
        None: (),
    },
}
#: Decision points, by type.
DECISIONS = frozenset(("If", "IfExp", *LOOPS, "While", "ExceptHandler", "Assert", "ListComp", "SetComp", "DictComp", "GeneratorExp"))


#: What a stored tree has of a node besides its children; other names of fields there; what counts as a child of its own.
PLAIN = ("lineno", "col_offset", "end_lineno", "end_col_offset", "name", "id", "attr", "asname", "module", "arg")
RENAMED = {"decorator_list": "decorators", "type": "exc_type"}
NODES = (ast.expr, ast.stmt, ast.excepthandler, ast.withitem, ast.comprehension, ast.match_case)


def _type(node: ast.AST) -> str:
    return type(node).__name__


def _literal(value: object) -> object:
    """A constant as JSON can have it."""
    if isinstance(value, bytes):
        return f"<bytes:{len(value)}>"
    finite = not isinstance(value, float) or value - value == 0
    return value if isinstance(value, (str, int, float, type(None))) and finite else f"<{type(value).__name__}>"


class Tree:
    """The nodes of one source that the model has, with the facts about them."""

    def __init__(self, source: bytes, full: bool = False):
        """full: also follow the right sides of assignments, with items, finally and the like, which the model leaves out."""
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.root = ast.parse(source)
        self.full = full
        self.nodes = sum(1 for _ in ast.walk(self.root))
        self.depth: dict[int, int] = {}
        self.ids: dict[int, int] = {}
        for node in self.root.body:
            self._measure(node, 0)
        self.rows: list[tuple] = []

    def _measure(self, node: ast.AST, depth: int) -> None:
        """Numbers nodes in order and notes their depths; nodes too deep get no children."""
        self.ids[id(node)], self.depth[id(node)] = len(self.ids), depth
        if depth <= DEPTH:
            for _, child in self._held(node):
                self._measure(child, depth + 1)

    def _fields(self, node: ast.AST) -> list[str]:
        fields = [*HELD.get(_type(node), ()), *EVERY]
        return fields + [f for f in node._fields if f not in fields] if self.full else fields

    def _held(self, node: ast.AST) -> Iterator[tuple[str, ast.AST]]:
        for field in self._fields(node):
            if field == "annotations":
                found = [a.annotation for a in node.args.args if a.annotation]
            else:
                found = getattr(node, field, None)
                if field in EVERY and not isinstance(found, list) and not self.full:
                    continue
            for child in found if isinstance(found, list) else [found]:
                if isinstance(child, ast.keyword):
                    child = child.value
                if isinstance(child, (ast.expr, ast.stmt, ast.excepthandler, *(((ast.withitem, ast.comprehension, ast.match_case)) if self.full else ()))):
                    yield field, child

    def children(self, node: ast.AST, walk: str) -> Iterator[ast.AST]:
        if self.depth.get(id(node), DEPTH + 1) > DEPTH:
            return
        rules = FOLLOWED[walk]
        follow = rules.get(_type(node), rules[None])
        order = {f: i for i, f in enumerate(follow)}
        extra = self.full and walk in ("uses", "complexity")
        found = [(order.get(f, len(order)), k, c) for k, (f, c) in enumerate(self._held(node)) if f in order or extra and f not in ("targets", "target")]
        for _, _, child in sorted(found, key=lambda x: x[:2]):
            yield child

    def fact(self, fact: str, name: str | None = None, label: str | None = None, node: ast.AST | None = None, scope: str | None = None, ids: list[int] | None = None, n: int | None = None) -> None:
        self.rows.append((fact, len(self.rows), name, label, getattr(node, "lineno", None), getattr(node, "col_offset", None), scope, ids, n))

    def facts(self) -> list[tuple]:
        self.fact("module", n=self.nodes, label=self.tree())
        for node in self.root.body:
            self._counts(node, [])
            self._symbols(node, "module")
            self._imports(node)
            self._definitions(node)
            self._shadowing(node, -1, [])
        uses: set[str] = set()
        for node in self.root.body:
            self._uses(node, uses)
        for name in sorted(uses):
            self.fact("use", name)
        return self.rows

    def tree(self) -> str:
        """The tree as JSON, with the number of all its nodes, also of those that the model leaves out."""
        return json.dumps({"type": "Module", "ast_mode": "full", "body": [self._json(x) for x in self.root.body], "stats": {"total_nodes": self.nodes}}, sort_keys=True, separators=(",", ":"))

    def _json(self, node: ast.AST, depth: int = 0) -> dict:
        """The node as the stored tree has it; a field without a value is left out, but for body."""
        kind = _type(node)
        out: dict = {"type": kind}
        if depth > DEPTH:
            return out | {"truncated": True}
        out |= {k: v for k in PLAIN if isinstance(v := getattr(node, k, None), (str, int))}
        if isinstance(node, ast.Constant):
            out["value"] = _literal(node.value)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out["names"] = [{"name": a.name, "asname": a.asname} for a in node.names]
            out |= {"level": node.level} if kind == "ImportFrom" else {}
        elif isinstance(node, ast.BoolOp):
            out["op"] = _type(node.op)
        elif kind in FUNCTIONS:
            out["args"] = self._arguments(node.args, depth + 1)
        for field in self._fields(node):
            child = getattr(node, field, None)
            if field == "keywords" and kind == "Call":
                out |= {field: [{"arg": k.arg, "value": self._json(k.value, depth + 1)} for k in child]} if child else {}
            elif isinstance(child, list) and (child or field == "body"):
                out[RENAMED.get(field, field)] = [self._json(c, depth + 1) if isinstance(c, ast.AST) else None for c in child]
            elif isinstance(child, NODES) and (field not in EVERY or self.full):
                out[RENAMED.get(field, field)] = self._json(child, depth + 1)
        return out

    def _arguments(self, args: ast.arguments, depth: int) -> dict:
        one = lambda a: {"arg": a.arg, "annotation": self._json(a.annotation, depth) if a.annotation else None}
        out = {k: [one(a) for a in found] for k in ("args", "posonlyargs", "kwonlyargs") if (found := getattr(args, k))}
        return out | {k: {"arg": found.arg} for k in ("vararg", "kwarg") if (found := getattr(args, k))}

    def _counts(self, node: ast.AST, outer: list[int]) -> None:
        kind = _type(node)
        if kind in FUNCTIONS:
            own = self.ids[id(node)]
            self.fact("function", node.name, node=node, n=own)
            for child in node.body:
                self._decisions(child, own)
        elif kind == "ClassDef":
            self.fact("count", label="class", n=1)
        elif kind in ("Import", "ImportFrom"):
            self.fact("count", label="import", n=len(node.names))
        for child in self.children(node, "counts"):
            self._counts(child, outer)

    def _decisions(self, node: ast.AST, function: int) -> None:
        if self.depth[id(node)] <= DEPTH and isinstance(node, ast.BoolOp):
            self.fact("decision", n=len(node.values) - 1, ids=[function])
        elif _type(node) in DECISIONS:
            self.fact("decision", n=1, ids=[function])
        for child in self.children(node, "complexity"):
            self._decisions(child, function)

    def _symbols(self, node: ast.AST, scope: str) -> None:
        kind = _type(node)
        if self.depth[id(node)] > DEPTH:
            return
        symbol = lambda name, label, scope=scope: self.fact("symbol", name, label, node, scope)
        if kind in FUNCTIONS:
            symbol(node.name, "function")
            for a in node.args.args:
                if a.arg not in ("self", "cls"):
                    symbol(a.arg, "parameter", node.name)
            scope = node.name
        elif kind == "ClassDef":
            symbol(node.name, "class")
            for base in node.bases:
                if name := getattr(base, "id", None) or getattr(base, "attr", None):
                    self.fact("edge", name, "inherits", node)
            scope = node.name
        elif kind in ("Import", "ImportFrom"):
            module = getattr(node, "module", None)
            for a in node.names:
                self.fact("edge", f"{module}.{a.name}" if module else a.name, "imports", node)
                if a.asname:
                    symbol(a.asname, "import_alias")
        elif kind in ("Assign", "AnnAssign"):
            for t in getattr(node, "targets", None) or [node.target]:
                if isinstance(t, ast.Name):
                    symbol(t.id, "variable")
        elif kind == "ExceptHandler" and node.name:
            symbol(node.name, "variable")
        for child in self.children(node, "symbols"):
            self._symbols(child, scope)

    @staticmethod
    def _bound(a: ast.alias) -> str:
        return (a.asname or a.name).split(".")[0]

    def _imports(self, node: ast.AST) -> None:
        if self.depth[id(node)] <= DEPTH and isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                if a.name != "*":
                    self.fact("import", self._bound(a), node=node)
        for child in self.children(node, "imports"):
            self._imports(child)

    def _definitions(self, node: ast.AST) -> None:
        kind = _type(node)
        if self.depth[id(node)] > DEPTH:
            return
        define = lambda name, label: self.fact("definition", name, label, node)
        if kind in FUNCTIONS:
            define(node.name, "function")
            for a in node.args.args:
                define(a.arg, "parameter")
        elif kind == "ClassDef":
            define(node.name, "class")
        elif kind in ("Import", "ImportFrom"):
            for a in node.names:
                if a.name != "*":
                    define(self._bound(a), "import")
        else:
            targets = node.targets if kind == "Assign" else [node.target] if kind in ("AnnAssign", "For") else []
            targets += [i.optional_vars for i in node.items] if self.full and kind in ("With", "AsyncWith") else []
            for t in targets:
                if isinstance(t, ast.Name):
                    define(t.id, "variable")
            if kind == "ExceptHandler" and node.name:
                define(node.name, "variable")
        for child in self.children(node, "definitions"):
            self._definitions(child)

    def _uses(self, node: ast.AST, uses: set[str]) -> None:
        if self.depth.get(id(node), DEPTH + 1) > DEPTH:
            return
        if isinstance(node, ast.Name):
            uses.add(node.id)
        for child in self.children(node, "uses"):
            self._uses(child, uses)

    def _shadowing(self, node: ast.AST, scope: int, above: list[int]) -> None:
        """A site is where a name is bound that may be bound in a scope above; a binding is what later sites may shadow."""
        kind = _type(node)
        if self.depth[id(node)] > DEPTH:
            return
        if kind in FUNCTIONS or kind == "ClassDef":
            own, outer = self.ids[id(node)], [*above, scope]
            for a in node.args.args if kind in FUNCTIONS else []:
                if a.arg not in ("self", "cls"):
                    self.fact("site", a.arg, "Parameter", node, ids=outer)
                    self.fact("binding", a.arg, node=node, ids=[own])
            for child in node.body:
                self._shadowing(child, own, outer)
            return
        if kind == "Assign":
            for t in node.targets:
                if isinstance(t, ast.Name) and not t.id.startswith("_"):
                    self.fact("site", t.id, "Variable", node, ids=above)
                    self.fact("binding", t.id, node=node, ids=[scope])
        for child in self.children(node, "definitions"):
            self._shadowing(child, scope, above)


def source_facts(source: bytes, full: bool = False) -> list[tuple]:
    """(fact, seq, name, label, line, col, scope, ids, n) of one source; of one that doesn't parse, an error alone."""
    try:
        return Tree(source, full).facts()
    except SyntaxError as e:
        return [("error", 0, e.msg or "Syntax error", "E0001", e.lineno or 1, e.offset or 1, None, None, None)]
    except Exception as e:  # any source must give a record
        return [("error", 0, str(e), "E9999", 1, 1, None, None, None)]


def _run(full: bool):
    schema = pa.schema([("object", pa.string()), ("fact", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("label", pa.string()), ("line", pa.int64()), ("col", pa.int64()), ("scope", pa.string()), ("ids", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for obj, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(obj, *r) for r in source_facts(text.encode("utf-8", "surrogatepass"), full)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def python_facts(files: DataFrame, full: bool = False) -> DataFrame:
    """FACTS of the distinct Python objects among files(object, lang_hint, text)."""
    sources = files.where("lang_hint = 'python' and text is not null").select("object", "text").dropDuplicates(["object"])
    return sources.mapInArrow(_run(full), FACTS)


def of_files(facts: DataFrame, files: DataFrame, fact: str) -> DataFrame:
    """The facts of one sort, for each path that has the object."""
    paths = files.where("lang_hint = 'python' and text is not null").select("shard_id", "path", "object")
    return paths.join(facts.where(F.col("fact") == fact).drop("fact"), "object")
