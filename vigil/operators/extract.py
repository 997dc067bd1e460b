"""Per-file fact extraction (X1-X8) as one row-parallel ``mapInArrow`` job.

Each source file is parsed with the standard-library ``ast`` module inside the
task that holds it; the syntax tree never leaves the task. The job emits one
long ``code_facts`` table; every count, edge weight, top-k and feature is then
computed by Spark operators on that table.

Fact kinds:

* ``file``   - one per source file; ``value`` is the parse error (null when parsed)
* ``error``  - ``"{path}: {message}"`` for a file that could not be parsed
* ``import`` - module name (and its root for dotted names)
* ``call``   - canonical call name; ``caller`` is the enclosing scope
* ``func``   - a def/async def; ``name`` is ``path:function``, ``caller`` the parent scope
* ``string`` - non-empty string literal in ``value``
* ``block``  - control block; ``name`` is its type, with ``branch_edges`` and ``nesting``
* ``snippet`` - for a sensitive call, the lines around it in ``value``; ``seq`` is that of the call

A file without content (unreadable, too large) gives only its ``error`` fact. Characters that
UTF-8 can't hold (lone surrogates) are replaced by ``?`` in names and values.

``seq`` is the pre-order visit number inside the file, so ``(path, seq)`` is
the visit order used for first-occurrence tie-breaks and snippet caps.
"""

from __future__ import annotations

import ast
import gc
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.predicates import sensitive_name
from ..session import saved

FACT_SCHEMA = ("package_id string, path string, seq int, kind string, name string, caller string, "
               "lineno int, branch_edges int, nesting int, value string")
FACT_COLUMNS = ["package_id", "path", "seq", "kind", "name", "caller", "lineno", "branch_edges", "nesting", "value"]
MODULE_SCOPE = "<module>"

_BRANCHES = {ast.If: 2, ast.For: 2, ast.AsyncFor: 2, ast.While: 2, ast.With: 1, ast.AsyncWith: 1}


#: Marks on the stack of the walk.
_SCOPE_ENDS, _BLOCK_ENDS = "scope", "block"


def _kinds(kind: type) -> Iterator[type]:
    yield kind
    for sub in kind.__subclasses__():
        yield from _kinds(sub)


#: Nodes without facts of their own or below them, and by kind of node the fields that may hold others, last first.
_LEAVES = {ast.Name, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias} | {
    k for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for k in _kinds(base)}
_FIELDS = {k: tuple(f for f in reversed(k._fields) if f not in ("ctx", "op", "ops", "type_comment")) for k in _kinds(ast.AST)}


def call_name(node: ast.AST) -> str:
    """Dotted name of a call target (X4): ``a.b.c``; calls and subscripts pass through."""
    attrs: list[str] = []
    while True:
        if isinstance(node, ast.Name):
            base = node.id
            break
        if isinstance(node, ast.Attribute):
            attrs.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            base = ""
            break
    attrs.reverse()
    return ".".join(([base] if base else []) + attrs)


def snippet_text(path: str, lines: list[str], lineno: int, radius: int = vocab.SNIPPET_RADIUS) -> str:
    """The lines around a call, after a line that names the place."""
    return "\n".join([f"# {path}:{lineno}", *lines[max(0, lineno - 1 - radius):lineno + radius]])


def clean(value: str | None) -> str | None:
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def file_facts(path: str, text: str) -> list[tuple]:
    """Facts of one file as tuples ``(seq, kind, name, caller, lineno, branch_edges, nesting, value)``.

    The walk is iterative, so deeply nested code cannot overflow the stack.
    Any parse failure yields a ``file`` row carrying the error plus an ``error`` row.
    """
    try:
        tree = ast.parse(text, filename=path)
    except Exception as exc:  # SyntaxError, ValueError (null bytes), RecursionError, MemoryError
        return [(0, "file", None, None, None, None, None, str(exc)),
                (1, "error", "parse", None, getattr(exc, "lineno", None), None, None, f"{path}: {exc}")]

    out: list[tuple] = [(0, "file", None, None, None, None, None, None)]
    seq = depth = 0
    lines: list[str] = []
    scope = [MODULE_SCOPE]
    stack: list = [tree]
    while stack:
        node = stack.pop()
        kind = type(node)
        if kind is str:
            if node == _SCOPE_ENDS:
                scope.pop()
            else:
                depth -= 1
            continue
        if kind is ast.Import:
            for alias in node.names:
                seq += 1
                out.append((seq, "import", alias.name, None, node.lineno, None, None, None))
                root = alias.name.split(".")[0]
                if root != alias.name:
                    seq += 1
                    out.append((seq, "import", root, None, node.lineno, None, None, None))
            continue
        if kind is ast.ImportFrom:
            if node.module:
                seq += 1
                out.append((seq, "import", node.module, None, node.lineno, None, None, None))
                root = node.module.split(".")[0]
                if root != node.module:
                    seq += 1
                    out.append((seq, "import", root, None, node.lineno, None, None, None))
            continue
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            scoped = f"{path}:{node.name}"
            seq += 1
            out.append((seq, "func", scoped, scope[-1], node.lineno, None, None, None))
            scope.append(scoped)
            stack.append(_SCOPE_ENDS)
        elif kind is ast.Call:
            name = call_name(node.func)
            if name:
                seq += 1
                line = max(1, node.lineno)
                out.append((seq, "call", name, scope[-1], line, None, None, None))
                if sensitive_name(name):
                    lines = lines or text.splitlines()
                    out.append((seq, "snippet", name, None, line, None, None, snippet_text(path, lines, line)))
        elif kind is ast.Constant:
            if isinstance(node.value, str) and node.value:
                seq += 1
                out.append((seq, "string", None, None, node.lineno, None, None, node.value))
            continue
        elif kind in _BRANCHES or kind is ast.Try:
            edges = max(2, len(node.handlers) + 1) if kind is ast.Try else _BRANCHES[kind]
            depth += 1
            seq += 1
            out.append((seq, "block", kind.__name__, None, node.lineno, edges, depth, None))
            stack.append(_BLOCK_ENDS)
        for field in _FIELDS[kind]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                stack += [x for x in reversed(value) if isinstance(x, ast.AST) and x.__class__ not in _LEAVES]
            elif isinstance(value, ast.AST) and value.__class__ not in _LEAVES:
                stack.append(value)
    return out


#: Facts are given back in chunks of about so many rows.
CHUNK_ROWS = 20_000


_NUMBERS = {"seq", "lineno", "branch_edges", "nesting"}
_TYPES = [pa.int32() if c in _NUMBERS else pa.string() for c in FACT_COLUMNS]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(FACT_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=FACT_COLUMNS)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    gc.disable()  # syntax trees hold no cycles: what there is to collect, once for each chunk
    try:
        for batch in batches:
            for pkg, path, text, error in zip(*(c.to_pylist() for c in batch.columns)):
                if error is not None or text is None:
                    facts = [(0, "error", "input", None, None, None, None, f"{path}: {error or 'no content'}")]
                else:
                    facts = file_facts(path, text)
                for seq, kind, name, caller, lineno, edges, nesting, value in facts:
                    rows.append((pkg, path, seq, kind, clean(name), clean(caller), lineno, edges, nesting, clean(value)))
                if len(rows) >= CHUNK_ROWS:
                    yield _batch(rows)
                    rows = []
                    gc.collect(1)
        yield _batch(rows)
    finally:
        gc.enable()


def extract_facts(source_units: DataFrame) -> DataFrame:
    """``source_units(package_id, path, text[, error])`` -> ``code_facts`` (one pass, no shuffle).

    Work is row-parallel: the input partitioning is kept, nothing is grouped. A row with an
    ``error``, or without text, is no parsed file: it gives one ``error`` fact. Keep the
    result (:func:`stored_facts`) when several operators read it.
    """
    units = source_units if "error" in source_units.columns else source_units.withColumn("error", F.lit(None).cast("string"))
    return units.select("package_id", "path", "text", "error").mapInArrow(_extract_batches, FACT_SCHEMA)


def stored_facts(facts: DataFrame, path: str | None = None) -> DataFrame:
    """The facts as a table by kind: an operator on one kind reads that kind's files, and of these the columns it names.

    Snippet texts, most of the bytes, are thus read by those alone who want snippets. With ``path``, added to those there.
    """
    return saved(facts, "facts", by="kind", path=path)


def fact_snippets(facts: DataFrame, cap: int | None = None, key: str = "package_id") -> DataFrame:
    """J3 + A8: ``(package_id, snippet_seq, path, lineno, text)`` of the snippets the extraction made.

    ``snippet_seq`` numbers the snippets of a file, so no window spans a package. With ``cap`` it
    numbers those of a package, of which the first ``cap`` stay (by path, then place); nothing is
    cut otherwise.
    """
    from pyspark.sql import Window

    rows = facts.where(F.col("kind") == "snippet").select(key, "path", "seq", "lineno", F.col("value").alias("text"))
    within = [key] if cap is not None else [key, "path"]
    out = rows.withColumn("snippet_seq", F.row_number().over(Window.partitionBy(*within).orderBy("path", "seq")))
    if cap is not None:
        out = out.where(F.col("snippet_seq") <= cap)
    return out.select(key, "snippet_seq", "path", "lineno", "text")
