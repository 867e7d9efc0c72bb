"""Code clones: syntax subtrees that occur again with other names.

Each file's tree is hashed bottom-up with names and literals abstracted, in one pass, and subtrees of at least ``LEAST`` nodes that are statements
or whole files give a row. Equal hashes are a class; a subtree whose parent row is repeated too is part of a larger clone and
is left out, so what remains are the maximal ones. Only hashes meet; counts are added up before they are shuffled.

Edge cases: files that can't be parsed, null and empty contents give nothing; very deep trees are walked without recursion. Repeated paths
are files of their own. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.entities import spread
from codeloom.runtime.scratch import Stored, cut, small

LEAST = 12
BROADCAST_ROWS = 100_000
SCHEMA = "path string, line_start int, line_end int, nodes int, hash long, parent long"
ARROW = pa.schema([("path", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("nodes", pa.int32()), ("hash", pa.int64()), ("parent", pa.int64())])


def _label(node: ast.AST) -> str:
    """What of a node isn't names: its kind, of literals their type."""
    return f"Constant {type(node.value).__name__}" if isinstance(node, ast.Constant) else type(node).__name__


def subtrees(content: str, least: int = LEAST) -> list[tuple[int, int, int, bytes, bytes | None]]:
    """(first line, last line, nodes, digest, digest of the nearest row above) of statements and the file."""
    # Some nodes, as of operators, are one object wherever they occur, so nodes go by their place.
    nodes, above = [ast.parse(content)], [-1]
    for k, node in enumerate(nodes):  # parents before children
        new = list(ast.iter_child_nodes(node))
        nodes += new
        above += [k] * len(new)
    sizes, parts, digest = [1] * len(nodes), [[] for _ in nodes], [b""] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        own = hashlib.blake2b(_label(nodes[k]).encode(), digest_size=8)
        for part in reversed(parts[k]):
            own.update(part)
        digest[k] = own.digest()
        if k:
            sizes[above[k]] += sizes[k]
            parts[above[k]].append(digest[k])
    rows, held = [], []
    for k, node in enumerate(nodes):
        mine = isinstance(node, (ast.stmt, ast.Module)) and sizes[k] >= least
        up = held[above[k]] if k else None
        held.append(digest[k] if mine else up)
        if mine:
            body = node.body if isinstance(node, ast.Module) else [node]
            first = min([body[0].lineno, *(d.lineno for d in getattr(body[0], "decorator_list", []))])
            rows.append((first, body[-1].end_lineno, sizes[k], digest[k], up))
    return rows


def _hashed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    number = lambda x: int.from_bytes(x, "little", signed=True) if x is not None else None
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                found = subtrees(content or "", least)
            except (SyntaxError, ValueError):
                continue
            rows += [dict(zip(ARROW.names, (path, a, e, n, number(h), number(up)))) for a, e, n, h, up in found]
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def clones(files: DataFrame, least: int = LEAST) -> DataFrame:
    """(path, line_start, line_end, nodes, hash, copies) of the maximal repeated subtrees of ``.py`` files (path, content)."""
    python = spread(files.filter(F.col("path").endswith(".py")))
    rows = Stored(python.mapInArrow(partial(_hashed, least=least), SCHEMA)).df  # read twice, parsed once
    counts = small(cut(rows.groupBy("hash").agg(F.count("*").alias("copies")).filter("copies > 1")), BROADCAST_ROWS)
    found = rows.join(counts, "hash")
    within = counts.select(F.col("hash").alias("parent"))  # keeps the hint
    return found.join(within, "parent", "left_anti").select("path", "line_start", "line_end", "nodes", "hash", "copies")
