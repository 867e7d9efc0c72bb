"""Entities of source files: a table function over file contents."""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, ord int, type string, name string, line_start int, line_end int, "
    "bases array<string>, methods array<string>, args array<string>, decorators array<string>, module string, alias string, error string, parent string, scope string, ident string, owner string, owner_type string, complexity int, calls array<string>"
)
ARROW = pa.schema(
    [("path", pa.string()), ("ord", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]
    + [(n, pa.list_(pa.string())) for n in ("bases", "methods", "args", "decorators")]
    + [(n, pa.string()) for n in ("module", "alias", "error", "parent", "scope", "ident", "owner", "owner_type")]
    + [("complexity", pa.int32()), ("calls", pa.list_(pa.string()))]
)
#: Rows of one batch.
ROWS = 2000
#: Above these, a function is complex, or long.
COMPLEX, LONG = 10, 50
BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.match_case)
SCOPES = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


#: Where statements hold statements, in the order of their fields.
BODIES = ("body", "handlers", "orelse", "finalbody", "cases")


def _described(node: ast.AST, details: bool) -> list[dict]:
    """The entities that one syntax node stands for; most stand for none."""
    match node:
        case ast.ClassDef(name=name, bases=bases, body=body):
            methods = [x.name for x in body if type(x) is ast.FunctionDef]
            return [{"type": "class", "name": name, "bases": list(map(ast.unparse, bases)), "methods": methods}]
        case ast.FunctionDef(name=name, args=args, decorator_list=marks):
            known = {"type": "function", "name": name, "args": [a.arg for a in args.args], "decorators": list(map(ast.unparse, marks))}
            return [known | measures(node) if details else known]
        case ast.Import(names=names):
            return [{"type": "import", "name": n.name, "alias": n.asname} for n in names]
        case ast.ImportFrom(names=names, module=module):
            return [{"type": "import", "name": n.name, "alias": n.asname, "module": module} for n in names]
    return []


def measures(function: ast.AST) -> dict:
    """Of a function without the classes and functions within: its complexity and the names that it calls.

    Complexity is cyclomatic: one more than the branches, further operands of and / or counting each. Called names
    are sorted, each once; of attributes the last part.
    """
    branches, called, todo = 1, set(), list(ast.iter_child_nodes(function))
    while todo:
        x = todo.pop()
        if isinstance(x, SCOPES):
            continue
        branches += len(x.values) - 1 if isinstance(x, ast.BoolOp) else isinstance(x, BRANCHES)
        if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
            called.add(x.func.id if isinstance(x.func, ast.Name) else x.func.attr)
        todo += ast.iter_child_nodes(x)
    return {"complexity": branches, "calls": sorted(called)}


def _statements(tree: ast.AST) -> Iterator[tuple[ast.AST, tuple[str, ...], str, tuple[str, str] | None]]:
    """Statements, breadth first, with their scopes' names, their own and the nearest class or function with a row.

    A name defined again in the same scope is told apart by its number, from the second on. Expressions hold no
    statements and are left out. Coroutines are scopes, but have no rows.
    """
    seen: dict[tuple[str, ...], int] = {}
    todo: deque = deque([(tree, (), None)])
    while todo:
        node, scope, owner = todo.popleft()
        name = getattr(node, "name", "")
        if isinstance(node, SCOPES):
            seen[*scope, name] = n = seen.get((*scope, name), 0) + 1
            name = name if n == 1 else f"{name}#{n}"
        yield node, scope, name, owner
        if isinstance(node, SCOPES):
            scope = (*scope, name)
            if not isinstance(node, ast.AsyncFunctionDef):
                owner = ("::".join(scope), "class" if isinstance(node, ast.ClassDef) else "function")
        for field in BODIES:
            todo.extend((x, scope, owner) for x in getattr(node, field, ()))


def entities_of(path: str, content: str | None, details: bool = True) -> Iterator[dict]:
    """Rows in breadth-first order; a file that can't be parsed gives one row with its error."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError) as e:
        yield {"path": path, "ord": 0, "error": f"{path}: {type(e).__name__}"}
        return
    found = 0
    for node, scope, name, owner in _statements(tree):
        for row in _described(node, details):
            of, kind = owner or (None, None)
            own = f"import::{row['name']}" if row["type"] == "import" else "::".join((*scope, name))
            place = {"scope": "::".join(scope) or None, "parent": scope[-1].split("#")[0] if scope else None, "ident": own, "owner": of, "owner_type": kind}
            yield {"path": path, "ord": found, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, **place, **row}
            found += 1


def _extract(batches: Iterator[pa.RecordBatch], details: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = (r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in entities_of(p, c, details))
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in ARROW], schema=ARROW)


def spread(files: DataFrame) -> DataFrame:
    """``files`` (path, content) dealt over all cores: many small texts may be one split, and parsing one costs far more than moving it."""
    spark = files.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "content").repartition(parts, "path", "content")


def extract(files: DataFrame, enrich=lambda df: df, details: bool = True) -> DataFrame:
    """Entities (and errors) of the ``.py`` files among ``files`` (path, content); ``enrich`` is a hook.

    Without ``details``, complexity and calls are null and cost nothing.
    """
    python = spread(files.filter(F.col("path").endswith(".py")))
    return enrich(python.mapInArrow(partial(_extract, details=details), SCHEMA))


def parsed(entities: DataFrame) -> DataFrame:
    return entities.filter("error is null")


def failures(entities: DataFrame) -> DataFrame:
    return entities.filter("error is not null").select("path", "error")


def smells(entities: DataFrame) -> DataFrame:
    """path, name and smell of functions that are complex or long."""
    own = parsed(entities).filter("type = 'function'")
    lines = F.col("line_end") - F.col("line_start") + 1
    found = F.array_compact(F.array(F.when(F.col("complexity") > COMPLEX, "complex"), F.when(lines > LONG, "long")))
    return own.select("path", "name", F.explode(found).alias("smell"))


def graph(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, rel, dst) of entities: files, classes, functions and imports.

    An id is the path with all scopes around, so nodes of one name in other scopes are others. A class defines its methods; a
    file contains all other classes and functions in it, nested ones too, and imports what is imported anywhere in it. A call or
    a base class leads to the functions or classes of that name in the same file; where the file has none, to a node
    with the bare name, outside of all files. Every edge has its nodes. A null path is no file and gives nothing.
    """
    own = parsed(entities).filter("path is not null")
    rows = own.select("path", "owner", "owner_type", "name", "type", "bases", "calls", F.concat_ws("::", "path", "ident").alias("id"), F.initcap("type").alias("label"))
    method = (F.col("type") == "function") & F.coalesce(F.col("owner_type") == "class", F.lit(False))
    rel = F.when(F.col("type") == "import", "IMPORTS").when(method, "DEFINES").otherwise("CONTAINS")

    def end(rel, name, src=None, target=None):
        """One end of edges: who asks for a name of the file, or which node has it."""
        null = F.lit(None).cast("string")
        return F.struct(rel.alias("rel"), name.alias("name"), (null if src is None else src).alias("src"), (null if target is None else target).alias("target"))

    # Who asks and what is there meet by file, relationship and name; a node that is held asks for nothing, so its id is its name.
    held = end(rel, F.col("id"), F.when(method, F.concat_ws("::", "path", "owner")).otherwise(F.col("path")))
    there = F.when(F.col("type").isin("class", "function"), end(F.when(F.col("type") == "class", "EXTENDS").otherwise("CALLS"), F.col("name"), target=F.col("id")))
    calls = F.transform("calls", lambda x: end(F.lit("CALLS"), x, F.col("id")))
    bases = F.transform("bases", lambda x: end(F.lit("EXTENDS"), x, F.col("id")))
    every = F.flatten(F.array_compact(F.array(F.array_compact(F.array(held, there)), calls, bases)))
    ends = rows.select("path", F.explode(every).alias("e")).select("path", "e.*")
    met = ends.groupBy("path", "rel", "name").agg(F.collect_set("src").alias("src"), F.collect_set("target").alias("target")).filter(F.size("src") > 0)
    outside = F.size("target") == 0
    edges = met.select("rel", F.explode("src").alias("src"), F.when(outside, F.array("name")).otherwise(F.col("target")).alias("dst")).select("src", "rel", F.explode("dst").alias("dst"))
    label = F.when(F.col("rel") == "CALLS", "Function").otherwise("Class")
    others = met.filter(outside & F.col("rel").isin("CALLS", "EXTENDS")).select("name", label)
    files = own.select(F.col("path").alias("id"), F.lit("File").alias("label"))
    nodes = rows.select("id", "label").union(files).union(others).distinct()
    return nodes, edges


def by_type(entities: DataFrame) -> DataFrame:
    return parsed(entities).groupBy("type").agg(F.count("*").alias("n"))


def metrics(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each file its lines, blank and comment lines, the share of comments, and its entities by type."""
    lines = F.transform(F.split("content", "\n"), lambda x: F.trim(x))
    own = files.select("path", lines.alias("lines")).select(
        "path", F.size("lines").alias("n_lines"), F.size(F.filter("lines", lambda x: x == "")).alias("blank_lines"),
        F.size(F.filter("lines", lambda x: F.startswith(x, F.lit("#")))).alias("comment_lines"),
    )
    kinds = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("class", "function", "import")]
    # Files are small in the tables that they come from, so that their number looks small too: never broadcast them.
    counts = parsed(entities).groupBy("path").agg(*kinds).hint("merge")
    both = own.withColumn("comment_density", F.round(F.col("comment_lines") / F.col("n_lines"), 6)).join(counts, "path", "left")
    return both.na.fill(0, ["n_class", "n_function", "n_import"])


def report(files: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: totals of files, entities, failures and entities by type."""
    n = files.agg(F.count("*").alias("files"))
    kinds = ("class", "function", "import")
    e = entities.agg(
        F.count_if(F.col("error").isNull()).alias("entities_found"),
        F.count_if(F.col("error").isNotNull()).alias("files_failed"),
        *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds],
    )
    return n.crossJoin(e)
