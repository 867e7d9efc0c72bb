"""Command line: init, analyze PATH, query TEXT, status, health, --version."""

from __future__ import annotations

import argparse
import os
import sys

import codeloom


def _spark():
    from codeloom.session import session

    return session(master=os.environ.get("CODELOOM_MASTER", "local[*]"))


def analyze(path: str) -> list[dict]:
    """Scan, extract and report a source tree."""
    from pyspark.sql import functions as F

    from codeloom.operators import entities
    from codeloom.sources import source_tree

    spark = _spark()
    source_tree.register(spark)
    from codeloom.functions.scalars import decoded

    files = spark.read.format("source_tree").load(os.path.abspath(path))
    rows = files.filter("suffix = '.py'").select("path", decoded(F.col("content")).alias("content"))
    return [r.asDict() for r in entities.report(rows, entities.extract(rows)).collect()]


def query(text: str, documents: str) -> list[dict]:
    from codeloom.operators import search

    return [r.asDict() for r in search.keyword_top(_spark().read.parquet(documents), text, 10).collect()]


def health() -> list[dict]:
    from codeloom.runtime import sampler

    names = [c.split()[0] for c in sampler.CHECK_SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in sampler.sample()]


def table(rows: list[dict]) -> str:
    """Rows as aligned columns; one row as key and value lines."""
    if not rows:
        return "(no rows)"
    if len(rows) == 1:
        size = max(map(len, rows[0]))
        return "\n".join(f"{k:<{size}}  {v}" for k, v in rows[0].items())
    text = [[f"{v:.1f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
    heads = list(rows[0])
    sizes = [max(len(x[k]) for x in [heads, *text]) for k in range(len(heads))]
    return "\n".join("  ".join(f"{c:<{n}}" for c, n in zip(line, sizes)).rstrip() for line in [heads, *text])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--version", action="version", version=codeloom.__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "health"):
        sub.add_parser(name)
    sub.add_parser("analyze").add_argument("path")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--documents", required=True)
    a = p.parse_args(argv)
    if a.command == "analyze":
        if not os.path.isdir(a.path):
            print(f"not a directory: {a.path}", file=sys.stderr)
            return 1
        rows: list = analyze(a.path)
    elif a.command == "query":
        rows = query(a.text, a.documents)
    elif a.command == "health":
        rows = health()
    else:
        from codeloom.runtime.lifecycle import Engine

        engine = Engine()
        ready = engine.start()
        rows = [engine.state()]
        engine.stop()
        print(table(rows))
        return int(not ready)
    print(table(rows))
    return int(a.command == "health" and any(r["status"] == "unhealthy" and r["critical"] for r in rows))


if __name__ == "__main__":
    sys.exit(main())
