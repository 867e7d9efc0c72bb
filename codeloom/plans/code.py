"""Entity queries over generated sources; the SQL is the generator's closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import clones
from codeloom.operators import entities as e
from codeloom.plans import views as v
from codeloom.plans.views import Family

family = Family()
ALL = """(SELECT 'p' || p_partkey || '.py' AS path, p_partkey AS part, 0 AS ord, 'import' AS type, 'a' || p_partkey AS name, 1 AS line_start, 1 AS line_end FROM part
UNION ALL SELECT 'p' || p_partkey || '.py', p_partkey, 1, 'class', 'C' || p_partkey, 4, 6 FROM part
UNION ALL SELECT 'p' || p_partkey || '.py', p_partkey, 2, 'function', 'f' || p_partkey, 10, 12 FROM part
UNION ALL SELECT 'p' || p_partkey || '.py', p_partkey, 3, 'function', 'run', 5, 6 FROM part)"""


def _entities(spark, d):
    return e.parsed(e.extract(v.code(spark, d), details=False))


@family.add(f"SELECT path, ord, type, name, line_start, line_end FROM {ALL}")
def extract_entities(spark, d):
    return _entities(spark, d).select("path", "ord", "type", "name", "line_start", "line_end")


@family.add("SELECT 'p' || p_partkey || '.py' AS path, 'C' || p_partkey AS name, 'Base' AS bases, 'run' AS methods FROM part")
def entity_classes(spark, d):
    own = _entities(spark, d).filter("type = 'class'")
    return own.select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("methods", ",").alias("methods"))


@family.add("SELECT 'p' || p_partkey || '.py' AS path, 'f' || p_partkey AS name, 'a,b' AS args, 'deco' AS decorators FROM part UNION ALL SELECT 'p' || p_partkey || '.py', 'run', 'self,x', '' FROM part")
def entity_functions(spark, d):
    own = _entities(spark, d).filter("type = 'function'")
    return own.select("path", "name", F.array_join("args", ",").alias("args"), F.array_join("decorators", ",").alias("decorators"))


@family.add("SELECT 'p' || p_partkey || '.py' AS path, 'a' || p_partkey AS name, 'm' || p_partkey AS module, 'b' || p_partkey AS alias FROM part")
def entity_imports(spark, d):
    return _entities(spark, d).filter("type = 'import'").select("path", "name", "module", "alias")


@family.add(f"SELECT path, name, line_end - line_start + 1 AS span FROM {ALL}")
def entity_spans(spark, d):
    return _entities(spark, d).select("path", "name", (F.coalesce("line_end", "line_start") - F.col("line_start") + 1).alias("span"))


@family.add(f"SELECT type, count(*) AS n FROM {ALL} GROUP BY type")
def entities_by_type(spark, d):
    return e.by_type(e.extract(v.code(spark, d), details=False))


@family.add(f"SELECT path, ord, name FROM {ALL} ORDER BY path, ord LIMIT 100")
def entities_top100(spark, d):
    return _entities(spark, d).orderBy("path", "ord").limit(100).select("path", "ord", "name")


@family.add("SELECT count(*) AS files, 4 * count(*) AS entities_found, 0 AS files_failed, count(*) AS n_class, 2 * count(*) AS n_function, count(*) AS n_import FROM part")
def analyze_project(spark, d):
    files = v.code(spark, d)
    return e.report(files, e.extract(files, details=False))


@family.add("SELECT 'm' || p_partkey AS module, 'p' || p_partkey || '.py' AS path, count(*) AS n FROM part GROUP BY ALL")
def dependency_map(spark, d):
    return _entities(spark, d).filter("type = 'import'").groupBy("module", "path").agg(F.count("*").alias("n"))


@family.add("SELECT 'p' || p_partkey || '.py' AS path, 13 AS n_lines, 5 AS blank_lines, 1 AS comment_lines, round(1 / 13, 6) AS comment_density, 1 AS n_class, 2 AS n_function, 1 AS n_import FROM part")
def source_metrics(spark, d):
    files = v.code(spark, d)
    return e.metrics(files, e.extract(files, details=False))


@family.add("SELECT 'q' || p_partkey || '.py' AS path, 'g' || p_partkey AS name, CAST(1 + 2 * (p_partkey % 9) AS INTEGER) AS complexity, CASE WHEN p_partkey % 9 > 0 THEN 'h' ELSE '' END AS calls FROM part UNION ALL SELECT 'q' || p_partkey || '.py', 'h', 1, '' FROM part")
def code_complexity(spark, d):
    own = e.parsed(e.extract(v.branchy(spark, d)))
    return own.select("path", "name", "complexity", F.array_join("calls", ",").alias("calls"))


@family.add("SELECT 'q' || p_partkey || '.py' AS path, 'g' || p_partkey AS name, 'complex' AS smell FROM part WHERE 1 + 2 * (p_partkey % 9) > 10")
def code_smells(spark, d):
    return e.smells(e.extract(v.branchy(spark, d)))


@family.add(
    "SELECT 'q' || p_partkey || '.py' AS src, 'CONTAINS' AS rel, 'q' || p_partkey || '.py::' || unnest(['h', 'g' || p_partkey]) AS dst FROM part UNION ALL SELECT 'q' || p_partkey || '.py::g' || p_partkey, 'CALLS', 'q' || p_partkey || '.py::h' FROM part WHERE p_partkey % 9 > 0"
)
def code_graph(spark, d):
    return e.graph(e.extract(v.branchy(spark, d)))[1]


@family.add(
    """WITH f AS (SELECT p_partkey AS k, 'n' || p_partkey || '.py' AS p FROM part)
SELECT p AS src, 'CONTAINS' AS rel, p || '::' || unnest(['A', 'B', 'A::run::inner', 'B::run::inner', 'job::step', 'twice', 'twice#2', 'A::run::Local']) AS dst FROM f
UNION ALL SELECT p || '::' || unnest(['A', 'B']), 'DEFINES', p || '::' || unnest(['A::run', 'B::run']) FROM f
UNION ALL SELECT p || '::A::run::Local', 'DEFINES', p || '::A::run::Local::go' FROM f
UNION ALL SELECT p, 'IMPORTS', p || '::import::os' || k FROM f
UNION ALL SELECT p || '::B', 'EXTENDS', p || '::A' FROM f
UNION ALL SELECT p || '::A::run', 'CALLS', unnest([p || '::A::run::inner', p || '::B::run::inner']) FROM f
UNION ALL SELECT p || '::job::step', 'CALLS', unnest([p || '::twice', p || '::twice#2']) FROM f
UNION ALL SELECT p || '::A::run::Local::go', 'CALLS', 'outside' || k FROM f"""
)
def code_graph_nested(spark, d):
    return e.graph(e.extract(v.nested(spark, d)))[1]


@family.add("SELECT name, complexity, count(*) AS n FROM (SELECT unnest(['run', 'run', 'inner', 'inner', 'go', 'step', 'twice', 'twice']) AS name, unnest([1, 2, 2, 1, 1, 1, 1, 1]) AS complexity FROM part) GROUP BY name, complexity")
def nested_complexity(spark, d):
    own = e.parsed(e.extract(v.nested(spark, d))).filter("type = 'function'")
    return own.groupBy("name", "complexity").agg(F.count("*").alias("n"))


@family.add(
    "SELECT rel, count(*) AS n FROM (SELECT unnest(['IMPORTS', 'CONTAINS', 'CONTAINS', 'DEFINES', 'EXTENDS']) AS rel FROM part) GROUP BY rel"
)
def code_graph_relationships(spark, d):
    return e.graph(e.extract(v.code(spark, d)))[1].groupBy("rel").agg(F.count("*").alias("n"))


@family.add("SELECT 'q' || p_partkey || '.py' AS path, 1 AS line_start, CAST(6 + 2 * (p_partkey % 9) AS INTEGER) AS line_end, count(*) OVER (PARTITION BY p_partkey % 9) AS copies FROM part")
def code_clones(spark, d):
    """Files that are the same but for names."""
    return clones.clones(v.branchy(spark, d)).select("path", "line_start", "line_end", "copies")


QUERIES, ORACLE_SQL = family.queries, family.oracle
