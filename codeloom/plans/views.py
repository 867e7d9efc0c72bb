"""Canonical views over the driver's tables, in Spark and as the SQL that its oracle prepends.

Each pair defines the same rows. ``with_views`` puts the definitions that a query names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".py", ".md", ".pyc", ".tar.gz", ".jar", "", ".js", ".so")
#: Languages by extension (fixed values).
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c", ".cs": "c_sharp"}
COMPONENT_STATUS = {"view": "healthy", "purchase": "healthy", "click": "degraded", "error": "unhealthy", "signup": "starting"}
TARGETS = {"signup": "starting", "view": "running", "click": "degraded", "error": "error", "purchase": "recovering"}
SUBSCRIPTIONS = [(1, 1, "click", 100, None), (2, 2, "purchase", 50, 100.0), (3, 3, "*", 10, None), (4, 4, "error", 100, None), (5, 5, "*", 100, 150.0), (6, 6, "view", 1, None)]
#: Legal status transitions (fixed values).
EDGES = {
    "initializing": ("starting", "error"),
    "starting": ("running", "error"),
    "running": ("degraded", "recovering", "stopping", "error", "maintenance"),
    "degraded": ("running", "recovering", "stopping", "error"),
    "recovering": ("running", "degraded", "error", "stopping"),
    "stopping": ("stopped", "error"),
    "stopped": ("starting",),
    "error": ("recovering", "stopped"),
    "maintenance": ("running", "stopping"),
}
CONFIG = [
    (1, "system.max_workers", "4"), (1, "system.timeout_seconds", "300"), (1, "storage.max_cache_size_mb", "1024"),
    (1, "api.port", "8000"), (1, "api.workers", "2"), (1, "logging.level", "INFO"), (1, "environment", "development"),
    (2, "system.max_workers", "8"), (2, "environment", "production"), (2, "api.port", "80"),
    (3, "system.max_workers", "64"), (3, "logging.level", "DEBUG"), (3, "agents.analyst.enabled", "true"),
    (4, "system.timeout_seconds", "10"), (4, "custom.flag", "on"),
]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _choose(column, pairs: dict):
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def ev(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def comp(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    return e.select("event_id", "ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name"), "event_type", "value", _choose(F.col("event_type"), COMPONENT_STATUS).alias("status"))


def st(spark: SparkSession, d: str) -> DataFrame:
    """State events: every event as one of the nine kinds, or of another; the SQL below says which."""
    e = ev(spark, d)
    i, k, r = F.col("event_id"), F.col("k"), F.col("event_id") % 23
    kind = (
        F.when(i % 2311 == 2310, "system.shutdown").when(r < 2, "component.registered").when(r == 2, "component.unregistered").when(r < 11, "component.heartbeat").when(r < 14, "component.error")
        .when(r < 16, "system.metric_updated").when(r == 16, "project.analysis_started").when(r < 20, "project.analysis_completed").when(r == 20, "project.analysis_failed").otherwise("user.click")
    )
    status = _choose(k % 6, {0: "healthy", 1: "degraded", 2: "unhealthy", 4: "bogus", 5: "starting"})
    return e.select(
        "event_id", "ts", kind.alias("event_type"), F.when(F.col("user_id") % 7 == 0, "indexer").otherwise(F.concat(F.lit("c"), F.col("user_id"))).alias("name"), status.alias("status"),
        F.when(k % 2 == 0, F.col("value")).alias("response_ms"), F.when(k % 5 == 0, F.create_map(F.concat(F.lit("f"), k % 3), k.cast("string"))).alias("details"), F.when(k % 4 != 0, F.concat(F.lit("e"), k)).alias("error"),
        (k > 50).alias("critical"), F.element_at(F.array(F.lit("graph_nodes"), F.lit("files_processed"), F.lit("no_such_metric")), (k % 3 + 1).cast("int")).alias("metric"), k.alias("value"),
        F.when(k % 4 > 0, k).alias("files"), (2 * k).alias("entities"),
    )


def tr(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select("event_id", "ts", "user_id", _choose(F.col("event_type"), TARGETS).alias("target"))


def subs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "sub_id int, seq int, event_type string, priority int, min_value double")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in EDGES.items() for b in bs], "old string, new string")


def cfg(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG, "layer int, key string, value string")


def files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, d, "documents").select(
        "doc_id", F.col("source").alias("dir"), F.concat(F.col("doc_id").cast("string"), ext).alias("name"),
        ext.alias("ext"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"), "lang",
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("workflow_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("start_time"),
        _choose(F.col("o_orderstatus"), {"F": "completed", "O": "running", "P": "paused"}).alias("status"), F.col("o_custkey").alias("created_by"),
    )


def steps(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (workflow, step); the required step is the one before, whether it exists or not."""
    # Flags are single letters; their numbers let the aggregation hash instead of sorting strings.
    one = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.char(F.min(F.ascii("l_returnflag"))).alias("rf"), F.char(F.max(F.ascii("l_linestatus"))).alias("ls"), F.max("l_shipdate").alias("end_time"), F.min("l_quantity").alias("quantity")
    )
    n = F.col("l_linenumber")
    return one.select(
        F.col("l_orderkey").alias("workflow_id"), n.alias("step"), F.when(n > 1, n - 1).alias("requires"),
        _choose(F.col("rf"), {"R": "failed", "A": "skipped", "N": "completed"}).alias("status"),
        (F.col("ls") == "F").alias("critical"), "end_time", "quantity",
    )


def chk(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("grp"), b.alias("balance"),
        F.when(b < 0, "unhealthy").when(b < 2000, "warning").otherwise("healthy").alias("status"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("critical"),
    )


def code(spark: SparkSession, d: str) -> DataFrame:
    """A source text for each part: an import, a class with one method, a function."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("from m"), k, F.lit(" import a"), k, F.lit(" as b"), k, F.lit("\n\n\nclass C"), k, F.lit("(Base):\n    def run(self, x):\n        return x\n\n\n@deco\ndef f"), k, F.lit("(a, b):\n    # note\n    return a\n"),
    )
    return read(spark, d, "part").select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), F.col("p_partkey").alias("part"), text.alias("content"))


def branchy(spark: SparkSession, d: str) -> DataFrame:
    """A source text for each part: a function with as many branches as its key asks for, that calls another."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("def h(x):\n    return x\n\n\ndef g"), k, F.lit("(x):\n"), F.repeat(F.lit("    if x and g:\n        x = h(x)\n"), (k % 9).cast("int")), F.lit("    return x\n"))
    return read(spark, d, "part").select(F.concat(F.lit("q"), k, F.lit(".py")).alias("path"), text.alias("content"))


NESTED = """class A:
    def run(self):
        import os{k}
        def inner(x):
            return x if x else 0
        class Local:
            def go(self):
                return outside{k}()
        return inner(1)


class B(A):
    def run(self):
        def inner():
            pass
        if self:
            pass


async def job():
    def step():
        return twice()


def twice():
    pass


def twice():
    pass
"""


def nested(spark: SparkSession, d: str) -> DataFrame:
    """A source text for each part: ``NESTED`` with the part's key."""
    k = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select(F.concat(F.lit("n"), k, F.lit(".py")).alias("path"), F.replace(F.lit(NESTED), F.lit("{k}"), k).alias("content"))


def _values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _case(column: str, pairs: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


SQL = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "comp": f"SELECT event_id, ts, 'c' || user_id AS name, event_type, value, {_case('event_type', COMPONENT_STATUS)} AS status FROM events",
    "tr": f"SELECT event_id, ts, user_id, {_case('event_type', TARGETS)} AS target FROM events",
    "st": """SELECT event_id, ts, CASE WHEN event_id % 2311 = 2310 THEN 'system.shutdown' WHEN event_id % 23 < 2 THEN 'component.registered' WHEN event_id % 23 = 2 THEN 'component.unregistered' WHEN event_id % 23 < 11 THEN 'component.heartbeat'
      WHEN event_id % 23 < 14 THEN 'component.error' WHEN event_id % 23 < 16 THEN 'system.metric_updated' WHEN event_id % 23 = 16 THEN 'project.analysis_started' WHEN event_id % 23 < 20 THEN 'project.analysis_completed'
      WHEN event_id % 23 = 20 THEN 'project.analysis_failed' ELSE 'user.click' END AS event_type, CASE WHEN user_id % 7 = 0 THEN 'indexer' ELSE 'c' || user_id END AS name,
      CASE k % 6 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unhealthy' WHEN 4 THEN 'bogus' WHEN 5 THEN 'starting' END AS status, CASE WHEN k % 2 = 0 THEN value END AS response_ms,
      CASE WHEN k % 5 = 0 THEN 'f' || (k % 3) END AS field, k, CASE WHEN k % 4 <> 0 THEN 'e' || k END AS error, k > 50 AS critical, CASE k % 3 WHEN 0 THEN 'graph_nodes' WHEN 1 THEN 'files_processed' ELSE 'no_such_metric' END AS metric,
      CASE WHEN k % 4 > 0 THEN k END AS files, 2 * k AS entities FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "subs": f"SELECT * FROM (VALUES {_values(SUBSCRIPTIONS)}) t(sub_id, seq, event_type, priority, min_value)",
    "edges": f"SELECT * FROM (VALUES {_values([(a, b) for a, bs in EDGES.items() for b in bs])}) t(old, new)",
    "cfg": f"SELECT * FROM (VALUES {_values(CONFIG)}) t(layer, key, value)",
    "files": "SELECT doc_id, source AS dir, doc_id || ext AS name, ext, strlen(text) AS size, text AS content, lang FROM (SELECT *, CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(EXTENSIONS))
    + " END AS ext FROM documents)",
    "runs": "SELECT o_orderkey AS workflow_id, o_orderpriority AS name, o_orderdate AS start_time, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' WHEN 'P' THEN 'paused' END AS status, o_custkey AS created_by FROM orders",
    "steps": "SELECT l_orderkey AS workflow_id, l_linenumber AS step, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS requires, CASE min(l_returnflag) WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' WHEN 'N' THEN 'completed' END AS status, max(l_linestatus) = 'F' AS critical, max(l_shipdate) AS end_time, min(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "chk": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS grp, c_acctbal AS balance, CASE WHEN c_acctbal < 0 THEN 'unhealthy' WHEN c_acctbal < 2000 THEN 'warning' ELSE 'healthy' END AS status, c_mktsegment IN ('BUILDING', 'MACHINERY') AS critical FROM customer",
}


def with_views(sql: str) -> str:
    """``sql`` after the views that it names (as whole words), as one statement."""
    used = [f"{k} AS ({v})" for k, v in SQL.items() if re.search(rf"\b(FROM|JOIN)\s+{k}\b", sql)]
    if not used:
        return sql
    head = re.match(r"\s*WITH (RECURSIVE )?", sql)
    rest = sql[head.end() :] if head else sql
    return f"WITH {head[1] or '' if head else ''}{', '.join(used)}{', ' if head else ' '}{rest}"


class Family:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = with_views(sql)
            return f

        return put
