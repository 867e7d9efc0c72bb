"""Graph statistics, search, routing and cache policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.runtime.scratch import small

BROADCAST_ROWS = 100_000

#: Allowed node types of each relationship (fixed values).
RELATIONSHIPS = {
    "CONTAINS": (("Project", "File"), ("File", "Class", "Function")),
    "DEFINES": (("Class",), ("Function", "Variable")),
    "CALLS": (("Function",), ("Function",)),
    "IMPORTS": (("File",), ("Import",)),
    "EXTENDS": (("Class",), ("Class",)),
    "IMPLEMENTS": (("Class",), ("Class",)),
}


def build_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and relationships by node label."""
    n = nodes.groupBy("label").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("label").agg(F.count("*").alias("relationships"))
    return n.join(e, "label", "left").select("label", "nodes", F.coalesce("relationships", F.lit(0)).alias("relationships"))


def schema_violations(edges: DataFrame) -> DataFrame:
    """Edges whose (type, relationship, type) isn't allowed."""
    rows = [(r, a, b) for r, (froms, tos) in RELATIONSHIPS.items() for a in froms for b in tos]
    allowed = edges.sparkSession.createDataFrame(rows, "rel string, src_type string, dst_type string")
    return edges.join(F.broadcast(allowed), ["rel", "src_type", "dst_type"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree by one aggregation of both ends; hubs are summed before the shuffle."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def two_hops(edges: DataFrame) -> DataFrame:
    second = edges.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    return edges.join(second, "dst").select("src", F.col("end").alias("dst")).distinct()


def keyword_top(docs: DataFrame, word: str, n: int) -> DataFrame:
    """The ``n`` documents with the most occurrences; a top-k, merged from each task's own."""
    hits = F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit(word), F.lit("")))) / len(word))
    return docs.filter(F.contains("text", F.lit(word))).select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(n)


def semantic_top(vectors: DataFrame, query: list[float], n: int) -> DataFrame:
    """Exact cosine top-k against one vector, folded inside the JVM; no vector leaves its task but the top."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform("embedding", lambda x: x.cast("double"))

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * float(sum(x * x for x in query) ** 0.5)
    scored = vectors.select("vec_id", (dot / norm).alias("s")).orderBy(F.desc("s"), "vec_id").limit(n)
    return scored.select("vec_id", F.round("s", 6).alias("similarity"))


def routed(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Requests with the enabled agents of their capability."""
    able = agents.filter("enabled").select("agent", "capability")
    return requests.join(small(able, BROADCAST_ROWS), "capability").select("event_id", "agent")


def lru(uses: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recently used keys of each user."""
    last = uses.groupBy("user_id", "key").agg(F.max("ts").alias("last_ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last_ts"), "key")
    return last.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")
