"""Workflow, graph and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import scalars as s
from codeloom.operators import graphs, reuse, search, textsearch, vectors
from codeloom.operators import workflow as w
from codeloom.plans import views as v
from codeloom.plans.views import Family

family = Family()
def _steps(spark, d):
    """Steps, and the results that exist: two of three workflows have results up to step 3."""
    steps = v.steps(spark, d)
    return steps, steps.filter("workflow_id % 3 <> 0 AND step <= 3")


def _requirements(spark, d):
    """A step needs the one before, and every third also the one before that; the first needs none."""
    n = F.col("l_linenumber")
    own = F.array_compact(F.array(F.when(n > 1, n - 1), F.when((n > 2) & (n % 3 == 0), n - 2)))
    rows = v.read(spark, d, "lineitem").select("l_orderkey", n.alias("n"), F.explode_outer(own).alias("k"))
    name = lambda c: F.concat(F.lit("w"), "l_orderkey", F.lit("-"), c)
    return rows.select(name("n").alias("node"), F.when(F.col("k").isNotNull(), name("k")).alias("requires"))


def _squares(spark, d):
    """Each part depends on one other: trees that lead into cycles, some longer than twenty."""
    t = v.read(spark, d, "part")
    k = F.col("p_partkey")
    n = F.broadcast(t.agg(F.count("*").alias("n")))
    return t.crossJoin(n).select(F.concat(F.lit("p"), k).alias("node"), F.concat(F.lit("p"), (k * k + 1) % F.col("n") + 1).alias("depends_on"))


def _halves(spark, d):
    k = F.col("p_partkey")
    t = v.read(spark, d, "part").filter(k > 1)
    return t.select(F.concat(F.lit("p"), k).alias("node"), F.concat(F.lit("p"), F.floor(k / 2).cast("long")).alias("depends_on"))


REQUIREMENTS = "(SELECT DISTINCT 'w' || l_orderkey || '-' || l_linenumber AS node, 'w' || l_orderkey || '-' || k AS requires FROM (SELECT l_orderkey, l_linenumber, unnest([l_linenumber - 1, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber - 2 END]) AS k FROM lineitem) WHERE k > 0)"
SQUARES = "(SELECT 'p' || p_partkey AS node, 'p' || ((p_partkey::HUGEINT * p_partkey + 1) % (SELECT count(*) FROM part) + 1) AS depends_on FROM part)"
LOOPS = f"g AS {SQUARES}, r AS (SELECT node AS root, depends_on AS node FROM g UNION SELECT r.root, g.depends_on FROM r JOIN g ON g.node = r.node)"
HALVES = "(SELECT 'p' || p_partkey AS node, 'p' || (p_partkey // 2) AS depends_on FROM part WHERE p_partkey > 1)"
RESULTS = "(SELECT * FROM steps WHERE workflow_id % 3 <> 0 AND step <= 3)"


@family.add("SELECT workflow_id, requires AS source, step AS target FROM steps WHERE requires IS NOT NULL")
def workflow_edges(spark, d):
    return v.steps(spark, d).filter("requires is not null").select("workflow_id", F.col("requires").alias("source"), F.col("step").alias("target"))


@family.add(
    f"WITH RECURSIVE e AS {REQUIREMENTS}, w(node, level) AS (SELECT node, 1 FROM (SELECT 'w' || l_orderkey || '-' || l_linenumber AS node FROM lineitem UNION SELECT requires FROM e) WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, w.level + 1 FROM w JOIN e ON e.requires = w.node) SELECT node, max(level) AS level FROM w GROUP BY node"
)
def workflow_levels(spark, d):
    return w.levels(spark, _requirements(spark, d))


@family.add(f"WITH RECURSIVE {LOOPS} SELECT root AS node FROM r WHERE root = node")
def workflow_has_cycle(spark, d):
    return graphs.strong_components(_squares(spark, d).toDF("src", "dst")).select("node")  # no paths are asked for


@family.add(
    f"WITH RECURSIVE {LOOPS}, c AS (SELECT root AS node FROM r WHERE root = node), p AS (SELECT g.node AS root, g.depends_on AS node, g.node || ' -> ' || g.depends_on AS path FROM g JOIN c USING (node) UNION ALL SELECT p.root, g.depends_on, p.path || ' -> ' || g.depends_on FROM p JOIN g ON g.node = p.node WHERE p.root <> p.node) SELECT root, path FROM p WHERE root = node"
)
def di_cycle_path(spark, d):
    return w.cycles(spark, _squares(spark, d))


@family.add(f"WITH RECURSIVE g AS {HALVES}, r AS (SELECT node AS root, depends_on AS node FROM g UNION SELECT r.root, g.depends_on FROM r JOIN g ON g.node = r.node) SELECT root, node FROM r")
def di_closure(spark, d):
    return w.closure(spark, _halves(spark, d))


@family.add(
    f"SELECT workflow_id, step FROM steps s WHERE NOT EXISTS (SELECT 1 FROM {RESULTS} r WHERE r.workflow_id = s.workflow_id AND r.step = s.step) AND (requires IS NULL OR EXISTS (SELECT 1 FROM {RESULTS} r WHERE r.workflow_id = s.workflow_id AND r.step = s.requires AND r.status IN ('completed', 'skipped')))"
)
def workflow_ready_steps(spark, d):
    return w.ready(*_steps(spark, d))


@family.add(f"SELECT workflow_id, step FROM steps EXCEPT ALL SELECT workflow_id, step FROM {RESULTS} WHERE status IN ('completed', 'skipped')")
def workflow_pending_steps(spark, d):
    return w.pending(*_steps(spark, d))


@family.add(
    f"SELECT s.workflow_id, s.step, s.requires, coalesce(CASE WHEN r.status = 'completed' THEN 'd' || r.step END, 'r' || CAST(r.quantity AS INTEGER)) AS input, r.step IS NULL AS error FROM steps s LEFT JOIN {RESULTS} r ON r.workflow_id = s.workflow_id AND r.step = s.requires WHERE s.requires IS NOT NULL"
)
def workflow_step_inputs(spark, d):
    steps, results = _steps(spark, d)
    data = F.when(F.col("status") == "completed", F.concat(F.lit("d"), F.col("step")))
    return w.inputs(steps, results.withColumn("data", data).withColumn("result", F.concat(F.lit("r"), F.col("quantity").cast("int"))))


@family.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def workflow_duplicate_steps(spark, d):
    return w.duplicate_steps(v.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@family.add("SELECT workflow_id, step, requires FROM steps s WHERE requires IS NOT NULL AND NOT EXISTS (SELECT 1 FROM steps r WHERE r.workflow_id = s.workflow_id AND r.step = s.requires)")
def workflow_unknown_requirement(spark, d):
    return w.unknown_requirements(v.steps(spark, d))


CONDITION = "CASE step % 3 WHEN 0 THEN 'on_success' WHEN 1 THEN 'on_failure' ELSE 'always' END"


@family.add(
    f"SELECT s.workflow_id, s.step, s.condition, CASE s.condition WHEN 'on_success' THEN coalesce(r.status = 'completed', TRUE) WHEN 'on_failure' THEN coalesce(r.status = 'failed', FALSE) ELSE TRUE END AS runs FROM (SELECT *, {CONDITION} AS condition FROM steps) s LEFT JOIN steps r ON r.workflow_id = s.workflow_id AND r.step = s.requires"
)
def workflow_conditions(spark, d):
    return w.conditions(v.steps(spark, d).withColumn("condition", F.expr(CONDITION)))


@family.add("SELECT workflow_id, CASE WHEN bool_or(status = 'failed' AND critical) THEN 'failed' ELSE 'completed' END AS final_status FROM steps GROUP BY workflow_id")
def workflow_final_status(spark, d):
    return v.steps(spark, d).groupBy("workflow_id").agg(w.final_status().alias("final_status"))


@family.add("SELECT workflow_id, string_agg(step, ',' ORDER BY step) AS done FROM steps WHERE status IN ('completed', 'skipped') GROUP BY workflow_id")
def workflow_completed_steps(spark, d):
    done = w.finished(v.steps(spark, d)).groupBy("workflow_id")
    return done.agg(F.array_join(F.sort_array(F.collect_list("step")).cast("array<string>"), ",").alias("done"))


@family.add("SELECT workflow_id, step, row_number() OVER (PARTITION BY workflow_id ORDER BY end_time, step) AS position FROM steps")
def workflow_execution_order(spark, d):
    order = Window.partitionBy("workflow_id").orderBy("end_time", "step")
    return v.steps(spark, d).select("workflow_id", "step", F.row_number().over(order).alias("position"))


@family.add("SELECT workflow_id, date_diff('second', start_time, max(end_time)) AS seconds FROM runs JOIN steps USING (workflow_id) GROUP BY workflow_id, start_time")
def workflow_duration(spark, d):
    last = v.steps(spark, d).groupBy("workflow_id").agg(F.max("end_time").alias("end_time"))
    both = v.runs(spark, d).join(last, "workflow_id")
    seconds = F.unix_seconds(F.col("end_time").cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))
    return both.select("workflow_id", seconds.alias("seconds"))


@family.add(
    "SELECT created_by, moment, CAST(sum(step) OVER (PARTITION BY created_by ORDER BY moment) AS BIGINT) AS running FROM (SELECT created_by, moment, sum(step) AS step FROM (SELECT created_by, start_time AS moment, 1 AS step FROM runs UNION ALL SELECT created_by, start_time + INTERVAL 30 DAY, -1 FROM runs) GROUP BY created_by, moment)"
)
def workflow_concurrency(spark, d):
    r = v.runs(spark, d).withColumn("end_time", F.col("start_time") + F.expr("INTERVAL '30' DAY"))
    return w.running_at(r, "created_by")


@family.add("SELECT workflow_id FROM runs WHERE status = 'running' AND date_diff('second', start_time, (SELECT max(start_time) FROM runs)) > 86400 * 365")
def workflow_stalled(spark, d):
    r = v.runs(spark, d)
    as_of = r.agg(F.max("start_time").alias("as_of"))
    open_ = r.filter("status = 'running'").crossJoin(F.broadcast(as_of))
    return open_.filter(F.col("start_time") < F.col("as_of") - F.expr("INTERVAL '365' DAY")).select("workflow_id")


@family.add("SELECT workflow_id, name FROM runs WHERE status IN ('running', 'paused')")
def workflow_active(spark, d):
    return v.runs(spark, d).filter(F.col("status").isin("running", "paused")).select("workflow_id", "name")


@family.add("SELECT (SELECT count(DISTINCT name) FROM runs) AS registered, (SELECT count(*) FROM runs WHERE status = 'running') AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM steps")
def workflow_metrics(spark, d):
    r = v.runs(spark, d).agg(F.count_distinct("name").alias("registered"), F.count_if(F.col("status") == "running").alias("active"))
    st = F.col("status")
    return r.crossJoin(v.steps(spark, d).agg(*[F.count_if(st == k).alias(k) for k in ("completed", "failed", "skipped")]))


@family.add("SELECT name, workflow_id, row_number() OVER (PARTITION BY name ORDER BY start_time, workflow_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start_time DESC, workflow_id DESC) AS r FROM runs) WHERE r <= 5")
def workflow_last_runs(spark, d):
    return w.last_runs(v.runs(spark, d), 5).select("name", "workflow_id", "position")


@family.add("SELECT name, workflow_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start_time DESC, workflow_id DESC) AS r FROM runs) WHERE r <= 100")
def workflow_history_retention(spark, d):
    return w.last_runs(v.runs(spark, d), 100).select("name", "workflow_id")


@family.add("SELECT workflow_id, name || '_' || left(sha256(CAST(workflow_id AS VARCHAR)), 8) AS run_id FROM runs")
def workflow_id(spark, d):
    return v.runs(spark, d).select("workflow_id", s.workflow_id(F.col("name"), F.col("workflow_id").cast("string")).alias("run_id"))


@family.add("SELECT event_id, value * (k % 5) * (k % 5 + 1) / 2 AS total_wait FROM ev")
def retry_backoff(spark, d):
    return v.ev(spark, d).select("event_id", s.retry_wait(F.col("value"), F.col("k") % 5).alias("total_wait"))


@family.add("SELECT l_orderkey, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS requires FROM lineitem GROUP BY l_orderkey")
def distinct_requirements(spark, d):
    g = v.read(spark, d, "lineitem").groupBy("l_orderkey")
    return g.agg(F.array_join(F.sort_array(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("requires"))


@family.add("SELECT 'Nation' AS label, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) AS relationships UNION ALL SELECT 'Customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def graph_build_stats(spark, d):
    return search.build_stats(*_graph(spark, d))


def _graph(spark, d):
    """Nodes (id, label) and CONTAINS edges (src, dst, label of dst)."""
    region, nation, customer = (v.read(spark, d, t) for t in ("region", "nation", "customer"))
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("label")).union(
        customer.select(F.concat(F.lit("c"), "c_custkey"), F.lit("Customer"))
    )
    e1 = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("Nation").alias("label"))
    e2 = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey"), F.lit("Customer"))
    return nodes, e1.union(e2)


@family.add("SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer WHERE c_acctbal < 0")
def graph_schema_check(spark, d):
    t = v.read(spark, d, "customer")
    kind = F.when(F.col("c_acctbal") < 0, "Variable").otherwise("Function")
    e = t.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("File").alias("src_type"), F.lit("CONTAINS").alias("rel"), kind.alias("dst_type"))
    return search.schema_violations(e).select("src", "dst")


@family.add("SELECT DISTINCT 'r' || n_regionkey AS root, 'c' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_neighbors(spark, d):
    return search.two_hops(_graph(spark, d)[1]).select(F.col("src").alias("root"), F.col("dst").alias("node"))


@family.add("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT 'n' || c_nationkey AS id, 1 AS o, 0 AS i FROM customer UNION ALL SELECT 'c' || c_custkey, 0, 1 FROM customer UNION ALL SELECT 'r' || n_regionkey, 1, 0 FROM nation UNION ALL SELECT 'n' || n_nationkey, 0, 1 FROM nation) GROUP BY id")
def graph_degree(spark, d):
    return search.degrees(_graph(spark, d)[1])


@family.add("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents WHERE contains(text, 'the') ORDER BY hits DESC, doc_id LIMIT 20")
def query_knowledge(spark, d):
    return search.keyword_top(v.read(spark, d, "documents"), "the", 20)


@family.add(
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10"
)
def semantic_topk(spark, d):
    t = v.read(spark, d, "embeddings")
    q = t.filter("vec_id = 0").select("embedding").first()[0]
    return search.semantic_top(t, q, 10)


def _trade(spark, d):
    """Who ordered which part of whom, who supplies it, and where they live, as edges with types."""
    item, order = v.read(spark, d, "lineitem"), v.read(spark, d, "orders")
    bought = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("c"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    edge = lambda df, a, rel, b: df.select(F.col(a).alias("src"), F.lit(rel).alias("rel"), F.col(b).alias("dst"))
    lives = v.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("x"), F.concat(F.lit("n"), "c_nationkey").alias("n"))
    lives = lives.union(v.read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    parts = [edge(bought, "c", "BOUGHT_OF", "s"), edge(bought, "c", "ORDERED", "p"), edge(bought, "s", "SUPPLIES", "p"), edge(lives, "x", "LIVES_IN", "n")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


TRADE = "t AS (SELECT DISTINCT 'c' || o_custkey AS c, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey), lc AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n FROM customer), ls AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n FROM supplier)"


@family.add(f"WITH {TRADE} SELECT a.c, a.s, lc.n FROM (SELECT DISTINCT c, s FROM t) a JOIN lc ON lc.c = a.c JOIN ls ON ls.s = a.s AND ls.n = lc.n")
def graph_triangles(spark, d):
    """Customers and suppliers of one nation who trade with each other."""
    return graphs.match(_trade(spark, d), [("c", "BOUGHT_OF", "s"), ("c", "LIVES_IN", "n"), ("s", "LIVES_IN", "n")])


@family.add(f"WITH {TRADE} SELECT a.c, a.p, b.s, lc.n FROM (SELECT DISTINCT c, p FROM t) a JOIN (SELECT DISTINCT s, p FROM t) b ON b.p = a.p JOIN lc ON lc.c = a.c JOIN ls ON ls.s = b.s AND ls.n = lc.n")
def graph_squares(spark, d):
    """Parts that a customer ordered and that a supplier of the same nation has: a ring of four edges."""
    return graphs.match(_trade(spark, d), [("c", "ORDERED", "p"), ("s", "SUPPLIES", "p"), ("c", "LIVES_IN", "n"), ("s", "LIVES_IN", "n")])


def _web(spark, d):
    """Parts that point to one or two others."""
    t = v.read(spark, d, "part")
    k, n = F.col("p_partkey"), F.broadcast(t.agg(F.count("*").alias("n")))
    rows = t.crossJoin(n).select(k.alias("k"), "n")
    one = rows.select(F.concat(F.lit("p"), "k").alias("src"), F.concat(F.lit("p"), (F.col("k") * F.col("k") + 1) % F.col("n") + 1).alias("dst"))
    two = rows.filter("k % 4 = 0").select(F.concat(F.lit("p"), "k"), F.concat(F.lit("p"), (F.col("k") * 3 + 7) % F.col("n") + 1))
    return one.union(two)


WEB = "g AS (SELECT 'p' || p_partkey AS src, 'p' || ((p_partkey::HUGEINT * p_partkey + 1) % (SELECT count(*) FROM part) + 1) AS dst FROM part UNION SELECT 'p' || p_partkey, 'p' || ((p_partkey::HUGEINT * 3 + 7) % (SELECT count(*) FROM part) + 1) FROM part WHERE p_partkey % 4 = 0)"
RANKS = ", ".join(
    f"r{k} AS MATERIALIZED (SELECT v.node, v.o, 0.15 / v.n + 0.85 * (coalesce(i.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE o = 0) / v.n) AS rank FROM v LEFT JOIN (SELECT g.dst, sum(r.rank / r.o) AS x FROM g JOIN r{k - 1} r ON r.node = g.src GROUP BY g.dst) i ON i.dst = v.node)"
    for k in range(1, 13)
)


@family.add(
    f"WITH {WEB}, w AS (SELECT node, sum(o) AS o FROM (SELECT src AS node, 1 AS o FROM g UNION ALL SELECT dst, 0 FROM g) GROUP BY node), v AS (SELECT node, o, (SELECT count(*) FROM w)::DOUBLE AS n FROM w), r0 AS (SELECT node, o, 1 / n AS rank FROM v), {RANKS} SELECT node, round(rank, 12) AS rank, 12 AS rounds FROM r12"
)
def graph_rank(spark, d):
    return graphs.rank(_web(spark, d), rounds=12, tolerance=0).select("node", F.round("rank", 12).alias("rank"), "rounds")


@family.add(f"WITH RECURSIVE {WEB}, r AS (SELECT src AS root, dst AS node FROM g UNION SELECT r.root, g.dst FROM r JOIN g ON g.src = r.node) SELECT a.root AS node, min(a.node) AS component FROM r a JOIN r b ON b.root = a.node AND b.node = a.root GROUP BY a.root")
def strong_components(spark, d):
    return graphs.strong_components(_web(spark, d))


@family.add(
    f"WITH RECURSIVE {LOOPS}, c AS (SELECT a.root, min(a.node) AS component FROM r a JOIN r b ON b.root = a.node AND b.node = a.root GROUP BY a.root), p AS (SELECT component, 0::BIGINT AS position, component AS node FROM c WHERE root = component UNION ALL SELECT p.component, p.position + 1, g.depends_on FROM p JOIN g ON g.node = p.node WHERE g.depends_on <> p.component) SELECT * FROM p"
)
def component_cycles(spark, d):
    return graphs.component_cycles(_squares(spark, d).toDF("src", "dst"))


WORDS = ["the", "und", "license", "token", "stupid"]
BM25 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
  a AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM d), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d),
  f AS (SELECT doc_id, length, term, count(*) AS tf FROM t WHERE term IN ({", ".join(f"'{w}'" for w in WORDS)}) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (a.n - g.df + 0.5) / (g.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.length / a.average))), 6) AS score FROM f JOIN g ON g.term = f.term, a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@family.add(BM25)
def text_search(spark, d):
    """The 20 best documents for a few words, by the index."""
    return textsearch.Index(v.read(spark, d, "documents"), block=64).search(WORDS)[0]


NEAREST = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS similarity FROM embeddings v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10"


def _asked(spark, d):
    """All vectors, and those with ids divisible by 100 as queries."""
    rows = vectors.usable(v.read(spark, d, "embeddings"))
    return rows, rows.filter("id % 100 = 0")


@family.add(NEAREST)
def vector_neighbors_exact(spark, d):
    return vectors.exact(*_asked(spark, d))


@family.add(NEAREST)
def vector_neighbors(spark, d):
    return vectors.neighbors(*_asked(spark, d))


@family.add("SELECT 10 * count(*) AS neighbors, TRUE AS found FROM embeddings WHERE vec_id % 100 = 0")
def vector_recall(spark, d):
    """Whether the index finds 95 % of the nearest neighbours."""
    rows = _asked(spark, d)
    return vectors.recall(vectors.neighbors(*rows), vectors.exact(*rows)).select("neighbors", (F.col("recall") >= 0.95).alias("found"))


AGENTS = [("analyst", True, "code_metrics"), ("analyst", True, "complexity_analysis"), ("architect", False, "design_patterns"), ("security", False, "vulnerability_scan")]


@family.add(f"SELECT e.event_id, a.agent FROM (SELECT event_id, CASE k % 4 WHEN 0 THEN 'code_metrics' WHEN 1 THEN 'complexity_analysis' WHEN 2 THEN 'design_patterns' ELSE 'unknown' END AS capability FROM ev) e JOIN (VALUES {v._values(AGENTS)}) a(agent, enabled, capability) ON a.capability = e.capability AND a.enabled")
def agent_routing(spark, d):
    wanted = F.get(F.array(*[F.lit(x) for x in ("code_metrics", "complexity_analysis", "design_patterns", "unknown")]), (F.col("k") % 4).cast("int"))
    agents = spark.createDataFrame(AGENTS, "agent string, enabled boolean, capability string")
    return search.routed(v.ev(spark, d).select("event_id", wanted.alias("capability")), agents)


@family.add("SELECT user_id, key, last_ts FROM (SELECT user_id, k % 20 AS key, max(ts) AS last_ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, k % 20) AS r FROM ev GROUP BY user_id, k % 20) WHERE r <= 3")
def lru_keep(spark, d):
    uses = v.ev(spark, d).select("user_id", (F.col("k") % 20).alias("key"), "ts")
    return search.lru(uses, 3)


@family.add(
    "WITH a AS (SELECT event_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), b AS (SELECT *, lag(i) OVER (PARTITION BY user_id, k ORDER BY i) AS p FROM a), d AS (SELECT b.event_id, count(DISTINCT a.k) AS n FROM b JOIN a ON a.user_id = b.user_id AND a.i > b.p AND a.i < b.i GROUP BY b.event_id) SELECT b.event_id, CASE WHEN b.p IS NOT NULL THEN coalesce(d.n, 0) END AS distance, CASE WHEN b.p IS NULL OR d.n >= 24 THEN 3 WHEN d.n >= 8 THEN 2 ELSE 1 END AS tier FROM b LEFT JOIN d ON d.event_id = b.event_id"
)
def reuse_tiers(spark, d):
    """In which of three tiers each user's access is found, with 8 and 16 entries in the first two."""
    found = reuse.distances(v.ev(spark, d).select(F.col("user_id").alias("log"), "ts", "event_id", F.col("k").alias("key")))
    return reuse.tiers(found, 8, 16).select("event_id", "distance", "tier")


QUERIES, ORACLE_SQL = family.queries, family.oracle
