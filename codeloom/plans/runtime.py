"""Event bus, health and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import bus
from codeloom.operators import health as h
from codeloom.operators import decay, state
from codeloom.plans import views as v
from codeloom.plans.views import Family

family = Family()
DELIVERED = """(SELECT e.event_id, e.ts, e.event_type, e.value, s.sub_id, s.seq, s.priority, FALSE AS is_wildcard FROM events e JOIN subs s ON e.event_type = s.event_type WHERE s.min_value IS NULL OR e.value > s.min_value
UNION ALL SELECT e.event_id, e.ts, e.event_type, e.value, s.sub_id, s.seq, s.priority, TRUE FROM events e JOIN subs s ON s.event_type = '*' WHERE s.min_value IS NULL OR e.value > s.min_value)"""


def _delivered(spark, d):
    return bus.dispatch(v.ev(spark, d), v.subs(spark))


def _as_of(spark, d):
    return v.ev(spark, d).agg(F.max("ts").alias("as_of"))


@family.add("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def bus_publish(spark, d):
    return v.ev(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@family.add("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def bus_fifo(spark, d):
    return bus.fifo(v.ev(spark, d)).select("event_id", "position")


@family.add("SELECT e.event_id, s.sub_id FROM events e JOIN subs s ON e.event_type = s.event_type WHERE s.min_value IS NULL OR e.value > s.min_value")
def bus_filter(spark, d):
    return _delivered(spark, d).filter(~F.col("is_wildcard")).select("event_id", "sub_id")


@family.add(f"SELECT event_id, sub_id FROM {DELIVERED}")
def bus_dispatch(spark, d):
    return _delivered(spark, d).select("event_id", "sub_id")


@family.add(f"SELECT event_id, sub_id, row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, is_wildcard, seq) AS position FROM {DELIVERED}")
def bus_dispatch_order(spark, d):
    return bus.delivery_order(_delivered(spark, d)).select("event_id", "sub_id", "position")


@family.add("SELECT sub_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY priority DESC, seq) AS position FROM subs")
def bus_subscriptions_sorted(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("priority"), "seq")
    return v.subs(spark).select("sub_id", "event_type", F.row_number().over(w).alias("position"))


@family.add("SELECT event_type, count(*) AS n FROM subs GROUP BY event_type")
def bus_subscription_counts(spark, d):
    return v.subs(spark).groupBy("event_type").agg(F.count("*").alias("n"))


@family.add("SELECT user_id AS sub_id, event_type, 50 AS priority FROM (SELECT DISTINCT user_id, event_type FROM events)")
def bus_subscribe_explode(spark, d):
    asked = v.ev(spark, d).groupBy(F.col("user_id").alias("sub_id")).agg(F.collect_set("event_type").alias("event_types")).withColumn("priority", F.lit(50))
    return bus.subscribe(asked)


@family.add("SELECT event_id, upper(event_type) AS event_type, value * 2 AS value FROM events WHERE event_type <> 'signup'")
def bus_middleware(spark, d):
    out = bus.through(
        v.ev(spark, d),
        lambda e: e.filter("event_type <> 'signup'"),
        lambda e: e.withColumn("value", F.col("value") * 2),
        lambda e: e.withColumn("event_type", F.upper("event_type")),
    )
    return out.select("event_id", "event_type", "value")


METRICS = f"SELECT (SELECT count(*) FROM events{{0}}) AS published, (SELECT count(*) FROM {DELIVERED} x{{0}}) AS processed, (SELECT count(*) FROM subs) AS subscriptions, (SELECT count(*) FROM subs WHERE event_type = '*') AS wildcards, (SELECT count(DISTINCT event_type) FROM events{{0}}) AS types"


def _metrics(events, spark):
    subs = v.subs(spark)
    published = events.agg(F.count("*").alias("published"), F.count_distinct("event_type").alias("types"))
    processed = bus.dispatch(events, subs).agg(F.count("*").alias("processed"))
    kept = subs.agg(F.count("*").alias("subscriptions"), F.count_if(F.col("event_type") == "*").alias("wildcards"))
    return published.crossJoin(processed).crossJoin(kept)


@family.add(METRICS.format(""))
def bus_metrics(spark, d):
    return _metrics(v.ev(spark, d), spark)


@family.add(METRICS.format(" WHERE ts > TIMESTAMP '2024-01-15'"))
def bus_metrics_since_reset(spark, d):
    return _metrics(v.ev(spark, d).filter(F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")), spark)


@family.add("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id ELSE sha256(CAST(event_id AS VARCHAR)) END AS correlation_id, CASE WHEN event_id % 2 = 0 THEN 100 ELSE 50 END AS priority FROM events")
def event_defaults(spark, d):
    i = F.col("event_id")
    given = F.when(i % 3 == 0, F.concat(F.lit("c"), i)).when(i % 3 == 1, "")
    e = v.ev(spark, d).select("event_id", given.alias("correlation_id"), F.when(i % 2 == 0, 100).alias("priority"))
    return bus.with_defaults(e)


@family.add("SELECT event_id, upper(event_type) AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'k' AS keys FROM events")
def event_to_record(spark, d):
    keys = F.array_join(F.map_keys(F.from_json("props", "map<string,string>")), ",")
    return v.ev(spark, d).select("event_id", F.upper("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), keys.alias("keys"))


@family.add("SELECT status, count(*) AS n FROM comp GROUP BY status")
def component_status_counts(spark, d):
    return v.comp(spark, d).groupBy("status").agg(F.count("*").alias("n"))


LATEST = "(SELECT name, arg_max(status, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS value, max(ts) AS last_active FROM comp GROUP BY name)"


@family.add(f"SELECT * FROM {LATEST}")
def component_latest(spark, d):
    return h.latest(v.comp(spark, d))


REPORTS = "(SELECT *, CASE WHEN k % 3 <> 0 THEN value END AS response_ms, CASE WHEN k % 5 = 0 THEN 'w' || k END AS warning, CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS field FROM (SELECT c.*, e.k FROM comp c JOIN ev e USING (event_id)))"


@family.add(
    f"SELECT s.name, s.status, s.response_ms, s.warning, s.error_count, coalesce(x.details, '') AS details FROM (SELECT name, arg_max(status, (ts, event_id)) AS status, arg_max(response_ms, (ts, event_id)) FILTER (response_ms IS NOT NULL) AS response_ms, arg_max(warning, (ts, event_id)) FILTER (warning IS NOT NULL) AS warning, count(*) FILTER (status = 'unhealthy' AND (healthy IS NULL OR (ts, event_id) > healthy)) AS error_count FROM (SELECT *, max(CASE WHEN status = 'healthy' THEN (ts, event_id) END) OVER (PARTITION BY name) AS healthy FROM {REPORTS}) GROUP BY name) s LEFT JOIN (SELECT name, string_agg(field || '=' || k, ',' ORDER BY field) AS details FROM (SELECT name, field, arg_max(k, (ts, event_id)) AS k FROM {REPORTS} WHERE field IS NOT NULL GROUP BY name, field) GROUP BY name) x ON x.name = s.name"
)
def component_state(spark, d):
    k = F.col("k")
    field = F.when(k % 4 == 0, "a").when(k % 4 == 1, "b")
    rows = v.comp(spark, d).join(v.ev(spark, d).select("event_id", "k"), "event_id").select(
        "name", "ts", "event_id", "status", F.when(k % 3 != 0, F.col("value")).alias("response_ms"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("w"), k))).alias("warnings"), F.when(field.isNotNull(), F.create_map(field, k.cast("string"))).alias("details"),
    )
    text = F.array_join(F.transform(F.map_entries("details"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return h.component_state(rows).select("name", "status", "response_ms", F.get("warnings", F.lit(0)).alias("warning"), "error_count", text.alias("details"))


@family.add("SELECT sub_id, string_agg(event_type, ',' ORDER BY event_type) AS event_type FROM (SELECT DISTINCT user_id AS sub_id, event_type FROM events) GROUP BY sub_id")
def bus_type_list(spark, d):
    asked = v.ev(spark, d).groupBy(F.col("user_id").alias("sub_id")).agg(F.sort_array(F.collect_set("event_type")).alias("event_types"))
    return bus.type_list(asked)


@family.add("SELECT count(*) AS components, count(*) FILTER (status <> 'pending') AS components_ready FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'pending' ELSE status END AS status FROM (SELECT id AS c_custkey, status FROM chk))")
def components_ready(spark, d):
    rows = v.chk(spark, d).select(F.when(F.col("id") % 4 == 0, "pending").otherwise(F.col("status")).alias("status"))
    return h.components_ready(rows)


@family.add(
    f"SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'degraded' OR last_active < (SELECT max(ts) FROM events) - INTERVAL 1 DAY) THEN 'degraded' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'healthy' END AS overall FROM {LATEST}"
)
def component_overall_health(spark, d):
    old = F.col("last_active") < F.col("as_of") - F.expr("INTERVAL '1' DAY")
    rows = h.latest(v.comp(spark, d)).crossJoin(F.broadcast(_as_of(spark, d)))
    return rows.agg(h.overall(F.col("status"), old).alias("overall"))


@family.add(
    f"SELECT CASE WHEN count(*) FILTER (status = 'unhealthy') * 2 > count(*) THEN 'error' WHEN bool_or(status IN ('unhealthy', 'degraded')) THEN 'degraded' ELSE 'running' END AS system_status FROM {LATEST}"
)
def system_status_rollup(spark, d):
    return h.latest(v.comp(spark, d)).agg(h.system_status(F.col("status")).alias("system_status"))


@family.add("SELECT n_name AS name, r_name AS depends_on FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND n_nationkey <> 3")
def component_unregister(spark, d):
    e = v.read(spark, d, "nation").join(v.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    gone = e.filter("n_nationkey = 3").select(F.col("n_name").alias("node")).union(spark.createDataFrame([("ASIA",)], "node string"))
    deps = e.select(F.col("n_name").alias("name"), F.col("r_name").alias("depends_on"))
    return deps.join(gone, deps["name"] == gone["node"], "left_anti").join(gone, deps["depends_on"] == gone["node"], "left_anti")


@family.add(f"SELECT count(*) AS components, count(*) FILTER (status = 'healthy') AS healthy, date_diff('second', (SELECT min(ts) FROM events), max(last_active)) // 86400 AS uptime_days FROM {LATEST}")
def state_summary(spark, d):
    first = v.ev(spark, d).agg(F.min("ts").alias("started"))
    seconds = F.unix_seconds(F.max("last_active").cast("timestamp")) - F.unix_seconds(F.max("started").cast("timestamp"))
    return h.latest(v.comp(spark, d)).crossJoin(F.broadcast(first)).agg(
        F.count("*").alias("components"), F.count_if(F.col("status") == "healthy").alias("healthy"), F.floor(seconds / 86400).alias("uptime_days")
    )


@family.add("SELECT name, max(ts) AS last_active FROM comp GROUP BY name")
def last_active(spark, d):
    return v.comp(spark, d).groupBy("name").agg(F.max("ts").alias("last_active"))


@family.add("SELECT name, max(ts) AS last_active FROM comp GROUP BY name HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stale_components(spark, d):
    return h.stale(v.comp(spark, d), _as_of(spark, d), 86400)


@family.add(
    "SELECT event_id, CAST(sum(CASE WHEN status = 'unhealthy' THEN 1 ELSE 0 END) OVER (PARTITION BY name, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS error_count FROM (SELECT *, sum(CASE WHEN status = 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM comp)"
)
def error_streak(spark, d):
    return h.streaks(v.comp(spark, d)).select("event_id", "error_count")


@family.add("SELECT event_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY name ORDER BY ts, event_id) AS previous FROM comp) WHERE previous <> status")
def status_changes(spark, d):
    return h.changes(v.comp(spark, d)).select("event_id", "previous", "status")


SUMMARY = "SELECT {0}count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'unhealthy') AS unhealthy, count(*) FILTER (status = 'error') AS errors, bool_or(critical AND status IN ('unhealthy', 'error')) AS critical_failed, round(count(*) FILTER (status = 'healthy') * 100 / count(*), 2) AS success_rate FROM chk{1}"


@family.add(SUMMARY.format("grp, ", " GROUP BY grp"))
def health_summary(spark, d):
    return h.check_summary(v.chk(spark, d), "grp")


@family.add("SELECT grp, CASE WHEN bool_or(status IN ('unhealthy', 'error')) THEN 'unhealthy' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS overall FROM chk GROUP BY grp")
def health_overall(spark, d):
    return v.chk(spark, d).groupBy("grp").agg(h.check_overall().alias("overall"))


@family.add("SELECT grp, CASE WHEN bool_or(critical AND status IN ('unhealthy', 'error')) THEN 'unhealthy' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS status, max(id) AS last_check, count(*) AS n FROM chk GROUP BY grp")
def health_status(spark, d):
    bad = F.bool_or(F.col("critical") & F.col("status").isin("unhealthy", "error"))
    status = F.when(bad, "unhealthy").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("healthy")
    return v.chk(spark, d).groupBy("grp").agg(status.alias("status"), F.max("id").alias("last_check"), F.count("*").alias("n"))


@family.add(
    "SELECT id, CASE status WHEN 'healthy' THEN '✅' WHEN 'warning' THEN '⚠️' WHEN 'unhealthy' THEN '❌' END || CASE WHEN critical THEN ' [CRITICAL]' ELSE '' END || ' ' || name || ': ' || status AS line, row_number() OVER (PARTITION BY grp ORDER BY critical DESC, name) AS position FROM chk"
)
def health_report_lines(spark, d):
    w = Window.partitionBy("grp").orderBy(F.desc("critical"), "name")
    return v.chk(spark, d).select("id", h.report_line().alias("line"), F.row_number().over(w).alias("position"))


@family.add("SELECT event_id, concat_ws(',', CASE WHEN k > 85 THEN 'cpu' END, CASE WHEN user_id > 85 THEN 'memory' END, CASE WHEN value > 90 THEN 'disk' END) AS warnings FROM ev")
def resource_warnings(spark, d):
    return v.ev(spark, d).select("event_id", h.resource_warnings(F.col("k"), F.col("user_id"), F.col("value")).alias("warnings"))


@family.add("SELECT grp, string_agg(name, ', ' ORDER BY name) AS failing FROM chk WHERE status = 'unhealthy' GROUP BY grp")
def listagg_missing(spark, d):
    bad = v.chk(spark, d).filter("status = 'unhealthy'")
    return bad.groupBy("grp").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("failing"))


@family.add(
    "WITH RECURSIVE o AS (SELECT user_id, target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM tr), w AS (SELECT DISTINCT user_id, 'initializing' AS status, 0 AS rejected, 0::BIGINT AS r FROM o UNION ALL SELECT w.user_id, CASE WHEN g.new IS NULL THEN w.status ELSE o.target END, w.rejected + CASE WHEN g.new IS NULL THEN 1 ELSE 0 END, o.r FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1 LEFT JOIN edges g ON g.old = w.status AND g.new = o.target) SELECT user_id, arg_max(status, r) AS final_status, CAST(max(rejected) AS BIGINT) AS rejected FROM w GROUP BY user_id"
)
def fsm_replay(spark, d):
    return h.replay(v.tr(spark, d), v.edges(spark))


@family.add("SELECT p.event_id, p.previous, p.target, g.new IS NOT NULL AS legal FROM (SELECT *, lag(target) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM tr) p LEFT JOIN edges g ON g.old = p.previous AND g.new = p.target WHERE p.previous IS NOT NULL")
def state_transition_legal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = v.tr(spark, d).withColumn("previous", F.lag("target").over(w)).filter("previous is not null")
    g = F.broadcast(v.edges(spark))
    out = pairs.join(g, (F.col("old") == F.col("previous")) & (F.col("new") == F.col("target")), "left")
    return out.select("event_id", "previous", "target", F.col("new").isNotNull().alias("legal"))


@family.add(
    "WITH c AS (SELECT 'm' || (user_id % 20) AS name, CASE WHEN event_type = 'signup' THEN 'set' ELSE 'add' END AS op, k AS amount, ts, event_id FROM ev WHERE event_type <> 'error'), l AS (SELECT name, max((ts, event_id)) AS at, arg_max(amount, (ts, event_id)) AS amount FROM c WHERE op = 'set' GROUP BY name) SELECT n.name, CAST(coalesce(l.amount, 0) + coalesce((SELECT sum(amount) FROM c WHERE c.name = n.name AND op = 'add' AND (l.at IS NULL OR (c.ts, c.event_id) > l.at)), 0) AS BIGINT) AS value FROM (SELECT DISTINCT name FROM c) n LEFT JOIN l ON l.name = n.name"
)
def metric_fold(spark, d):
    e = v.ev(spark, d)
    op = F.when(F.col("event_type") == "signup", "set").otherwise("add")
    amount = F.when(F.col("event_type") != "error", F.col("k"))
    return h.folded_metric(e.select(F.concat(F.lit("m"), F.col("user_id") % 20).alias("name"), op.alias("op"), amount.alias("amount"), "ts", "event_id"))


@family.add("SELECT count(*) FILTER (event_type = 'purchase') AS projects, CAST(coalesce(sum(k) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS files, count(*) FILTER (event_type = 'error') AS total_errors FROM ev")
def analysis_counters(spark, d):
    done = F.col("event_type") == "purchase"
    return v.ev(spark, d).agg(F.count_if(done).alias("projects"), F.coalesce(F.sum(F.when(done, F.col("k"))), F.lit(0)).alias("files"), F.count_if(F.col("event_type") == "error").alias("total_errors"))


@family.add("SELECT user_id, count(*) AS total_errors, count(*) FILTER (k > 50) AS critical_errors FROM ev WHERE event_type = 'error' GROUP BY user_id")
def error_counters(spark, d):
    return v.ev(spark, d).filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("total_errors"), F.count_if(F.col("k") > 50).alias("critical_errors"))


@family.add("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def history_last_n(spark, d):
    return v.ev(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "ts")


@family.add("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1")
def error_rate_5min(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    rate = F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6)
    out = v.ev(spark, d).groupBy(w.alias("w")).agg(F.count("*").alias("n"), rate.alias("error_rate"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "error_rate")


#: The events since each component's registration, with what they say of it.
SINCE = """own AS (SELECT event_id, ts, event_type, CASE WHEN event_type = 'project.analysis_started' THEN 'indexer' ELSE name END AS name, response_ms, field, k, error,
    CASE WHEN event_type = 'component.error' THEN 'unhealthy' WHEN event_type = 'component.heartbeat' AND status <> 'bogus' THEN status END AS said FROM st WHERE event_type LIKE 'component.%' OR event_type = 'project.analysis_started'),
  g AS (SELECT name, max((ts, event_id)) FILTER (event_type = 'component.unregistered') AS gone FROM own GROUP BY name),
  b AS (SELECT own.name, min((ts, event_id)) AS born FROM own JOIN g ON g.name = own.name WHERE event_type = 'component.registered' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY own.name),
  since AS (SELECT own.*, b.born, max(CASE WHEN said = 'healthy' THEN (ts, event_id) END) OVER (PARTITION BY own.name) AS healed FROM own JOIN b ON b.name = own.name AND (ts, event_id) >= b.born),
  f AS (SELECT name, field, arg_max(v, (ts, event_id)) AS v FROM (SELECT name, ts, event_id, CASE WHEN event_type = 'component.error' THEN 'last_error' ELSE field END AS field, CASE WHEN event_type = 'component.error' THEN coalesce(error, 'Unknown error') ELSE CAST(k AS VARCHAR) END AS v FROM since WHERE said IS NOT NULL) WHERE field IS NOT NULL GROUP BY name, field),
  m AS (SELECT name, string_agg(field || '=' || v, ',' ORDER BY field) AS details FROM f GROUP BY name),
  a AS (SELECT name, coalesce(arg_max(said, (ts, event_id)) FILTER (said IS NOT NULL), 'starting') AS status, coalesce(max((ts, event_id)) FILTER (said IS NOT NULL), min(born)) AS said_at,
    count(*) FILTER (said = 'unhealthy' AND (healed IS NULL OR (ts, event_id) > healed)) AS error_count, arg_max(response_ms, (ts, event_id)) FILTER (said IS NOT NULL AND event_type <> 'component.error' AND response_ms IS NOT NULL) AS response_ms,
    arg_max(coalesce(error, 'Unknown error'), (ts, event_id)) FILTER (event_type = 'component.error') AS warning, max(ts) AS last_active FROM since GROUP BY name)"""


@family.add(
    f"WITH {SINCE} SELECT a.name, CASE WHEN (SELECT max((ts, event_id)) FROM st WHERE event_type = 'system.shutdown') > a.said_at THEN 'stopped' ELSE a.status END AS status, a.error_count, a.response_ms, a.warning, coalesce(m.details, '') AS details, a.last_active FROM a LEFT JOIN m ON m.name = a.name"
)
def registered_components(spark, d):
    text = F.array_join(F.transform(F.map_entries("details"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return state.components(v.st(spark, d)).withColumn("details", text)


@family.add(
    "WITH c AS (SELECT ts, event_id, unnest(CASE event_type WHEN 'component.error' THEN [{'m': 'total_errors', 'o': 'add', 'x': 1}, {'m': CASE WHEN critical THEN 'critical_errors' END, 'o': 'add', 'x': 1}] WHEN 'project.analysis_failed' THEN [{'m': 'total_errors', 'o': 'add', 'x': 1}] WHEN 'project.analysis_completed' THEN [{'m': 'projects_analyzed', 'o': 'add', 'x': 1}, {'m': 'files_processed', 'o': 'add', 'x': files}, {'m': 'entities_extracted', 'o': 'add', 'x': entities}] WHEN 'system.metric_updated' THEN [{'m': metric, 'o': 'set', 'x': k}] END) AS c FROM st), "
    "l AS (SELECT c.m AS m, max((ts, event_id)) AS at, arg_max(c.x, (ts, event_id)) AS x FROM c WHERE c.o = 'set' GROUP BY c.m), "
    "s AS (SELECT c.c.m AS m, sum(c.c.x) AS x FROM c LEFT JOIN l ON l.m = c.c.m WHERE c.c.o = 'add' AND (l.at IS NULL OR (c.ts, c.event_id) > l.at) GROUP BY c.c.m) "
    f"SELECT n.name, CAST(coalesce(l.x, 0) + coalesce(s.x, 0) AS DOUBLE) AS value FROM (VALUES {', '.join(repr((m,)).replace(',)', ')') for m in state.METRICS)}) n(name) LEFT JOIN l ON l.m = n.name LEFT JOIN s ON s.m = n.name"
)
def state_counters(spark, d):
    return state.counters(v.st(spark, d))


HALF_LIFE = 5 * 86_400.0
SECONDS = "epoch_us(ts) / 1000000.0"


@family.add(
    f"WITH a AS (SELECT max(floor({SECONDS} / 86400)) AS last FROM events), w AS (SELECT event_type, value, exp(-ln(2) / {HALF_LIFE} * ((a.last + 1) * 86400 - {SECONDS})) AS w FROM events, a) SELECT event_type, count(*) AS n, round(sum(w), 6) AS weight, round(coalesce(sum(w * value), 0), 6) AS total FROM w GROUP BY event_type"
)
def decayed_sums(spark, d):
    """Events and values of each kind as of the last day's end, half as much every five days; of two states, merged."""
    e = v.ev(spark, d)
    halves = [decay.state(e.filter(F.col("event_id") % 2 == k), HALF_LIFE, "event_type") for k in (0, 1)]
    states = decay.merged(halves[0].union(halves[1]), "event_type")
    last = F.broadcast(states.agg(F.max("day").alias("last")))
    out = decay.read(states.crossJoin(last), HALF_LIFE, F.col("last"), "event_type")
    return out.select("event_type", "n", F.round("weight", 6).alias("weight"), F.round("total", 6).alias("total"))


@family.add(
    f"SELECT event_id, ts FROM events ORDER BY {SECONDS} * (ln(2) / {HALF_LIFE}) - ln(-ln(((event_id * 2654435761) % 4294967296 + 0.5) / 4294967296)) DESC, event_id LIMIT 100"
)
def decayed_sample(spark, d):
    return decay.sample(v.ev(spark, d), HALF_LIFE, 100).select("event_id", "ts")


QUERIES, ORACLE_SQL = family.queries, family.oracle
