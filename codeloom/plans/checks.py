"""Validation, error and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators import configuration as conf
from codeloom.operators import validate as c
from codeloom.plans import views as v
from codeloom.plans.views import Family

family = Family()


def _failing(df, key, check):
    """key, field and code of the rows that fail ``check``."""
    return df.select(F.col(key).alias("id"), check.alias("e")).filter("e is not null").select("id", "e.field", "e.code")


def _codes(where: str, table: str, key: str, field: str, code: str) -> str:
    return f"SELECT {key} AS id, '{field}' AS field, '{code}' AS code FROM {table} WHERE {where}"


@family.add(_codes("conv_id % 5 = 0 OR trim(text, e' \\n\\t\\r\\x0b\\x0c') = ''", "conversations", "conv_id", "text", "empty"))
def validate_not_empty(spark, d):
    blank = F.get(F.array(*[F.lit(x) for x in (" ", " \n\t", "\t", "\u00a0", "")]), (F.floor(F.col("conv_id") / 5) % 5).cast("int"))
    t = v.read(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 5 == 0, blank).otherwise(F.col("text")))
    return _failing(t, "conv_id", c.not_empty(F.col("text"), "text"))


@family.add("SELECT o_custkey AS path, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'not_a_file' END AS code FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_custkey % 3 = 0")
def validate_path_kind(spark, d):
    paths = v.read(spark, d, "orders").select(F.col("o_custkey").alias("path")).distinct()
    listing = v.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 3 == 0).alias("is_dir"))
    return c.path_state(paths, listing, must_be_file=True)


@family.add(_codes("TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL OR event_id % 5 = 0", "events", "event_id", "k", "type"))
def validate_type(spark, d):
    k = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    return _failing(v.read(spark, d, "events"), "event_id", c.of_type(k, "k", "int"))


@family.add(_codes("length(text) NOT BETWEEN 100 AND 2000", "documents", "doc_id", "text", "length"))
def validate_length(spark, d):
    return _failing(v.read(spark, d, "documents"), "doc_id", c.length(F.col("text"), "text", 100, 2000))


@family.add(_codes("c_acctbal NOT BETWEEN 0 AND 9000", "customer", "c_custkey", "c_acctbal", "range"))
def validate_range(spark, d):
    return _failing(v.read(spark, d, "customer"), "c_custkey", c.in_range(F.col("c_acctbal"), "c_acctbal", 0, 9000))


@family.add("SELECT c_custkey AS id, c_custkey % 3 <> 0 AS ok, 'cust.' || c_custkey || '@example' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.com' END AS email FROM customer")
def validate_email(spark, d):
    raw = F.concat(F.lit(" cust."), F.col("c_custkey"), F.lit("@EXAMPLE"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".Com"))
    mail = c.email_normalised(raw)
    return v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), c.email(mail, "email").isNull().alias("ok"), mail.alias("email"))


@family.add("SELECT DISTINCT o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def validate_path(spark, d):
    paths = v.read(spark, d, "orders").select(F.col("o_custkey").alias("path")).distinct()
    listing = v.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("path"))
    return c.paths_missing(paths, listing)


@family.add(_codes("NOT regexp_matches(p_name, '^(red|small) ')", "part", "p_partkey", "p_name", "regex"))
def validate_regex(spark, d):
    return _failing(v.read(spark, d, "part"), "p_partkey", c.regex(F.col("p_name"), "p_name", "(RED|SMALL) ", "i"))


@family.add(_codes("event_id % 4 = 0", "events", "event_id", "props", "json"))
def validate_json(spark, d):
    p = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), F.col("props"))).otherwise(F.col("props"))
    return _failing(v.read(spark, d, "events"), "event_id", c.json_value(p, "props"))


@family.add("SELECT event_id AS id, 'props.' || CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'k' END AS field, CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'type' END AS code FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1")
def validate_structure(spark, d):
    p = F.when(F.col("event_id") % 3 == 1, F.lit('{"k": "word"}')).otherwise(F.col("props"))
    e = v.read(spark, d, "events")
    check = F.when(F.col("event_id") % 3 == 0, c.json_key(p, "props", "missing", "int")).otherwise(c.json_key(p, "props", "k", "int"))
    return _failing(e, "event_id", check)


@family.add(
    "SELECT c_custkey AS id, CAST((CASE WHEN length(c_name) NOT BETWEEN 1 AND 17 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) + (CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-L]') THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM customer WHERE length(c_name) NOT BETWEEN 1 AND 17 OR c_acctbal < 0 OR NOT regexp_matches(c_mktsegment, '^[A-L]')"
)
def validate_model(spark, d):
    t = v.read(spark, d, "customer")
    checks = (
        c.length(F.col("c_name"), "c_name", 1, 17),
        c.in_range(F.col("c_acctbal"), "c_acctbal", 0, 1e300),
        c.regex(F.col("c_mktsegment"), "c_mktsegment", "[A-L]"),
    )
    return c.quarantine(t, *checks)[1].select(F.col("c_custkey").alias("id"), F.size("errors").cast("long").alias("n_errors"))


@family.add(_codes("event_id % 6 = 0", "events", "event_id", "value", "null"))
def validate_not_null(spark, d):
    return _failing(v.read(spark, d, "events"), "event_id", c.not_null(F.when(F.col("event_id") % 6 != 0, F.col("value")), "value"))


@family.add("SELECT event_id, '[' || upper(event_type) || '] user ' || user_id || CASE WHEN value > 20 THEN ' | Causa: ValueError: ' || k ELSE '' END AS message FROM ev")
def error_message(spark, d):
    text = F.concat(F.lit("user "), F.col("user_id"))
    cause = F.when(F.col("value") > 20, "ValueError")
    return v.ev(spark, d).select("event_id", s.error_message(F.upper("event_type"), text, cause, F.col("k").cast("string")).alias("message"))


@family.add("SELECT event_id, CAST((CASE WHEN value > 20 THEN 1 ELSE 0 END) + (CASE WHEN k > 50 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS n_details, CASE WHEN k > 50 THEN 'k,type' || CASE WHEN value > 20 THEN ',value' ELSE '' END ELSE 'type' || CASE WHEN value > 20 THEN ',value' ELSE '' END END AS keys FROM ev")
def error_details(spark, d):
    e = v.ev(spark, d)
    given = {"type": F.col("event_type"), "value": F.when(F.col("value") > 20, F.col("value").cast("string")), "k": F.when(F.col("k") > 50, F.col("k").cast("string"))}
    m = conf.details(given)
    return e.select("event_id", F.size(m).cast("long").alias("n_details"), F.array_join(F.sort_array(F.map_keys(m)), ",").alias("keys"))


SEVERITY = {"error": "high", "purchase": "critical", "click": "low"}
CASE = "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'critical' WHEN 'click' THEN 'low' ELSE 'medium' END"


@family.add(f"SELECT {CASE} AS severity, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1")
def error_severity_rollup(spark, d):
    return v.ev(spark, d).groupBy(conf.severity(F.col("event_type"), SEVERITY).alias("severity")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@family.add("SELECT event_id, event_type, 'filter: ' || k AS reason FROM ev WHERE event_type = 'error' AND k % 2 = 0")
def bus_dead_letter(spark, d):
    dead = v.ev(spark, d).filter("event_type = 'error' AND k % 2 = 0")
    return dead.select("event_id", "event_type", F.concat(F.lit("filter: "), F.col("k")).alias("reason"))


@family.add("SELECT CASE WHEN event_type = 'error' THEN 'errors' ELSE 'daily' END AS sink, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY ALL")
def log_error_split(spark, d):
    e = v.ev(spark, d)
    last = e.agg(F.max("ts").alias("as_of"))
    kept = e.join(F.broadcast(last), F.col("ts") >= F.col("as_of") - F.expr("INTERVAL '20' DAY"))
    sink = F.when(F.col("event_type") == "error", "errors").otherwise("daily")
    return kept.groupBy(sink.alias("sink"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@family.add("SELECT event_id, upper(event_type) AS level, 'user ' || user_id AS message, CAST(NULL AS VARCHAR) AS extra FROM events")
def log_to_json(spark, d):
    line = F.to_json(F.struct(F.upper("event_type").alias("level"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), F.lit(None).cast("string").alias("extra")), {"ignoreNullFields": "false"})
    e = v.ev(spark, d).select("event_id", line.alias("line"))
    return e.select("event_id", *[F.get_json_object("line", f"$.{k}").alias(k) for k in ("level", "message", "extra")])


@family.add("SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY layer DESC) AS r FROM cfg) WHERE r = 1")
def config_layered_get(spark, d):
    return conf.resolved(v.cfg(spark))


RULES = [("system.max_workers", 1, 32), ("system.timeout_seconds", 30, 3600), ("storage.max_cache_size_mb", 100, 10240), ("api.port", 1024, 65535), ("api.workers", 1, 16)]


@family.add(
    f"SELECT c.layer, c.key, c.value FROM cfg c JOIN (VALUES {v._values(RULES)}) r(key, lo, hi) ON c.key = r.key WHERE CAST(c.value AS INTEGER) NOT BETWEEN r.lo AND r.hi"
)
def config_range_check(spark, d):
    return conf.out_of_range(v.cfg(spark), spark.createDataFrame(RULES, "key string, lo int, hi int")).select("layer", "key", "value")


@family.add("SELECT 'database.host, project.name' AS missing")
def config_missing_keys(spark, d):
    return conf.missing(v.cfg(spark), ("api.port", "database.host", "project.name", "logging.level"))


@family.add("SELECT event_id, CAST(k AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS missing FROM ev")
def json_path_get(spark, d):
    j = F.to_json(F.struct(F.struct(F.struct(F.col("k").alias("c")).alias("b")).alias("a")))
    e = v.ev(spark, d).select("event_id", j.alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.a.b.c").alias("v"), F.get_json_object("j", "$.a.x.c").alias("missing"))


@family.add("SELECT grp, bool_and(balance > -900) AS all_ok, bool_or(status = 'unhealthy') AS any_bad FROM chk GROUP BY grp")
def requirement_gate(spark, d):
    return v.chk(spark, d).groupBy("grp").agg(F.bool_and(F.col("balance") > -900).alias("all_ok"), F.bool_or(F.col("status") == "unhealthy").alias("any_bad"))


QUERIES, ORACLE_SQL = family.queries, family.oracle
