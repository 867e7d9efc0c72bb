"""Component health, check summaries and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STALE_SECONDS = 300
ICONS = {"healthy": "✅", "warning": "⚠️", "unhealthy": "❌", "error": "💥"}


def latest(events: DataFrame) -> DataFrame:
    """Last status of each component, its last non-null value, and when it was last active."""
    at = F.struct("ts", "event_id")
    return events.groupBy("name").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("value"),
        F.max("ts").alias("last_active"),
    )


def component_state(reports: DataFrame) -> DataFrame:
    """The state of each component after all its reports, field by field.

    ``reports``: name, ts, event_id, status, response_ms, warnings (array), details (map). Status is the last one; a
    null response time, or null warnings, keep the old value; details are merged, later values winning; the error
    count starts anew at each healthy report.
    """
    at = F.struct("ts", "event_id")

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)

    kept = streaks(reports).groupBy("name").agg(
        F.max_by("status", at).alias("status"), last("response_ms"), last("warnings"), F.max("ts").alias("last_check"), F.max_by("error_count", at).alias("error_count"),
    )
    # Of each key of the details the last value, before anything is gathered by component.
    pairs = reports.select("name", "ts", "event_id", F.explode("details").alias("key", "value"))
    pairs = pairs.groupBy("name", "key").agg(F.max_by("value", at).alias("value"))
    merged = pairs.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("details"))
    return kept.join(merged, "name", "left").withColumn("details", F.coalesce("details", F.create_map().cast("map<string,string>")))


def components_ready(components: DataFrame) -> DataFrame:
    """How many components are there and how many are no longer pending."""
    return components.agg(F.count("*").alias("components"), F.count_if(F.col("status") != "pending").alias("components_ready"))


def overall(status: Column, stale: Column) -> Column:
    """Worst first: unhealthy, degraded or stale, unknown, healthy."""
    return (
        F.when(F.bool_or(status == "unhealthy"), "unhealthy")
        .when(F.bool_or((status == "degraded") | stale), "degraded")
        .when(F.bool_or(status == "unknown"), "unknown")
        .otherwise("healthy")
    )


def system_status(status: Column) -> Column:
    """More than half unhealthy: error; any unhealthy or degraded: degraded; else running."""
    bad, n = F.count_if(status == "unhealthy"), F.count("*")
    return F.when(bad * 2 > n, "error").when((bad > 0) | (F.count_if(status == "degraded") > 0), "degraded").otherwise("running")


def streaks(events: DataFrame) -> DataFrame:
    """``error_count``: unhealthy reports since the last healthy one."""
    w = Window.partitionBy("name").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    island = events.withColumn("island", F.count_if(F.col("status") == "healthy").over(w))
    own = Window.partitionBy("name", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("error_count", F.count_if(F.col("status") == "unhealthy").over(own))


def changes(events: DataFrame) -> DataFrame:
    """Reports whose status differs from the component's one before."""
    w = Window.partitionBy("name").orderBy("ts", "event_id")
    return events.withColumn("previous", F.lag("status").over(w)).filter("previous <> status")


def stale(events: DataFrame, as_of: DataFrame, seconds: float = STALE_SECONDS) -> DataFrame:
    """Components silent for more than ``seconds`` before ``as_of`` (one row, column as_of)."""
    last = events.groupBy("name").agg(F.max("ts").alias("last_active")).crossJoin(F.broadcast(as_of))
    gap = F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last_active").cast("timestamp"))
    return last.filter(gap > seconds * 1_000_000).select("name", "last_active")


def check_summary(checks: DataFrame, *by: str) -> DataFrame:
    n = F.count("*")
    healthy = F.count_if(F.col("status") == "healthy")
    return checks.groupBy(*by).agg(
        n.alias("total"),
        healthy.alias("healthy"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("status") == "unhealthy").alias("unhealthy"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.bool_or(F.col("critical") & F.col("status").isin("unhealthy", "error")).alias("critical_failed"),
        F.round(healthy * 100 / n, 2).alias("success_rate"),
    )


def check_overall() -> Column:
    """Unhealthy before warning before healthy."""
    s = F.col("status")
    return F.when(F.bool_or(s.isin("unhealthy", "error")), "unhealthy").when(F.bool_or(s == "warning"), "warning").otherwise("healthy")


def report_line() -> Column:
    icon = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ICONS.items() for x in p]), F.col("status")), F.lit("❓"))
    return F.concat(icon, F.when(F.col("critical"), " [CRITICAL]").otherwise(""), F.lit(" "), F.col("name"), F.lit(": "), F.col("status"))


def resource_warnings(cpu: Column, memory: Column, disk: Column) -> Column:
    """Names of the gauges over their limits."""
    over = F.array(F.when(cpu > 85, "cpu"), F.when(memory > 85, "memory"), F.when(disk > 90, "disk"))
    return F.array_join(F.array_compact(over), ",")


def replay(targets: DataFrame, edges: DataFrame, start: str = "initializing") -> DataFrame:
    """Final status and rejected transitions of each user's targets in time order.

    The legal edges are a table of fixed size. What a user's events of one day do is a map: from each status
    at its start, the status at its end and the transitions rejected on the way. Days are folded apart, so no
    task holds all events of a user, and a user's maps, one a day, are composed in order.
    """
    legal = [(r["old"], r["new"]) for r in edges.collect()]
    names = sorted({start, *[x for pair in legal for x in pair]})
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    known = F.array(*[F.lit(x) for x in names])

    def state(status: Column, rejected: Column) -> Column:
        return F.struct(status.alias("status"), rejected.cast("long").alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        def one(s: Column) -> Column:
            ok = F.array_contains(allowed, F.concat(s["status"], F.lit(">"), x["target"]))
            return state(F.when(ok, x["target"]).otherwise(s["status"]), s["rejected"] + F.when(ok, 0).otherwise(1))

        return F.transform(acc, one)

    identity = F.array(*[state(F.lit(x), F.lit(0)) for x in names])
    day = targets.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "target"))).alias("xs"))
    maps = day.select("user_id", "day", F.aggregate("xs", identity, step).alias("map"))

    def compose(s: Column, x: Column) -> Column:
        to = F.get(x["map"], (F.array_position(known, s["status"]) - 1).cast("int"))
        return state(to["status"], s["rejected"] + to["rejected"])

    whole = maps.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("day", "map"))).alias("days"))
    out = whole.select("user_id", F.aggregate("days", state(F.lit(start), F.lit(0)), compose).alias("s"))
    return out.select("user_id", F.col("s.status").alias("final_status"), "s.rejected")


def folded_metric(changes: DataFrame) -> DataFrame:
    """Value of each metric: the last set value plus the increments after it.

    ``changes``: name, op (set or add), amount (null where not numeric), ts, event_id.
    """
    valid = changes.filter("amount is not null")
    last = valid.filter("op = 'set'").groupBy("name").agg(F.max(F.struct("ts", "event_id", "amount")).alias("s"))
    after = F.struct("ts", "event_id") > F.struct(F.col("s.ts"), F.col("s.event_id"))
    added = valid.filter("op = 'add'").join(last, "name", "left").filter(F.col("s").isNull() | after)
    total = added.groupBy("name").agg(F.sum("amount").alias("added"))
    both = last.join(total, "name", "full")
    return both.select("name", (F.coalesce("s.amount", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("value"))
