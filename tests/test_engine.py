"""Functions, sources, sinks, streams and the control plane."""

import contextlib
import datetime
import hashlib
import json
import os
import pathlib
import random
import re
import signal
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as s
from codeloom.operators import bus, entities, health, scanning, search, validate, workflow
from codeloom.plans import views
from codeloom.runtime import container, errors, logs, sampler, settings
from codeloom.runtime.errors import ConfigurationError, DependencyError, EngineError, StateError, ValidationError, WorkflowError
from codeloom.runtime.lifecycle import Engine
from codeloom.runtime.runner import Runner, Step, waves
from codeloom.sources import samples, sinks, source_tree
from codeloom.streaming import events as streams


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_humanize(spark):
    sizes = [0, 100, 1023, 1024, 1024**2, 1024**3, 1024**4, 1500, 1500000, 1024**5 * 2000]
    want = ["0 B", "100 B", "1023 B", "1.00 KB", "1.00 MB", "1.00 GB", "1.00 TB", "1.46 KB", "1.43 MB", "2000.00 PB"]
    assert one(spark, s.humanize(F.col("x")), *sizes, schema="x long") == want
    with pytest.raises(Exception, match="negative"):
        one(spark, s.humanize(F.col("x")), -1, schema="x long")


def test_suffix(spark):
    assert one(spark, s.suffix(F.col("x")), "a.tar.gz", ".gitignore", "x.", "a.py") == [".gz", "", "", ".py"]


def test_decoding(spark):
    raw = ["é\r\nx\ry".encode(), "é".encode("latin-1")]
    assert one(spark, s.decoded(F.col("x")), *raw, schema="x binary") == ["é\nx\ny", "é"]
    with pytest.raises(Exception, match="MALFORMED"):
        one(spark, s.decoded_strict(F.col("x")), raw[1], schema="x binary")


def test_uptime_and_hash(spark):
    assert one(spark, s.uptime(F.col("x")), 59, 86400, 2 * 86400 + 3661, schema="x long") == ["0:00:59", "1 day, 0:00:00", "2 days, 1:01:01"]
    assert one(spark, s.content_hash(F.col("x"), "nonsense"), "a") == one(spark, F.sha2("x", 256), "a")


def test_validators(spark):
    nan = one(spark, validate.in_range(F.col("x"), "x", 0, 10).isNull(), float("nan"), 0.0, 11.0, schema="x double")
    assert nan == [True, True, False]
    pattern = validate.regex(F.col("x"), "x", r"[a-z]+\d+").isNull()
    assert one(spark, pattern, "abc123", "123abc", "abc123 tail", None) == [True, False, True, False]
    assert one(spark, validate.email_normalised(F.col("x")), "  John.Doe@Example.COM  ") == ["John.Doe@example.com"]
    blank = validate.not_empty(F.col("x"), "x").isNull()
    assert one(spark, blank, "a", "", " ", " \n\t", "\u00a0\u2003", " a\n", None) == [True, False, False, False, False, True, False]
    assert one(spark, validate.not_empty(F.col("x"), "x", "number").isNull(), 0, 3, None, schema="x int") == [False, True, False]
    assert one(spark, validate.not_empty(F.col("x"), "x", "boolean").isNull(), False, True, schema="x boolean") == [False, True]
    assert one(spark, validate.not_empty(F.col("x"), "x", "collection").isNull(), [], ["a"], schema="x array<string>") == [False, True]
    assert one(spark, validate.email_normalised(F.col("x")), "\tJ@X.ORG\n") == ["J@x.org"]
    assert one(spark, validate.json_value(F.col("x"), "x").isNull(), "{}", "[]", "{", None) == [True, True, False, False]


def test_quarantine(spark):
    users = spark.createDataFrame([("", -5, "bad"), ("Ann", 30, "a@b.org")], "name string, age int, email string")
    ok, bad = validate.quarantine(users, validate.not_empty(F.col("name"), "name"), validate.in_range(F.col("age").cast("double"), "age", 0, 150), validate.email(F.col("email"), "email"))
    assert [r["name"] for r in ok.collect()] == ["Ann"]
    assert [e["field"] for e in bad.first()["errors"]] == ["name", "age", "email"]


EXAMPLE = '"""Doc."""\nimport os, sys as system\nfrom a import b\n\n\nclass K(Base):\n    def m(self, x):\n        pass\n\n    async def n(self):\n        pass\n\n\n@mark\ndef f(a, *args, k=1):\n    return a\n'


def test_entities(spark):
    files = spark.createDataFrame([("a.py", EXAMPLE), ("bad.py", "def ("), ("c.txt", "class X: pass"), ("none.py", None)], "path string, content string")
    found = entities.extract(files).orderBy("path", "ord").collect()
    kinds = [(r["type"], r["name"], r["module"], r["alias"]) for r in found if r["path"] == "a.py"]
    assert kinds == [("import", "os", None, None), ("import", "sys", None, "system"), ("import", "b", "a", None), ("class", "K", None, None), ("function", "f", None, None), ("function", "m", None, None)]
    assert next(r for r in found if r["name"] == "K")["methods"] == ["m"]
    assert [r["path"] for r in found if r["error"]] == ["bad.py"]


def test_source_tree(spark, tmp_path):
    for name in ("a.py", "b.pyc", "pkg/__init__.py", ".hid/.h.py", "node_modules/z.js", "pkg/__pycache__/c.py", "pkg/deep/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    source_tree.register(spark)
    reader = spark.read.format("source_tree")
    assert sorted(r["name"] for r in reader.load(str(tmp_path)).collect()) == [".h.py", "__init__.py", "a.py", "d.txt"]
    assert [r["name"] for r in reader.option("recursive", "false").option("pattern", "*.py").load(str(tmp_path)).collect()] == ["a.py"]
    assert [r["name"] for r in reader.option("recursive", "true").option("pattern", "pkg/*.py").load(str(tmp_path)).collect()] == ["__init__.py"]
    files = reader.option("pattern", "*").load(str(tmp_path)).select(s.parent(F.col("path")).alias("dir"))
    now = datetime.datetime(2026, 1, 2)
    assert tuple(scanning.metadata(files, now).first()) == (4, 4, now)
    with pytest.raises(Exception, match="not a directory"):
        spark.read.format("source_tree").load(str(tmp_path / "none")).collect()
    assert spark.read.format("source_tree").option("missing", "empty").load(str(tmp_path / "none")).count() == 0


def test_file_info(spark, tmp_path, monkeypatch):
    names = samples.write_project(str(tmp_path))
    source_tree.register(spark)
    for spread in (1, 3, 256):
        monkeypatch.setattr(source_tree, "SPREAD", spread)
        listing = spark.read.format("source_tree").option("dirs", "true").load(str(tmp_path))
        rows = {r["path"]: r for r in scanning.file_info(listing).collect()}
        kept = [n for n in names if not re.search(r"/build/|__pycache__|/\.git/", n)]
        assert sorted(rows) == sorted([*kept, f"{tmp_path}/sample", f"{tmp_path}/tests"])
    for path, r in rows.items():
        p, st = pathlib.Path(path), os.stat(path)
        assert (r["name"], r["stem"], r["suffix"], r["parent"], r["is_file"], r["is_dir"]) == (p.name, p.stem, p.suffix, str(p.parent), p.is_file(), p.is_dir())
        digest = hashlib.sha256(p.read_bytes()).hexdigest() if p.is_file() else None
        assert (r["hash_sha256"], r["size_bytes"]) == (digest, st.st_size if p.is_file() else None)
        for c, t in (("created", st.st_ctime), ("modified", st.st_mtime), ("accessed", st.st_atime)):
            assert abs(datetime.datetime.fromisoformat(r[c]).replace(tzinfo=datetime.UTC).timestamp() - t) < 1 or c == "accessed"
    assert len(next(iter(rows.values())).asDict()) == 13


def test_path_state(spark):
    listing = spark.createDataFrame([("a", False), ("d", True)], "path string, is_dir boolean")
    paths = spark.createDataFrame([("a",), ("d",), ("x",)], "path string")
    state = lambda **k: sorted(map(tuple, validate.path_state(paths, listing, **k).collect()))
    assert state() == [("x", "missing")]
    assert state(must_exist=False, must_be_file=True) == [("d", "not_a_file")]
    assert state(must_be_dir=True) == [("a", "not_a_directory"), ("x", "missing")]


def test_sample_project(spark, tmp_path):
    samples.write_project(str(tmp_path))
    source_tree.register(spark)
    files = spark.read.format("source_tree").load(str(tmp_path)).select("path", s.decoded(F.col("content")).alias("content"))
    found = entities.extract(files)
    assert [r["path"].rsplit("/", 1)[1] for r in entities.failures(found).collect()] == ["broken.py"]
    nodes, edges = entities.graph(found)
    kinds = {(r["rel"], r["dst"].rsplit("::", 1)[-1]) for r in edges.collect()}
    assert {("CONTAINS", "Shape1"), ("DEFINES", "area"), ("CALLS", "Shape2"), ("EXTENDS", "Base"), ("IMPORTS", "os")} <= kinds
    assert {r["label"] for r in nodes.collect()} == {"File", "Class", "Function", "Import"}


CASES = '''
@mark.one(3)
class Outer(a.B, metaclass=M):
    class Inner:
        async def waits(self): pass
    @staticmethod
    def run(x, /, y, *args, key, other=1, **rest):
        for i in x:
            if i and y or key:
                while y: y = f(i) if i else self.g(i)
        try: pass
        except E: pass
        return [z for z in x if z]
'''


def test_entity_cases(spark):
    found = {r["name"]: r for r in entities.extract(spark.createDataFrame([("a.py", CASES)], "path string, content string")).collect()}
    assert set(found) == {"Outer", "Inner", "run"}  # coroutines aren't listed
    assert found["Outer"]["bases"] == ["a.B"] and found["Outer"]["methods"] == ["run"] and found["Inner"]["parent"] == "Outer"
    run = found["run"]
    assert (run["args"], run["decorators"], run["calls"]) == (["y"], ["staticmethod"], ["f", "g"])
    assert run["complexity"] == 1 + len(["for", "if", "and", "or", "while", "else", "except", "comprehension"])


def test_graph_of_scopes(spark):
    """No edge without its nodes, none that the schema forbids, and nodes of one name apart by scope."""
    files = spark.createDataFrame([("n.py", views.NESTED.replace("{k}", "1")), ("c.py", CASES), ("bad.py", "def"), ("e.py", None), (None, "x = 1")], "path string, content string")
    nodes, edges = entities.graph(entities.extract(files).withColumn("src", F.lit(1)))
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    found = edges.collect()
    assert {x for r in found for x in (r["src"], r["dst"])} <= set(labels)
    typed = [(r["rel"], labels[r["src"]], labels[r["dst"]]) for r in found]
    assert search.schema_violations(spark.createDataFrame(typed, "rel string, src_type string, dst_type string")).isEmpty()
    assert {"n.py::A::run::inner", "n.py::B::run::inner", "n.py::twice#2", "n.py::job::step", "a.B", "c.py::Outer::run"} <= set(labels) and "n.py::job" not in labels
    rows = {r["ident"]: r for r in entities.extract(files).collect() if r["path"] == "n.py"}
    assert (rows["B::run"]["complexity"], rows["B::run::inner"]["complexity"], rows["A::run"]["calls"], rows["A::run::inner"]["complexity"]) == (2, 1, ["inner"], 2)
    quick = entities.extract(files, details=False)
    assert quick.drop("complexity", "calls").collect() == entities.extract(files).drop("complexity", "calls").collect() and quick.filter("calls is not null").isEmpty()


def test_entities_in_breadth_first_order(spark):
    """The order of a walk over all nodes of the syntax tree."""
    import ast

    for text in (views.NESTED.replace("{k}", "1"), CASES, open(entities.__file__).read(), open(views.__file__).read(), open(search.__file__).read()):
        want = [n for x in ast.walk(ast.parse(text)) for n in ([x.name] if type(x) in (ast.FunctionDef, ast.ClassDef) else [a.name for a in x.names] if isinstance(x, (ast.Import, ast.ImportFrom)) else [])]
        assert [r["name"] for r in entities.entities_of("a.py", text)] == want


def test_languages(spark):
    table = [(".py", "python"), (".js", "javascript"), (".ts", "typescript"), (".java", "java"), (".go", "go"), (".rs", "rust"), (".cpp", "cpp"), (".c", "c"), (".cs", "c_sharp")]
    assert one(spark, s.code_language(F.col("x")), *[k for k, _ in table], ".php", "", None) == [v for _, v in table] + ["unknown"] * 3


def test_export(spark):
    rows = spark.createDataFrame([(1, "é: x")], "a int, b string")
    assert json.loads(sinks.export(rows)) == [{"a": 1, "b": "é: x"}]
    assert sinks.export(rows, "yaml") == '- {"a": 1, "b": "é: x"}\n' and sinks.export(rows, "text") == "a: 1, b: é: x"
    with pytest.raises(ValidationError):
        sinks.export(spark.range(3), most=2)


def test_logs(tmp_path):
    log = logs.configure(str(tmp_path), as_json=True, name="codeloom.test")
    log.debug("quiet")
    log.error("loud", extra={"extra": {"k": 1}})
    for h in log.handlers:
        h.flush()
    read = lambda n: [json.loads(x) for x in open(tmp_path / n)]
    assert [r["message"] for r in read("daily.log")] == ["quiet", "loud"]
    assert [(r["level"], r["extra"]) for r in read("errors.log")] == [("ERROR", {"k": 1})]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x/y.txt")
    assert sinks.write_file(path, "one", backup=True) is None
    kept = sinks.write_file(path, "two", backup=True)
    assert open(kept).read() == "one" and open(path).read() == "two"
    logs = spark.createDataFrame([("2024-01-01", "ERROR", "a"), ("2024-03-01", "INFO", "b")], "timestamp string, level string, message string")
    sinks.write_logs(logs, str(tmp_path / "logs"))
    assert [r["message"] for r in spark.read.json(str(tmp_path / "logs/daily")).collect()] == ["b"]
    assert [r["message"] for r in spark.read.json(str(tmp_path / "logs/errors")).collect()] == ["a"]
    # Another day is added; a day that comes again is written anew, others stay, and what is too old goes.
    messages = lambda n: sorted(r["message"] for r in spark.read.json(str(tmp_path / f"logs/{n}")).collect())
    more = [("2024-03-01", "INFO", "b2"), ("2024-03-20", "ERROR", "c"), (None, "ERROR", "x")]
    sinks.write_logs(spark.createDataFrame(more, logs.schema), str(tmp_path / "logs"))
    assert messages("daily") == ["b2", "c"] and messages("errors") == ["a", "c"]
    sinks.write_logs(spark.createDataFrame([("2024-04-30", "ERROR", "d")], logs.schema), str(tmp_path / "logs"))
    assert messages("daily") == ["d"] and messages("errors") == ["c", "d"]


def component_rows():
    order = ["healthy", "unhealthy", "unhealthy", "degraded", "unhealthy", "healthy", "unhealthy"]
    return [(i, f"2024-01-01 00:00:{i:02d}", "c1", st, None) for i, st in enumerate(order)]


def test_component_state(spark):
    rows = [
        (1, "c", "healthy", 5.0, ["w"], {"a": "1", "b": "1"}),
        (2, "c", "unhealthy", None, None, {"b": "2"}),
        (3, "c", "unhealthy", None, [], None),
        (1, "d", "degraded", None, None, None),
    ]
    frame = spark.createDataFrame([(i, i, n, s_, r, w, d) for i, n, s_, r, w, d in rows], "event_id long, ts long, name string, status string, response_ms double, warnings array<string>, details map<string,string>")
    got = {r["name"]: r.asDict() for r in health.component_state(frame).collect()}
    assert got["c"] == {"name": "c", "status": "unhealthy", "response_ms": 5.0, "warnings": [], "last_check": 3, "error_count": 2, "details": {"a": "1", "b": "2"}}
    assert got["d"]["warnings"] is None and got["d"]["details"] == {}


def test_streak_and_overall(spark):
    rows = spark.createDataFrame(component_rows(), "event_id long, ts string, name string, status string, value double")
    assert [r["error_count"] for r in health.streaks(rows).orderBy("event_id").collect()] == [0, 1, 2, 2, 3, 0, 1]
    states = lambda *xs: spark.createDataFrame([(x,) for x in xs], "status string")
    status = lambda *xs: states(*xs).agg(health.system_status(F.col("status"))).first()[0]
    assert [status("unhealthy", "healthy", "healthy"), status("healthy", "healthy"), status(*["unhealthy"] * 3, "healthy"), status("unhealthy", "healthy")] == ["degraded", "running", "error", "degraded"]


def test_fsm(spark):
    steps = [(1, "starting"), (2, "running"), (3, "stopped"), (4, "degraded")]
    rows = spark.createDataFrame([(7, f"2024-01-0{1 + i // 2} 00:00:00", i, t) for i, t in steps], "user_id long, ts string, event_id long, target string")
    assert tuple(health.replay(rows, views.edges(spark)).first()) == (7, "degraded", 1)


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame(component_rows(), "event_id long, ts string, name string, status string, value double")
    rows = rows.withColumn("event_type", F.lit("click"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), rows.schema)
    got, errors = [], []
    q = streams.deliver(stream, views.subs(spark), lambda df, n: got.extend(df.collect()), str(tmp_path / "c1"), errors)
    q.awaitTermination(60)
    want = bus.delivery_order(bus.dispatch(rows, views.subs(spark))).count()
    assert len(got) == want and not errors
    q = streams.component_state(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    last = spark.table("states").orderBy(F.desc("seen")).first()
    assert (last["status"], last["error_count"], last["seen"]) == ("unhealthy", 1, 7)


def test_bus_with_faults(spark, tmp_path):
    rows = spark.createDataFrame(component_rows(), "event_id long, ts string, name string, status string, value double").withColumn("event_type", F.lit("click"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), rows.schema)
    seen, errors, told, after = [], [], [], []

    def bad(*_):
        raise ValueError("no")

    def begin(name):
        return streams.deliver(
            stream, views.subs(spark), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), errors, name,
            pre=(bad, lambda e: e.filter("event_id < 3"), lambda e: None), post=(bad, lambda df, n: after.append(df.count())), on_error=(bad, lambda e, n: told.append(str(e))),
        )

    own = streams.named_bus(begin, "faulty")
    assert streams.named_bus(begin, "faulty") is own and own.run().name == "faulty"
    assert seen == [2 * 3] and after == [3] and len(told) == 3 and len(errors) == 6
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    own.run()  # from the checkpoint: the new rows only
    assert seen == [6, 6]
    own.stop()
    lost = streams.Bus("lost", lambda name: streams.deliver(stream, views.subs(spark), bad, str(tmp_path / "c2"), name=name))
    with pytest.raises(Exception, match="no"):
        lost.run(restarts=1)


def test_middleware_that_fails(spark):
    rows, errors = spark.range(3), []
    out = bus.through(rows, lambda df: df.filter("id > 0"), lambda df: df.select("nothing"), lambda df: df.withColumn("y", F.raise_error(F.lit("row"))), lambda df: 7, lambda df: df.withColumn("z", F.col("id") + 1), errors=errors)
    assert sorted(r["z"] for r in out.collect()) == [2, 3] and len(errors) == 3
    assert bus.through(rows, lambda df: df.select("nothing")).columns == ["id"]


def test_many_wildcards(spark, monkeypatch):
    events = spark.range(200).select(F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    subs = spark.createDataFrame([(k, k, "*" if k else "a", 1, None) for k in range(4)], "sub_id int, seq int, event_type string, priority int, min_value double")
    want = bus.dispatch(events, subs).count()
    monkeypatch.setattr(bus, "BROADCAST_ROWS", 0)
    assert bus.dispatch(events, subs).count() == want == 800


def test_streamed_rate(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "error" if i % 2 else "view") for i in range(20)], "event_id long, ts string, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    q = streams.error_rate(streams.source(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("rates").collect()) == [5, 5, 5, 5]


def test_unsubscribe(spark):
    left = bus.unsubscribe(views.subs(spark), spark.createDataFrame([(3,)], "sub_id int"))
    assert left.count() == len(views.SUBSCRIPTIONS) - 1
    assert bus.unsubscribe_all(views.subs(spark)).count() == 0
    assert bus.unsubscribe_all(views.subs(spark), "*").filter("event_type = '*'").count() == 0
    assert bus.unsubscribe_all(views.subs(spark), "click").count() == len(views.SUBSCRIPTIONS) - 1


def test_runner_order_and_data():
    r = Runner()
    r.register("w", [Step("a", lambda d: 1, provides=("x",)), Step("b", lambda d: {"y": d["x"] + 1}, ("a",), ("y",)), Step("c", lambda d: d["x"] + d["y"], ("a", "b"), ("z",))])
    run = r.start("w").wait(10)
    assert (run.status, run.data["z"], run.order) == ("completed", 3, ["a", "b", "c"])
    with pytest.raises(WorkflowError, match="already"):
        r.register("w", [])


def test_runner_conditions():
    def fail(d):
        raise ValueError("no")

    r = Runner()
    r.register("w", [Step("a", fail, critical=False, retries=2), Step("ok", lambda d: 1, ("a",), condition="on_success"), Step("bad", lambda d: 2, ("a",), condition="on_failure"), Step("other", lambda d: 3)])
    run = r.start("w").wait(10)
    assert {k: v["status"] for k, v in run.results.items()} == {"a": "failed", "other": "completed", "ok": "skipped", "bad": "completed"}
    assert run.results["a"]["retries"] == 2 and run.status == "failed"
    r.register("free", [Step("a", fail, critical=False), Step("b", lambda d: 1)])
    assert r.start("free").wait(10).status == "completed"
    r.register("slow", [Step("a", lambda d: time.sleep(5), timeout=0.1)])
    assert "0.1" in r.start("slow").wait(10).results["a"]["error"]
    assert len(r.last("w", 1)) == 1


def test_runner_overdue():
    """A retry never runs beside the attempt before."""
    running, most = [], []

    def slow(d):
        running.append(1)
        most.append(len(running))
        time.sleep(0.5 if len(most) == 1 else 5)
        running.pop()

    r = Runner()
    r.register("w", [Step("a", slow, timeout=0.1, retries=3)])
    found = r.start("w", run_id="own", created_by="me", metadata={"k": 1})
    assert (found.run_id, found.created_by, found.metadata) == ("own", "me", {"k": 1})
    assert found.wait(20).status == "failed" and max(most) == 1 and len(most) == 2


def test_runner_control():
    r = Runner(max_running=1)
    r.register("w", [Step("a", lambda d: time.sleep(0.3)), Step("b", lambda d: 1, ("a",))])
    run = r.start("w")
    with pytest.raises(WorkflowError, match="too many"):
        r.start("w")
    assert r.pause(run.run_id) and not r.pause(run.run_id) and r.resume(run.run_id) and r.cancel(run.run_id)
    assert run.wait(10).status == "cancelled" and not r.cancel(run.run_id)


@pytest.mark.parametrize(
    ("steps", "text"),
    [
        ([Step("a", print, ("b",)), Step("b", print, ("a",))], "circular"),
        ([Step("a", print), Step("a", print)], "duplicate"),
        ([Step("a", print, ("x",))], "unknown"),
        ([Step(" ", print)], "needs a name"),
        ([Step("a", print, condition="conditional")], "conditional"),
    ],
)
def test_runner_checks(steps, text):
    with pytest.raises(WorkflowError, match=text):
        Runner().register("w", steps)


def test_waves():
    assert waves([Step("a", print), Step("b", print, ("a",)), Step("c", print, ("a",)), Step("d", print, ("b", "c"))]) == [["a"], ["b", "c"], ["d"]]


def test_settings_sources(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# note\nexport CODELOOM__API__PORT=9000 # here\nCODELOOM__ENVIRONMENT='production'\nCODELOOM__SYSTEM__MAX_WORKERS=5\nOTHER=1\n")
    env = {"CODELOOM__SYSTEM__MAX_WORKERS": "8"}
    c = settings.Settings(env=env, dotenv=".env")
    assert (c.get("api.port"), c.get("system.max_workers"), c.is_production, c.is_development) == (9000, 8, True, False)
    c.override({"environment": "development", "mine": {"a": 1}})
    assert c.is_development and c.custom == {"mine": {"a": 1}} and c.get("mine.a") == 1
    c.reload()
    assert c.is_production and c.custom == {}
    assert settings.config_files() == [".env"]
    assert c.create_directories() == [] and (tmp_path / "data/graph_exports").is_dir()
    (tmp_path / "file").write_text("x")
    for where, raised in (("development", False), ("production", True)):
        bad = settings.Settings(env={}, overrides={"storage": {"data_dir": "file/x"}, "environment": where})
        with pytest.raises(ConfigurationError) if raised else contextlib.nullcontext():
            assert bad.create_directories()
    settings.Settings.reset()
    assert settings.Settings.current() is settings.Settings.current()
    settings.Settings.reset()


def test_engine_lifecycle(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    good = {"a": (lambda: ("healthy", "ok"), True), "b": (lambda: ("unhealthy", "no"), False)}
    e = Engine(settings.Settings(env={}), good)
    with pytest.raises(StateError):
        e.register("bus", object())
    assert e.start() and e.status == "ready" and e.start()
    before = e.state()["components_ready"]
    e.register("event_bus", object())
    assert e.state()["components_ready"] == before + 1 and e.state()["components"] > before + 1
    os.kill(os.getpid(), signal.SIGTERM)
    assert e.stopping.wait(5) and e.status == "stopped"
    lame = Engine(settings.Settings(env={}), {"a": (lambda: ("unhealthy", "no"), True)})
    assert not lame.start() and (lame.status, lame.failed) == ("error", ["a"])
    none = Engine(settings.Settings(env={}, overrides={"api": {"host": ""}}), good)
    assert not none.start() and none.failed == ["configuration"]


def test_settings(tmp_path):
    c = settings.Settings(env={"CODELOOM__SYSTEM__MAX_WORKERS": "8"}, overrides={"custom": {"flag": "on"}})
    assert c.get("system.max_workers") == 8 and c.get("custom.flag") == "on" and c.get("no.key", 1) == 1
    assert c.missing("api.port", "database.host") == ["database.host"]
    for bad in (0, 33, -1):
        with pytest.raises(ConfigurationError):
            settings.Settings(env={}, overrides={"system": {"max_workers": bad}})


class Leaf:
    pass


class Node:
    def __init__(self, leaf: Leaf):
        self.leaf = leaf


class Left:
    def __init__(self, other: "Right"):
        pass


class Right:
    def __init__(self, other: Left):
        pass


def test_container():
    c = container.Container()
    assert c.register(Leaf) and not c.register(Leaf)
    c.register(Node, lifetime="transient")
    assert c.resolve(Node).leaf is c.resolve(Node).leaf and c.resolve(Node) is not c.resolve(Node)
    assert c.edges() == [("Node", "Leaf")]
    with pytest.raises(DependencyError, match="Left -> Right -> Left"):
        c.resolve(Left)
    c2 = container.Container()
    c2.register(Leaf, lifetime="scoped")
    with c2.scope():
        assert c2.resolve(Leaf) is c2.resolve(Leaf)
    with pytest.raises(DependencyError):
        c2.resolve(Leaf)


def test_decorators():
    c = container.Container()
    own = container.singleton(c)(Leaf)

    @container.inject(c)
    def build(a, leaf: Leaf, n=1):
        return a, leaf, n

    assert build(3)[1] is c.resolve(own) and build(3, n=2)[2] == 2
    given = Leaf()
    assert build(1, given)[1] is given and build(1, leaf=given)[1] is given


def test_error_classes():
    of = {k.__name__: (k("m").report.code, k("m").severity) for k in vars(errors).values() if isinstance(k, type) and issubclass(k, EngineError)}
    assert {c for c, _ in of.values()} <= set(errors.CODES) and len(errors.CODES) == 16
    assert {n for n, (_, v) in of.items() if v != "medium"} == {"ConfigurationError"}
    assert of["StateError"][0] == "SYSTEM_STATE_ERROR" and of["GraphError"][0] == "GRAPH_ERROR"
    assert str(EngineError("m", code="LEARNING_ERROR", severity="low")) == "[LEARNING_ERROR] m"
    for bad in ({"code": "NO"}, {"severity": "no"}):
        with pytest.raises(ValueError, match="unknown"):
            EngineError("m", **bad)
    assert set(errors.ValidationError("m", field="f", actual_length=0).details) == {"field", "actual_length"}


def test_errors():
    e = EngineError("m", cause=ValueError("v"), a=1, b=None, c="")
    assert str(e) == "[INTERNAL_ERROR] m | Causa: ValueError: v"
    assert e.to_dict()["details"] == {"a": 1} and e.to_dict()["cause"]["type"] == "ValueError"


def test_sampler(spark):
    rows = sampler.frame(spark, {"good": (lambda: ("healthy", "ok"), True), "bad": (lambda: 1 / 0, True)})
    r = health.check_summary(rows).first()
    assert (r["total"], r["healthy"], r["unhealthy"], r["critical_failed"]) == (2, 1, 1, True)


def test_samples_and_poll(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    found = {x[0]: x for x in sampler.sample()}
    assert set(found) == set(sampler.CHECKS) == {"python_environment", "system_resources", "configuration", "file_system", "dependencies", "network_basic"}
    assert all(found[n][1] == "healthy" for n in ("python_environment", "file_system", "dependencies", "configuration"))
    assert 0 <= sampler.gauges()["memory"] <= 100 and sampler.gauges()["hostname"]
    began = time.time()
    late = sampler.sample({"slow": (lambda: time.sleep(3) or ("healthy", ""), True), "quick": (lambda: ("healthy", ""), True)}, timeout=0.2)
    assert [(r[0], r[1]) for r in late] == [("slow", "unhealthy"), ("quick", "healthy")] and late[0][2] == "Timeout" and time.time() - began < 2
    rows = []

    def sink(r):
        rows.append(r)
        if len(rows) == 1:
            raise ValueError("once")

    poll = sampler.Poll(sink, {"a": (lambda: ("healthy", ""), True)}, interval=0.05)
    assert poll.start() and not poll.start()
    time.sleep(0.5)
    poll.stop()
    n = len(rows)
    assert n >= 3 and len(poll.errors) == 1
    time.sleep(0.2)
    assert len(rows) == n


def test_retention(spark):
    rows = spark.createDataFrame([("w", i, i) for i in range(7)], "name string, workflow_id int, start_time int")
    assert [r["workflow_id"] for r in workflow.last_runs(rows, 3).orderBy("position").collect()] == [4, 5, 6]


def test_cli(capsys, tmp_path, monkeypatch):
    from codeloom import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main(["status"]) in (0, 1) and "components_ready" in capsys.readouterr().out
    assert cli.table([{"a": 1, "b": 2.0}, {"a": 10, "b": 3.25}]) == "a   b\n1   2.0\n10  3.2" and cli.table([]) == "(no rows)"

    assert cli.main(["analyze", "/no/such/dir"]) == 1
    assert cli.main(["health"]) in (0, 1) and "python" in capsys.readouterr().out


def test_modules_have_names_of_their_own():
    """Two test modules of one name can't be collected together."""
    root = os.path.dirname(os.path.abspath(__file__))
    names = [n for _, _, files in os.walk(root) for n in files if n.startswith("test_") and n.endswith(".py")]
    assert len(names) == len(set(names)) and {"test_engine.py", "test_queries.py"} <= set(names)


def test_entry_without_the_training_operators(monkeypatch):
    import builtins
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "corpus_pipeline":
            raise ImportError("no library")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.warns(UserWarning, match="no library"):
        names = set(__spark_entry__.queries())
    assert "scan_project" in names and not any(re.match(r"op\d", n) for n in names)


def test_library_stands_without_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "codeloom")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "codeloom.llm" not in open(os.path.join(folder, n)).read()
