"""Runs workflows of driver-side steps in waves; steps submit Spark jobs, several at a time.

Each wave runs all steps whose required steps have finished. Retries wait linearly longer, a step
has a timeout, pause and cancel act between waves, and cancelling also cancels the Spark jobs of
the run's tag. A step whose required step failed is skipped under ON_SUCCESS, runs under
ON_FAILURE and isn't run under ALWAYS; the run then ends as failed.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from codeloom.runtime.errors import WorkflowError

DONE = ("completed", "skipped")
HISTORY = 100
GRACE = 1.0


class Overdue(TimeoutError):
    def __init__(self, message: str, running: bool):
        super().__init__(message)
        self.running = running


@dataclass
class Step:
    name: str
    action: Callable[[dict], Any]
    requires: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    condition: str = "always"
    when: Callable[[dict], bool] | None = None
    timeout: float = 300.0
    retries: int = 0
    delay: float = 0.0
    critical: bool = True


@dataclass
class Run:
    workflow: str
    run_id: str
    data: dict = field(default_factory=dict)
    status: str = "pending"
    results: dict[str, dict] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    started: float = 0.0
    ended: float = 0.0
    done: threading.Event = field(default_factory=threading.Event)
    resumed: threading.Event = field(default_factory=threading.Event)
    cancelled: bool = False
    priority: int = 50
    created_by: str = ""
    metadata: dict = field(default_factory=dict)

    def wait(self, seconds: float | None = None) -> Run:
        self.done.wait(seconds)
        return self


def check(steps: list[Step]) -> None:
    """Names, conditions, references and cycles."""
    names = [s.name for s in steps]
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise WorkflowError(f"duplicate steps: {', '.join(sorted(twice))}")
    for s in steps:
        if not s.name.strip() or not callable(s.action):
            raise WorkflowError("a step needs a name and an action", step=s.name)
        if s.condition == "conditional" and s.when is None:
            raise WorkflowError("a conditional step needs a function", step=s.name)
        if lacking := [r for r in s.requires if r not in names]:
            raise WorkflowError(f"unknown steps: {', '.join(lacking)}", step=s.name)
    waves(steps)


def waves(steps: list[Step]) -> list[list[str]]:
    """Topological levels."""
    left, out, done = {s.name: set(s.requires) for s in steps}, [], set()
    while left:
        wave = sorted(n for n, r in left.items() if r <= done)
        if not wave:
            raise WorkflowError(f"circular requirements among: {', '.join(sorted(left))}")
        out.append(wave)
        done |= set(wave)
        for n in wave:
            del left[n]
    return out


class Runner:
    def __init__(self, spark=None, max_running: int = 10, workers: int = 8, publish: Callable[[str, dict], None] | None = None):
        self.spark, self.max_running = spark, max_running
        self.workflows: dict[str, list[Step]] = {}
        self.active: dict[str, Run] = {}
        self.history: dict[str, list[Run]] = {}
        self.publish = publish or (lambda kind, data: None)
        self.pool = ThreadPoolExecutor(workers)
        self.lock = threading.Lock()

    def register(self, name: str, steps: list[Step]) -> None:
        if name in self.workflows:
            raise WorkflowError("already registered", workflow=name)
        check(steps)
        self.workflows[name] = list(steps)

    def start(self, name: str, data: dict | None = None, run_id: str | None = None, priority: int = 50, created_by: str = "", metadata: dict | None = None) -> Run:
        """The run, which goes on in the background; ``run_id`` must not be in use."""
        if name not in self.workflows:
            raise WorkflowError("unknown workflow", workflow=name)
        with self.lock:
            if len(self.active) >= self.max_running:
                raise WorkflowError("too many running workflows", workflow=name)
            run = Run(name, run_id or f"{name}_{uuid.uuid4().hex[:8]}", dict(data or {}), priority=priority, created_by=created_by, metadata=dict(metadata or {}))
            if run.run_id in self.active:
                raise WorkflowError("this run is active already", workflow=name, id=run.run_id)
            self.active[run.run_id] = run
        run.status, run.started = "running", time.time()
        run.resumed.set()
        self.publish("workflow.started", {"id": run.run_id})
        threading.Thread(target=self._drive, args=(run,), daemon=True).start()
        return run

    def pause(self, run_id: str) -> bool:
        run = self.active.get(run_id)
        if not run or run.status != "running":
            return False
        run.status = "paused"
        run.resumed.clear()
        return True

    def resume(self, run_id: str) -> bool:
        run = self.active.get(run_id)
        if not run or run.status != "paused":
            return False
        run.status = "running"
        run.resumed.set()
        return True

    def cancel(self, run_id: str) -> bool:
        run = self.active.get(run_id)
        if not run:
            return False
        run.cancelled = True
        run.resumed.set()
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(run_id)
        return True

    def shutdown(self) -> None:
        for run in list(self.active.values()):
            self.cancel(run.run_id)
            run.wait(10)
        self.pool.shutdown(wait=False)

    def last(self, name: str, limit: int | None = None) -> list[Run]:
        runs = self.history.get(name, [])
        return runs[-limit:] if limit else list(runs)

    def _drive(self, run: Run) -> None:
        steps = {s.name: s for s in self.workflows[run.workflow]}
        try:
            while not run.cancelled:
                run.resumed.wait()
                ready = self._ready(run, steps)
                if not ready or run.cancelled:
                    break
                list(self.pool.map(lambda s: self._execute(run, s), ready))
                if any(run.results[s.name]["status"] == "failed" and s.critical for s in ready):
                    break
            run.status = "cancelled" if run.cancelled else self._final(run, steps)
        except Exception as e:  # noqa: BLE001  a fault of the runner ends the run, not the process
            run.status = "failed"
            run.data["error"] = str(e)
        finally:
            run.ended = time.time()
            with self.lock:
                self.active.pop(run.run_id, None)
                kept = self.history.setdefault(run.workflow, [])
                kept.append(run)
                del kept[:-HISTORY]
            self.publish(f"workflow.{run.status}", {"id": run.run_id})
            run.done.set()

    def _ready(self, run: Run, steps: dict[str, Step]) -> list[Step]:
        """Steps to run now; looks again after it has skipped some, as others may then be ready."""
        while True:
            before, out = len(run.results), []
            for s in steps.values():
                if s.name in run.results or not all(r in run.results for r in s.requires):
                    continue
                found = [run.results[r]["status"] for r in s.requires]
                if s.condition == "on_success" and any(x != "completed" for x in found):
                    self._note(run, s.name, "skipped")
                elif s.condition == "on_failure" and "failed" not in found:
                    self._note(run, s.name, "skipped")
                elif s.condition in ("always", "conditional") and any(x not in DONE for x in found):
                    continue
                elif s.condition == "conditional" and not self._holds(s, run):
                    self._note(run, s.name, "skipped")
                else:
                    out.append(s)
            if out or len(run.results) == before:
                return out

    @staticmethod
    def _holds(s: Step, run: Run) -> bool:
        try:
            return bool(s.when(run.data))
        except Exception:  # noqa: BLE001  a condition that fails is false
            return False

    @staticmethod
    def _note(run: Run, name: str, status: str, **more) -> None:
        run.results[name] = {"status": status, **more}
        run.order.append(name)

    def _execute(self, run: Run, s: Step) -> None:
        inputs = dict(run.data)
        began, error = time.time(), None
        for attempt in range(s.retries + 1):
            if attempt:
                time.sleep(s.delay * attempt)
            try:
                value = self._within(run, s, inputs)
            except Overdue as e:
                error = e
                if e.running:  # a second attempt beside the first could undo its work
                    break
                continue
            except Exception as e:  # noqa: BLE001  reported in the step's result
                error = e
                continue
            made = {k: value.get(k) if isinstance(value, dict) else value for k in s.provides}
            run.data.update(made)
            self._note(run, s.name, "completed", result=value, retries=attempt, seconds=time.time() - began, error=None)
            self.publish("workflow.step_completed", {"id": run.run_id, "step": s.name})
            return
        self._note(run, s.name, "failed", retries=s.retries, seconds=time.time() - began, error=str(error))

    def _within(self, run: Run, s: Step, inputs: dict) -> Any:
        """The action's value, or :class:`Overdue`; its Spark jobs carry the run's tag and the attempt's.

        An attempt without a result in time loses its Spark jobs and has ``GRACE`` seconds more to end.
        """
        box: dict = {}
        tag = uuid.uuid4().hex

        def call() -> None:
            try:
                if self.spark is not None:
                    self.spark.sparkContext.addJobTag(run.run_id)
                    self.spark.sparkContext.addJobTag(tag)
                box["value"] = s.action(inputs)
            except BaseException as e:  # noqa: BLE001  handed over to the waiting thread
                box["error"] = e

        t = threading.Thread(target=call, daemon=True)
        t.start()
        t.join(s.timeout)
        if t.is_alive():
            if self.spark is not None:
                self.spark.sparkContext.cancelJobsWithTag(tag)
            t.join(GRACE)
            raise Overdue(f"no result within {s.timeout} s", t.is_alive())
        if "error" in box:
            raise box["error"]
        return box["value"]

    @staticmethod
    def _final(run: Run, steps: dict[str, Step]) -> str:
        failed = [n for n, r in run.results.items() if r["status"] == "failed"]
        if len(run.results) < len(steps):
            return "failed" if failed else "completed"
        needed = {r for s in steps.values() for r in s.requires}
        return "failed" if any(steps[n].critical or n in needed for n in failed) else "completed"
