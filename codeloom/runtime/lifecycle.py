"""Start and stop of the engine on the driver: requirements, health, signals, components, then ready."""

from __future__ import annotations

import importlib.util
import signal
import sys
import threading
import time
from collections.abc import Callable

from codeloom.runtime import sampler
from codeloom.runtime.errors import StateError
from codeloom.runtime.settings import Settings

#: Components and what they are before they are started (fixed values where pending).
PENDING = ("event_bus", "system_state", "orchestrator", "indexer", "graph", "agents", "embeddings", "api")
CRITICAL_KEYS = ("environment", "storage.data_dir", "api.host", "api.port")


def requirements(settings: Settings, modules: tuple[str, ...] = ("pyspark", "pyarrow", "numpy")) -> dict[str, bool]:
    """The five gates."""
    found = {"python_version": sys.version_info[:2] >= (3, 9)}
    made = not settings.create_directories()
    found["directories"] = made
    found["write_permissions"] = made and sampler.directories_check((settings.get("storage.data_dir"),))[0] == "healthy"
    found["configuration"] = not settings.missing(*CRITICAL_KEYS)
    found["dependencies"] = all(importlib.util.find_spec(m) is not None for m in modules)
    return found


class Engine:
    """``status`` goes from uninitialized over initializing to ready, or to error, and to stopped."""

    def __init__(self, settings: Settings | None = None, checks: dict | None = None):
        self.settings, self.checks = settings or Settings.current(), checks
        self.status, self.started, self.components = "uninitialized", 0.0, {}
        self.failed: list[str] = []
        self.stopping = threading.Event()
        self._before: dict[int, Callable] = {}

    def start(self) -> bool:
        """Whether the engine is ready; an engine that runs already stays as it is."""
        if self.status not in ("uninitialized", "error"):
            return True
        self.status, self.started = "initializing", time.time()
        self.failed = [k for k, ok in requirements(self.settings).items() if not ok]
        if not self.failed:
            rows = sampler.sample(self.checks)
            self.failed = [name for name, status, _, critical, _ in rows if critical and status not in ("healthy", "warning")]
        if self.failed:
            self.status = "error"
            return False
        self._listen()
        self.components = {"configuration": self.settings, "health": "running", "logging": "configured", **dict.fromkeys(PENDING, "pending")}
        self.status = "ready"
        return True

    def _listen(self) -> None:
        """Interrupts and terminations stop the engine; signals can be taken in the main thread only."""
        if threading.current_thread() is threading.main_thread():
            for s in (signal.SIGINT, signal.SIGTERM):
                self._before[s] = signal.signal(s, lambda *_: self.stop())

    def register(self, name: str, component: object) -> None:
        if self.status != "ready":
            raise StateError("components are registered on a ready engine", status=self.status)
        self.components[name] = component

    def stop(self) -> None:
        for s, f in self._before.items():
            signal.signal(s, f)
        self._before = {}
        if self.status == "ready":
            self.status = "stopped"
        self.stopping.set()

    def state(self) -> dict:
        ready = [n for n, c in self.components.items() if c != "pending"]
        up = time.time() - self.started if self.status == "ready" else 0.0
        return {"status": self.status, "uptime_seconds": up, "components": len(self.components), "components_ready": len(ready), "failed": self.failed}
