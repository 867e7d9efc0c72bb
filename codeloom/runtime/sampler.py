"""Health checks of the driver's host, as rows for the check operators, once or in a poll."""

from __future__ import annotations

import importlib.util
import os
import platform
import shutil
import socket
import sys
import tempfile
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from codeloom.runtime.settings import Settings, config_files

CHECK_SCHEMA = "name string, status string, message string, critical boolean, response_ms double"
#: Seconds for one check and between two polls (fixed values).
TIMEOUT, INTERVAL = 10.0, 30.0
#: Keys that a configuration must have (fixed values), by this engine's names.
REQUIRED_KEYS = ("system.name", "system.version", "environment", "storage.data_dir")
#: Shares of use, in percent, from which a resource is short (fixed values).
MOST = {"cpu": 85.0, "memory": 85.0, "disk": 90.0}

Found = tuple[str, str]


def gauges(path: str = "/") -> dict[str, float | str]:
    """Load, memory and disk in percent, sizes in GB, and the host's name and platform."""
    pages = {k: os.sysconf(k) for k in ("SC_PAGE_SIZE", "SC_PHYS_PAGES", "SC_AVPHYS_PAGES")}
    total, free = (pages["SC_PAGE_SIZE"] * pages[k] for k in ("SC_PHYS_PAGES", "SC_AVPHYS_PAGES"))
    try:  # caches count as available where the system says so
        with open("/proc/meminfo") as f:
            free = next((int(x.split()[1]) * 1024 for x in f if x.startswith("MemAvailable:")), free)
    except OSError:
        pass
    use = shutil.disk_usage(path)
    return {
        "cpu": 100 * os.getloadavg()[0] / (os.cpu_count() or 1),
        "memory": 100 * (total - free) / total,
        "disk": 100 * use.used / use.total,
        "memory_gb": round(total / 1024**3, 2),
        "disk_gb": round(use.total / 1024**3, 2),
        "hostname": socket.gethostname(),
        "platform": platform.platform(),
    }


def python_check() -> Found:
    ok = sys.version_info[:2] >= (3, 9)
    return ("healthy" if ok else "unhealthy"), platform.python_version()


def resources_check(path: str = "/") -> Found:
    now = gauges(path)
    short = [f"{k} {now[k]:.1f} %" for k, most in MOST.items() if now[k] > most]
    return ("warning", ", ".join(short)) if short else ("healthy", "enough of all")


def configuration_check(settings: Settings | None = None) -> Found:
    own = settings or Settings.current()
    lacking = own.missing(*REQUIRED_KEYS)
    files = ", ".join(config_files()) or "no files"
    return ("unhealthy", f"missing: {', '.join(lacking)}") if lacking else ("healthy", f"{own.environment}; {files}")


def directories_check(paths: tuple[str, ...] = ("./data", "./logs")) -> Found:
    """Each directory is made where it is lacking, and takes a file."""
    bad = []
    for p in paths:
        try:
            os.makedirs(p, exist_ok=True)
            with tempfile.TemporaryFile(dir=p):
                pass
        except OSError as e:
            bad.append(f"{p}: {e.strerror}")
    return ("unhealthy" if bad else "healthy"), ", ".join(bad) or "writable"


def modules_check(names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> Found:
    lacking = [n for n in names if importlib.util.find_spec(n) is None]
    return ("unhealthy" if lacking else "healthy"), ", ".join(lacking) or "all found"


def network_check() -> Found:
    socket.gethostbyname("localhost")
    return "healthy", socket.gethostname()


CHECKS: dict[str, tuple[Callable[[], Found], bool]] = {
    "python_environment": (python_check, True),
    "system_resources": (resources_check, False),
    "configuration": (configuration_check, True),
    "file_system": (directories_check, True),
    "dependencies": (modules_check, True),
    "network_basic": (network_check, False),
}


def sample(checks: dict | None = None, timeout: float = TIMEOUT) -> list[tuple]:
    """One row a check; all run at once. One that raises, or has no result in time, is unhealthy."""
    checks = CHECKS if checks is None else checks
    pool = ThreadPoolExecutor(max(1, len(checks)), thread_name_prefix="check")
    began = time.perf_counter()
    took: dict[str, float] = {}

    def timed(name: str, f: Callable[[], Found]) -> Found:
        try:
            return f()
        finally:
            took[name] = time.perf_counter() - began

    running = {name: pool.submit(timed, name, f) for name, (f, _) in checks.items()}
    out = []
    for name, (_, critical) in checks.items():
        try:
            status, message = running[name].result(max(0.0, began + timeout - time.perf_counter()))
        except Late:
            status, message = "unhealthy", "Timeout"
        except Exception as e:  # noqa: BLE001  the failure is the result
            status, message = "unhealthy", str(e)
        out.append((name, status, message, critical, 1000 * took.get(name, time.perf_counter() - began)))
    pool.shutdown(wait=False, cancel_futures=True)
    return out


def frame(spark, checks: dict | None = None, timeout: float = TIMEOUT):
    return spark.createDataFrame(sample(checks, timeout), CHECK_SCHEMA)


class Poll:
    """Samples again and again until it is stopped; each sample goes to ``sink``, whose failures are noted."""

    def __init__(self, sink: Callable[[list[tuple]], None], checks: dict | None = None, interval: float = INTERVAL, timeout: float = TIMEOUT):
        self.sink, self.checks, self.interval, self.timeout = sink, checks, interval, timeout
        self.errors: list[Exception] = []
        self._stop, self._thread = threading.Event(), None

    def start(self) -> bool:
        """False where it runs already."""
        if self._thread and self._thread.is_alive():
            return False
        self._stop.clear()
        self._thread = threading.Thread(target=self._run, name="health-poll", daemon=True)
        self._thread.start()
        return True

    def _run(self) -> None:
        while True:
            try:
                self.sink(sample(self.checks, self.timeout))
            except Exception as e:  # noqa: BLE001  the poll goes on
                self.errors.append(e)
            if self._stop.wait(self.interval):
                return

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(self.timeout + 1)
