"""Layered settings: defaults, .env, environment, YAML files, overrides; later layers win."""

from __future__ import annotations

import os
from typing import Any, ClassVar

from codeloom.runtime.errors import ConfigurationError

DEFAULTS = {
    "environment": "development",
    "system": {"name": "codeloom", "version": "0.1.0", "max_workers": 4, "timeout_seconds": 300},
    "storage": {"data_dir": "./data", "cache_dir": "./data/cache", "log_dir": "./logs", "max_cache_size_mb": 1024},
    "logging": {"level": "INFO"},
    "indexer": {"max_file_size_mb": 10},
    "api": {"host": "0.0.0.0", "port": 8000, "workers": 2},
}
#: Files that are read where they exist, in this order.
FILES = ("config/system_config.yaml", "config/agent_config.yaml")
#: Directories below the data directory (fixed values).
BELOW = ("backups", "embeddings", "graph_exports", "projects", "state")
#: Bounds of numbers, inclusive (fixed values).
BOUNDS = {
    "system.max_workers": (1, 32),
    "system.timeout_seconds": (30, 3600),
    "storage.max_cache_size_mb": (100, 10240),
    "api.port": (1024, 65535),
    "api.workers": (1, 16),
}


def merged(base: dict, over: dict) -> dict:
    """Dictionaries merge, other values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(env: dict[str, str], prefix: str = "CODELOOM__") -> dict:
    """``CODELOOM__SYSTEM__MAX_WORKERS=8``: names in any case, ``__`` nests."""
    out: dict = {}
    for name, value in env.items():
        if name.upper().startswith(prefix):
            *path, last = name[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = int(value) if value.lstrip("-").isdigit() else value
    return out


def from_dotenv(path: str = ".env") -> dict[str, str]:
    """``NAME=value`` lines; ``export``, quotes and comments are taken off. A missing file gives nothing."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    value = value.strip()
                    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                    out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def config_files(paths: tuple[str, ...] = (*FILES, ".env")) -> list[str]:
    """Those that exist, in the order given."""
    return [p for p in paths if os.path.exists(p)]


def from_yaml(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    try:
        import yaml
    except ImportError as e:
        raise ConfigurationError("PyYAML isn't installed", cause=e) from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


class Settings:
    """Known sections are merged key by key; a key at the top that no default has goes to the custom layer, which
    is looked at first."""

    _current: ClassVar[Settings | None] = None

    def __init__(self, files: tuple[str, ...] = (), env: dict[str, str] | None = None, overrides: dict | None = None, dotenv: str | None = None):
        self._made = {"files": files, "env": env, "overrides": overrides, "dotenv": dotenv}
        self.layers: list[dict] = []
        self._load()

    @classmethod
    def current(cls) -> Settings:
        """The one that all share, made on first use."""
        if cls._current is None:
            cls._current = cls(FILES, dotenv=".env")
        return cls._current

    @classmethod
    def reset(cls) -> None:
        cls._current = None

    def reload(self) -> None:
        """Read all sources again; overrides made since are gone."""
        self._load()

    def override(self, values: dict) -> None:
        """One more layer on top, without bounds (for tests)."""
        self.layers.append(values)
        self.values = merged(self.values, values)

    @property
    def environment(self) -> str:
        return self.get("environment")

    @property
    def is_development(self) -> bool:
        return self.environment == "development"

    @property
    def is_production(self) -> bool:
        return self.environment == "production"

    @property
    def custom(self) -> dict:
        return {k: v for k, v in self.values.items() if k not in DEFAULTS}

    def directories(self) -> list[str]:
        data = self.get("storage.data_dir")
        return [data, self.get("storage.cache_dir"), self.get("storage.log_dir"), *(os.path.join(data, x) for x in BELOW)]

    def create_directories(self) -> list[str]:
        """Errors of directories that couldn't be made; in production the first is raised."""
        errors = []
        for d in self.directories():
            try:
                os.makedirs(d, exist_ok=True)
            except OSError as e:
                errors.append(f"{d}: {e.strerror}")
        if errors and self.is_production:
            raise ConfigurationError(f"directory not made: {errors[0]}")
        return errors

    def _load(self) -> None:
        files, env, overrides, dotenv = (self._made[k] for k in ("files", "env", "overrides", "dotenv"))
        given = dict(os.environ) if env is None else env
        self.layers = [DEFAULTS, from_environment(from_dotenv(dotenv)) if dotenv else {}, from_environment(given), *map(from_yaml, files), overrides or {}]
        self.values: dict = {}
        for layer in self.layers:
            self.values = merged(self.values, layer)
        for key, (lo, hi) in BOUNDS.items():
            v = self.get(key)
            if v is not None and not (isinstance(v, (int, float)) and lo <= v <= hi):
                raise ConfigurationError(f"{key} must lie in {lo}..{hi}", key=key, value=str(v))

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for p in key.split("."):
            if not isinstance(at, dict) or p not in at:
                return default
            at = at[p]
        return at

    def missing(self, *keys: str) -> list[str]:
        return [k for k in keys if self.get(k) in (None, "")]

    def rows(self) -> list[tuple[int, str, str]]:
        """(layer, key, value) of all layers, as data."""

        def flat(prefix: str, x: Any) -> list[tuple[str, str]]:
            if isinstance(x, dict):
                return [r for k, v in x.items() for r in flat(f"{prefix}.{k}" if prefix else k, v)]
            return [(prefix, str(x))]

        return [(n + 1, k, v) for n, layer in enumerate(self.layers) for k, v in flat("", layer)]

    def apply(self, spark) -> None:
        """``spark.*`` keys of the settings go to the session."""
        for _, k, v in self.rows():
            if k.startswith("spark."):
                spark.conf.set(k, v)
