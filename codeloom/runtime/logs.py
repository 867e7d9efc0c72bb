"""Logging on the driver: console, a file a day, and errors apart; text or JSON lines."""

from __future__ import annotations

import gzip
import json
import logging
import os
import shutil
from datetime import UTC, datetime
from logging.handlers import RotatingFileHandler, TimedRotatingFileHandler

#: Days that daily files stay, and bytes and number of error files.
DAYS, ERROR_BYTES, ERROR_FILES = 30, 500 * 1024 * 1024, 90


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "module": record.module}
        row |= {"function": record.funcName, "line": record.lineno, "message": record.getMessage(), "extra": getattr(record, "extra", None)}
        return json.dumps(row, ensure_ascii=False, default=str)


def _packed(source: str, target: str) -> None:
    with open(source, "rb") as a, gzip.open(target, "wb") as b:
        shutil.copyfileobj(a, b)
    os.remove(source)


def configure(folder: str = "./logs", level: str = "INFO", as_json: bool = False, name: str = "codeloom") -> logging.Logger:
    """The engine's logger with its three sinks; called again, it replaces them."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(name)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    console = logging.StreamHandler()
    daily = TimedRotatingFileHandler(os.path.join(folder, "daily.log"), when="midnight", backupCount=DAYS, utc=True, encoding="utf-8")
    errors = RotatingFileHandler(os.path.join(folder, "errors.log"), maxBytes=ERROR_BYTES, backupCount=ERROR_FILES, encoding="utf-8")
    lines = JsonLines() if as_json else logging.Formatter("%(asctime)s | %(levelname)s | %(module)s:%(lineno)d | %(message)s")
    for h, least in ((console, level), (daily, "DEBUG"), (errors, "ERROR")):
        h.setLevel(least)
        h.setFormatter(lines)
        log.addHandler(h)
    for h in (daily, errors):
        h.namer, h.rotator = (lambda n: f"{n}.gz"), _packed
    log.setLevel("DEBUG")
    log.propagate = False
    return log
