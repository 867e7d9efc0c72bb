"""Sinks: files with backups, versioned tables, log routing with retention."""

from __future__ import annotations

import json
import os
import shutil
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime.errors import ValidationError


def write_file(path: str, content: str | bytes, encoding: str = "utf-8", backup: bool = False, now: datetime | None = None) -> str | None:
    """Write one file on the driver, with its directories; returns the backup's path if one was made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    kept = None
    if backup and os.path.exists(path):
        kept = f"{path}.backup_{(now or datetime.now()):%Y%m%d_%H%M%S}"
        shutil.copy2(path, kept)
    data = content.encode(encoding) if isinstance(content, str) else content
    with open(path, "wb") as f:
        f.write(data)
    return kept


def write_table(df: DataFrame, path: str, version: str) -> str:
    """A new version beside the older ones; nothing is overwritten in place."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_logs(logs: DataFrame, path: str, retention_days: int = 30, error_days: int = 90) -> None:
    """All lines by day, and errors apart with a longer retention, counted from the newest day that is stored.

    Only the days of ``logs`` are written (again); other days stay as they are until they are too old, then their
    folders go. Lines without a time have no day and are left out.
    """
    dated = logs.withColumn("day", F.to_date("timestamp")).filter("day is not null")
    for name, rows, days in (("daily", dated, retention_days), ("errors", dated.filter("level = 'ERROR'"), error_days)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(f"{path}/{name}")
    _expire(logs.sparkSession, path, {"daily": retention_days, "errors": error_days})


def _expire(spark: SparkSession, path: str, retention: dict[str, int]) -> None:
    """Remove the folders of days that are as old as their retention, as of the newest day of any."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for name in retention:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name)
        if files.exists(folder):
            found += [(name, x.getPath()) for x in files.listStatus(folder) if x.getPath().getName().startswith("day=")]
    day = lambda p: date.fromisoformat(p.getName()[len("day=") :])
    newest = max((day(p) for _, p in found), default=None)
    for name, p in found:
        if day(p) <= newest - timedelta(days=retention[name]):
            files.delete(p, True)


def export(df: DataFrame, form: str = "json", most: int = 10_000) -> str:
    """A small report (an error beyond ``most`` rows) as JSON, YAML or text lines."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValidationError("a report is too long to export", field="rows", actual_length=len(found))
    rows = [r.asDict(recursive=True) for r in found]
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    if form == "yaml":
        # JSON is YAML; one entry a line, so that it reads as a list.
        return "".join(f"- {json.dumps(r, ensure_ascii=False, default=str)}\n" for r in rows)
    return "\n".join(", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows)
