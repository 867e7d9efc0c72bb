"""Operators over file listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars

#: Directories and extensions that a scan leaves out (fixed values).
EXCLUDED_DIRS = (".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", "dist", "build")
EXCLUDED_EXTENSIONS = (".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin", ".class", ".jar")
MAX_BYTES = 10 * 1024 * 1024


def kept(files: DataFrame, max_bytes: int = MAX_BYTES, excluded_dirs: tuple = EXCLUDED_DIRS, excluded_extensions: tuple = EXCLUDED_EXTENSIONS) -> DataFrame:
    """Files (dir, ext, size) of a wanted extension and size; the size limit is inclusive."""
    wanted = ~F.col("ext").isin(*excluded_extensions) & (F.col("size") <= max_bytes)
    return files.filter(wanted & ~F.col("dir").isin(*excluded_dirs))


def metadata(files: DataFrame, scanned_at: datetime | None = None) -> DataFrame:
    """One row: files, directories and, where it is given, the time of the scan."""
    out = files.agg(F.count("*").alias("total_files"), F.count_distinct("dir").alias("total_dirs"))
    return out.withColumn("scanned_at", F.lit(scanned_at)) if scanned_at else out


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of two snapshots (key, hash); unchanged rows don't appear."""
    o = old.select(F.col(key).alias("ok"), F.col("hash").alias("oh"))
    n = new.select(F.col(key).alias("nk"), F.col("hash").alias("nh"))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").otherwise("modified")
    both = o.join(n, F.col("ok") == F.col("nk"), "full").filter(~F.col("oh").eqNullSafe(F.col("nh")))
    return both.select(F.coalesce("ok", "nk").alias(key), change.alias("change"))


def truncated(xs: Column, n: Column, most: int = 5) -> Column:
    """The first elements joined, and how many more there are."""
    head = F.array_join(F.slice(xs, 1, most).cast("array<string>"), ",")
    return F.when(n <= most, head).otherwise(F.concat(head, F.lit(", … y "), (n - most).cast("string"), F.lit(" más")))


def file_info(listing: DataFrame) -> DataFrame:
    """The thirteen fields of each entry of a source tree; sizes in words and hashes of files only."""
    path, name = F.col("path"), F.col("name")
    return listing.select(
        "path", "name", scalars.stem(name).alias("stem"), "suffix", scalars.parent(path).alias("parent"), "size_bytes",
        scalars.humanize(F.col("size_bytes")).alias("size_human"), *[scalars.iso(F.col(c)).alias(c) for c in ("created", "modified", "accessed")],
        (~F.col("is_dir")).alias("is_file"), "is_dir", scalars.content_hash(F.col("content")).alias("hash_sha256"),
    )
