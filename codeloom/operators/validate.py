"""Validators: each maps a column to an error struct (field, code), null where the value is valid.

``errors`` gathers them per row in one array; ``quarantine`` splits rows by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


def failed(bad: Column, field: str, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


def not_null(c: Column, field: str) -> Column:
    return failed(c.isNull(), field, "null")


#: White space at the ends of a string, Unicode's separators and controls with it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def not_empty(c: Column, field: str, kind: str = "string") -> Column:
    """Neither null nor blank; of other kinds: a collection without elements, zero and false are empty."""
    empty = {
        "string": lambda: c.rlike(rf"\A{BLANK}*\z"),
        "collection": lambda: F.size(c) == 0,
        "number": lambda: c == 0,
        "boolean": lambda: ~c,
    }[kind]()
    return failed(c.isNull() | empty, field, "empty")


def of_type(c: Column, field: str, kind: str) -> Column:
    """A string that reads as ``kind``."""
    return failed(c.isNull() | c.try_cast(kind).isNull(), field, "type")


def length(c: Column, field: str, lo: int, hi: int) -> Column:
    return failed(~F.char_length(c).between(lo, hi), field, "length")


def in_range(c: Column, field: str, lo: float, hi: float) -> Column:
    """Inclusive; NaN passes, as it compares with nothing."""
    return failed(~(F.isnan(c) | c.between(lo, hi)), field, "range")


def email(c: Column, field: str) -> Column:
    return failed(~(F.char_length(c).between(3, 254) & c.rlike(EMAIL)), field, "email")


def email_normalised(c: Column) -> Column:
    t = stripped(c)
    return F.concat(F.substring_index(t, "@", 1), F.lit("@"), F.lower(F.substring_index(t, "@", -1)))


def regex(c: Column, field: str, pattern: str, flags: str = "") -> Column:
    """Anchored at the start only; ``flags`` of i, s, m."""
    anchored = (f"(?{flags})" if flags else "") + rf"\A(?:{pattern})"
    return failed(~c.rlike(anchored), field, "regex")


def json_value(c: Column, field: str) -> Column:
    return failed(F.try_parse_json(c).isNull(), field, "json")


def json_key(c: Column, field: str, key: str, kind: str) -> Column:
    """A key that must exist and read as ``kind``; the missing key is told from the wrong type."""
    v = F.get_json_object(c, f"$.{key}")
    missing = F.struct(F.lit(f"{field}.{key}").alias("field"), F.lit("missing").alias("code"))
    wrong = F.struct(F.lit(f"{field}.{key}").alias("field"), F.lit("type").alias("code"))
    return F.when(v.isNull(), missing).when(v.try_cast(kind).isNull(), wrong)


def errors(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def quarantine(df: DataFrame, *checks: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with their errors)."""
    checked = df.withColumn("errors", errors(*checks))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def path_state(paths: DataFrame, listing: DataFrame, must_exist: bool = True, must_be_file: bool = False, must_be_dir: bool = False) -> DataFrame:
    """path and code (missing, not_a_file, not_a_directory) of the paths that fail; ``listing`` has path and is_dir."""
    found = listing.groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    known = F.col("is_dir").isNotNull()
    code = F.when(F.lit(must_exist) & ~known, "missing")
    code = code.when(F.lit(must_be_file) & known & F.col("is_dir"), "not_a_file").when(F.lit(must_be_dir) & known & ~F.col("is_dir"), "not_a_directory")
    return paths.join(found, "path", "left").select("path", code.alias("code")).filter("code is not null")


def paths_missing(paths: DataFrame, listing: DataFrame, column: str = "path") -> DataFrame:
    """The paths that a listing lacks."""
    return paths.join(listing.select(column).distinct(), column, "left_anti")
