"""Scalar functions as Column builders: paths, sizes, hashes, times, versions, text decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def suffix(name: Column) -> Column:
    """``.gz`` of ``a.tar.gz``; empty for ``.gitignore`` and ``x.``."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """The name without its suffix."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def humanize(n: Column) -> Column:
    """Base-1024 size: whole bytes, else two decimals rounded half to even as the binary value is."""
    out = F.format_string("%.2f PB", F.bround(n / float(1024**5), 2))
    for k in range(4, 0, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {UNITS[k]}", F.bround(n / float(1024**k), 2))).otherwise(out)
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)
    return F.when(n < 0, F.raise_error(F.lit("a size can't be negative"))).otherwise(out)


def gigabytes(n: Column) -> Column:
    return F.round(n / float(1024**3), 2)


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest; an unknown algorithm means sha256."""
    return {
        "md5": F.md5(content),
        "sha1": F.sha1(content),
        "sha224": F.sha2(content, 224),
        "sha384": F.sha2(content, 384),
        "sha512": F.sha2(content, 512),
    }.get(algorithm, F.sha2(content, 256))


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1; line ends become ``\\n``."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return newlines(text)


def decoded_strict(content: Column) -> Column:
    """UTF-8 or an error."""
    return newlines(F.decode(content, "UTF-8"))


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def uptime(seconds: Column) -> Column:
    """``[D day[s], ]H:MM:SS`` of whole seconds."""
    s = seconds.cast("long")
    days = F.floor(s / 86400).cast("long")
    rest = s - days * 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), clock))


def iso(ts: Column) -> Column:
    """ISO 8601; the fraction is left out where it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def version_ok(version: Column, major: int = 3, minor: int = 9) -> Column:
    parts = F.split(version, "[.]")
    return (F.get(parts, F.lit(0)).try_cast("int") == major) & (F.get(parts, F.lit(1)).try_cast("int") >= minor)


def glob_regex(pattern: str) -> str:
    """A regular expression for a shell pattern on names."""
    out = ""
    for c in pattern:
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+{}()|\\[]" else c)
    return f"(?s)^{out}$"


def workflow_id(name: Column, key: Column) -> Column:
    return F.concat(name, F.lit("_"), F.substring(F.sha2(key, 256), 1, 8))


def error_message(code: Column, message: Column, cause_type: Column, cause: Column) -> Column:
    head = F.concat(F.lit("["), code, F.lit("] "), message)
    return F.when(cause_type.isNull(), head).otherwise(F.concat(head, F.lit(" | Causa: "), cause_type, F.lit(": "), cause))


def retry_wait(delay: Column, attempts: Column) -> Column:
    """All waits of linear back-off: delay, 2 delay, ..."""
    return delay * attempts * (attempts + 1) / 2


def code_language(ext: Column) -> Column:
    """Language by extension (fixed values)."""
    pairs = {
        ".py": "python",
        ".js": "javascript",
        ".ts": "typescript",
        ".java": "java",
        ".go": "go",
        ".rs": "rust",
        ".cpp": "cpp",
        ".c": "c",
        ".cs": "c_sharp",
    }
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), ext), F.lit("unknown"))
