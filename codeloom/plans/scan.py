"""Scan, text and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import scalars as s
from codeloom.operators import scanning, versions
from codeloom.operators.validate import stripped
from codeloom.plans import views as v
from codeloom.plans.views import Family

family = Family()
#: Extensions that are left out (fixed values).
KEPT = "ext NOT IN ('.pyc', '.pyo', '.pyd', '.so', '.dll', '.exe', '.bin', '.class', '.jar')"
SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"
LIMIT = 4096


@family.add(f"SELECT dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM files WHERE {KEPT} AND size <= 10485760 AND dir NOT IN ('src1', 'src2') GROUP BY dir")
def scan_project(spark, d):
    kept = scanning.kept(v.files(spark, d), excluded_dirs=("src1", "src2"))
    return kept.groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))


@family.add(f"SELECT doc_id, name, size FROM files WHERE {KEPT} AND size <= {LIMIT}")
def scan_filter(spark, d):
    return scanning.kept(v.files(spark, d), max_bytes=LIMIT).select("doc_id", "name", "size")


@family.add(f"SELECT count(*) AS total_files, count(DISTINCT dir) AS total_dirs FROM files WHERE {KEPT} AND size <= 10485760")
def scan_metadata(spark, d):
    return scanning.metadata(scanning.kept(v.files(spark, d)))


@family.add("SELECT dir, name FROM files WHERE regexp_matches(name, '^[^/]*[.][^/]*s$')")
def list_files_glob(spark, d):
    return v.files(spark, d).filter(F.col("name").rlike(s.glob_regex("*.*s"))).select("dir", "name")


@family.add(f"SELECT doc_id, dir || '/' || name AS path, name, {SUFFIX} AS suffix, left(name, CAST(length(name) - length({SUFFIX}) AS BIGINT)) AS stem, dir AS parent FROM files")
def path_parts(spark, d):
    f = v.files(spark, d).withColumn("path", F.concat_ws("/", "dir", "name"))
    name = s.base_name(F.col("path"))
    return f.select("doc_id", "path", name.alias("name"), s.suffix(name).alias("suffix"), s.stem(name).alias("stem"), s.parent(F.col("path")).alias("parent"))


@family.add("SELECT doc_id, sha256(content) AS sha256, md5(content) AS md5 FROM files")
def content_hash(spark, d):
    c = F.col("content")
    return v.files(spark, d).select("doc_id", s.content_hash(c).alias("sha256"), s.content_hash(c, "md5").alias("md5"))


HUMAN = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.2f KB', {0} / 1024.0::DOUBLE) WHEN {0} < 1073741824 THEN printf('%.2f MB', {0} / 1048576.0::DOUBLE) WHEN {0} < 1099511627776 THEN printf('%.2f GB', {0} / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', {0} / 1099511627776.0::DOUBLE) END"


@family.add(f"SELECT doc_id, name, {SUFFIX} AS suffix, dir AS parent, size, {HUMAN.format('size')} AS size_human, sha256(content) AS hash_sha256 FROM files")
def file_info(spark, d):
    n = F.col("name")
    return v.files(spark, d).select(
        "doc_id", "name", s.suffix(n).alias("suffix"), F.col("dir").alias("parent"), "size",
        s.humanize(F.col("size")).alias("size_human"), s.content_hash(F.col("content")).alias("hash_sha256"),
    )


@family.add(r"SELECT page_id, md5(regexp_replace(replace(html, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g')) AS text_md5, length(html) AS n_chars FROM pages")
def read_text_normalize(spark, d):
    raw = F.encode(F.replace(F.col("html"), F.lit("\n"), F.lit("\r\n")), "UTF-8")
    text = s.decoded(raw)
    return v.read(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@family.add("SELECT page_id, length(html) AS n_chars FROM pages")
def read_text_strict(spark, d):
    return v.read(spark, d, "pages").select("page_id", F.length(s.decoded_strict(F.encode("html", "UTF-8"))).cast("long").alias("n_chars"))


@family.add(f"SELECT doc_id, {HUMAN.format('(size * CAST(doc_id AS BIGINT) * 37)')} AS human FROM files")
def humanize_bytes(spark, d):
    return v.files(spark, d).select("doc_id", s.humanize(F.col("size") * F.col("doc_id") * 37).alias("human"))


@family.add("SELECT doc_id, round(size * 1000003 / 1073741824.0::DOUBLE, 2) AS gb FROM files")
def bytes_to_gb(spark, d):
    return v.files(spark, d).select("doc_id", s.gigabytes(F.col("size") * 1000003).alias("gb"))


@family.add(
    "SELECT event_id, CASE WHEN x // 86400 = 0 THEN '' WHEN x // 86400 = 1 THEN '1 day, ' ELSE (x // 86400) || ' days, ' END || printf('%d:%02d:%02d', x % 86400 // 3600, x % 3600 // 60, x % 60) AS uptime FROM (SELECT event_id, event_id * 97 AS x FROM events)"
)
def uptime_text(spark, d):
    return v.ev(spark, d).select("event_id", s.uptime(F.col("event_id") * 97).alias("uptime"))


@family.add("SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS backup FROM events")
def iso_timestamp(spark, d):
    ts = F.col("ts")
    return v.ev(spark, d).select("event_id", s.iso(ts).alias("iso"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("backup"))


@family.add("SELECT event_id, version, user_id % 4 = 3 AND k % 15 >= 9 AS ok FROM (SELECT *, (user_id % 4) || '.' || (k % 15) || '.1' AS version FROM ev)")
def version_gate(spark, d):
    e = v.ev(spark, d).withColumn("version", F.concat_ws(".", F.col("user_id") % 4, F.col("k") % 15, F.lit("1")))
    return e.select("event_id", "version", s.version_ok(F.col("version")).alias("ok"))


SUFFIXES = (*v.LANGUAGES, ".php", ".md", "")


@family.add(
    f"SELECT ext, count(*) AS n, {v._case('ext', v.LANGUAGES).replace(' END', " ELSE 'unknown' END")} AS language FROM (SELECT ({list(SUFFIXES)})[CAST(doc_id % {len(SUFFIXES)} AS INTEGER) + 1] AS ext FROM documents) GROUP BY ext"
)
def language_detect(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return v.read(spark, d, "documents").select(ext.alias("ext")).groupBy("ext").agg(F.count("*").alias("n")).withColumn("language", s.code_language(F.col("ext")))


@family.add(
    "SELECT doc_id, len(string_split(content, chr(10))) AS n_lines, len(list_filter(string_split(content, chr(10)), lambda x: trim(x) = '')) AS blank_lines, round(len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, 'The'))) / len(string_split(content, chr(10))), 6) AS comment_density FROM files"
)
def code_metrics(spark, d):
    lines = F.split("content", "\n")
    marked = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("The"))))
    return v.files(spark, d).select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: stripped(x) == "")).cast("long").alias("blank_lines"),
        F.round(marked / F.size(lines), 6).alias("comment_density"),
    )


@family.add(
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h"
)
def change_detect(spark, d):
    t = v.read(spark, d, "documents").select("doc_id", "text")
    old = t.filter("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = t.filter("doc_id % 10 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return scanning.changes(old, new, "doc_id")


def _versions(spark, d):
    """Two versions of a project: files gone, new, changed and under another path."""
    i = F.col("doc_id")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/d"), i % 13, F.lit("/"), i, F.lit(".txt"))
    t = v.read(spark, d, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    new = t.filter(i % 10 != 2).select(F.when(i % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(i % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return t.filter(i % 10 != 1).select("path", "content"), new


@family.add(
    """WITH t AS (SELECT doc_id AS i, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/d' || (doc_id % 13) || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents),
  o AS (SELECT path, sha256(content) AS h FROM t WHERE i % 10 <> 1),
  n AS (SELECT CASE WHEN i % 11 = 0 THEN 'moved/' ELSE '' END || path AS path, sha256(content || CASE WHEN i % 7 = 0 THEN '!' ELSE '' END) AS h FROM t WHERE i % 10 <> 2),
  r AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM o WHERE path NOT IN (SELECT path FROM n)),
  a AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM n WHERE path NOT IN (SELECT path FROM o))
SELECT o.path, 'changed' AS change, NULL AS before FROM o JOIN n ON n.path = o.path AND n.h <> o.h
UNION ALL SELECT coalesce(a.path, r.path), CASE WHEN r.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'moved' END, CASE WHEN a.path IS NOT NULL THEN r.path END FROM a FULL JOIN r ON r.h = a.h AND r.k = a.k"""
)
def version_diff(spark, d):
    old, new = (versions.Version(versions.tree(x)) for x in _versions(spark, d))
    return versions.diff(old, new)


@family.add(
    "SELECT source, CASE WHEN n <= 5 THEN array_to_string(xs, ',') ELSE array_to_string(xs[1:5], ',') || ', … y ' || (n - 5) || ' más' END AS shown FROM (SELECT source, list(doc_id ORDER BY doc_id) AS xs, count(*) AS n FROM documents GROUP BY source)"
)
def report_truncate_list(spark, d):
    # Five ids of each source at most are gathered; the rest is only counted.
    t = v.read(spark, d, "documents").select("source", "doc_id")
    own = Window.partitionBy("source").orderBy("doc_id")
    top = t.withColumn("r", F.row_number().over(own)).filter("r <= 5").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("xs"))
    both = top.join(t.groupBy("source").agg(F.count("*").alias("n")), "source")
    return both.select("source", scanning.truncated(F.col("xs"), F.col("n")).alias("shown"))


QUERIES, ORACLE_SQL = family.queries, family.oracle
