"""Versions of a project as Merkle trees: diffs that descend into changed folders only, moves, and re-extraction of changed files.

A version is a table of nodes (path, parent, name, depth, is_dir, hash), stored by depth and by a hash of the parent. A
file's hash is that of its content, a folder's that of its children's names, kinds and hashes, made level by level from the deepest. A
diff starts at the roots and follows, level by level, the folders whose hashes differ: it reads the buckets of their children and nothing of
folders that are the same. Contents are read only of files that changed.

Edge cases: a null or empty path is left out; of repeated paths the largest hash stands; a null content is empty. A path
that is a file in one version and a folder in the other is removed and added. Of equal contents removed and added, the n-th
removed path in order moves to the n-th added. Empty versions have a root without children. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import entities
from codeloom.runtime.scratch import Stored, cut

BUCKETS = 64
NODE = ["path", "parent", "name", "depth", "is_dir", "hash"]


def tree(files: DataFrame) -> DataFrame:
    """The nodes of the tree of ``files`` (path, content); the root's path is empty."""
    parts = F.array_remove(F.split("path", "/"), "")
    own = files.select(parts.alias("parts"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash")).filter(F.size("parts") > 0)
    own = own.select(F.array_join("parts", "/").alias("path"), F.size("parts").alias("depth"), F.element_at("parts", -1).alias("name"), "parts", "hash")
    parent = F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/")
    leaves = own.groupBy("path", "depth", "name", parent.alias("parent")).agg(F.max("hash").alias("hash"))
    level = cut(leaves.select("path", "parent", "name", "depth", F.lit(False).alias("is_dir"), "hash"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    root = level.sparkSession.createDataFrame([("", None, "", 0, True, "")], "path string, parent string, name string, depth int, is_dir boolean, hash string")
    out, folders = level, None
    for depth in range(deepest - 1, -1, -1):
        below = level.filter(F.col("depth") == depth + 1)
        below = below if folders is None else below.union(folders)
        line = F.concat_ws("\0", F.when(F.col("is_dir"), "d").otherwise("f"), "name", "hash")
        hashes = below.withColumn("h", F.sha2(line.cast("binary"), 256)).groupBy(F.col("parent").alias("path")).agg(_combined().alias("hash"))
        split = F.split("path", "/")
        parent = F.when(F.lit(depth > 0), F.array_join(F.slice(split, F.lit(1), F.lit(max(depth - 1, 0))), "/"))
        folders = cut(hashes.select("path", parent.alias("parent"), F.element_at(split, -1).alias("name"), F.lit(depth).alias("depth"), F.lit(True).alias("is_dir"), "hash"))
        out = out.union(folders)
    return out if folders is not None else out.union(root)


def _combined() -> Column:
    """A hash of the set of the children's hashes ``h``: of sums, so large folders are added up before they are shuffled."""
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(",", *sums, F.count("*").cast("string")).cast("binary"), 256)


class Version:
    """A stored tree; ``children`` reads the buckets of the given folders only."""

    def __init__(self, nodes: DataFrame):
        bucket = F.pmod(F.xxhash64(F.coalesce("parent", F.lit("/"))), F.lit(BUCKETS)).cast("int")
        self._stored = Stored(nodes.select(*NODE).withColumn("bucket", bucket).repartition("depth", "bucket"), by=("depth", "bucket"))
        self.nodes = self._stored.df

    def children(self, folders: DataFrame, depth: int) -> DataFrame:
        """The nodes at ``depth`` whose parents are in ``folders`` (path)."""
        bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
        wanted = [r["b"] for r in folders.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        near = self.nodes.filter((F.col("depth") == depth) & F.col("bucket").isin(wanted))
        return near.join(folders.select(F.col("path").alias("parent")), "parent", "left_semi").select(*NODE)

    def root(self) -> DataFrame:
        return self.nodes.filter("depth = 0").select(*NODE)

    def free(self) -> None:
        self._stored.free()


def diff(old: Version, new: Version) -> DataFrame:
    """(path, change, before): files added, removed, changed, or moved from ``before``."""
    spark = old.nodes.sparkSession
    roots = old.root().select(F.col("hash").alias("h")).crossJoin(F.broadcast(new.root().select("path", "hash")))  # one row each
    left = right = cut(roots.filter("h <> hash").select("path"))
    files, depth = None, 0
    while not (left.isEmpty() and right.isEmpty()):
        depth += 1
        a = old.children(left, depth).select("path", "is_dir", F.col("hash").alias("before"))
        b = new.children(right, depth).select("path", "is_dir", F.col("hash").alias("after"))
        level = cut(a.join(b, ["path", "is_dir"], "full").filter("not (before <=> after)"))
        own = level.filter("not is_dir").select("path", "before", "after")
        files = own if files is None else files.union(own)
        folders = level.filter("is_dir")
        left, right = folders.filter("before is not null").select("path"), folders.filter("after is not null").select("path")
    if files is None:
        return spark.createDataFrame([], "path string, change string, before string")
    files = cut(files)
    order = lambda h: Window.partitionBy(h).orderBy("path")
    gone = files.filter("after is null").select("path", F.col("before").alias("hash"), F.row_number().over(order("before")).alias("k"))
    come = files.filter("before is null").select("path", F.col("after").alias("hash"), F.row_number().over(order("after")).alias("k"))
    moved = come.join(gone.withColumnRenamed("path", "from"), ["hash", "k"], "full")
    moves = moved.select(
        F.coalesce("path", "from").alias("path"),
        F.when(F.col("from").isNull(), "added").when(F.col("path").isNull(), "removed").otherwise("moved").alias("change"),
        F.when(F.col("path").isNotNull(), F.col("from")).alias("before"),
    )
    changed = files.filter("before is not null and after is not null").select("path", F.lit("changed").alias("change"), F.lit(None).cast("string").alias("before"))
    return changed.union(moves)


def reindexed(known: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """The entities of the new version: those ``known`` of files that are the same, and new ones of files that aren't.

    ``changes`` is a :func:`diff`; ``files`` (path, content) the new version's. Only changed, added and moved files are parsed.
    """
    parts = F.array_join(F.array_remove(F.split("path", "/"), ""), "/")
    stale = changes.select("path").union(changes.filter("before is not null").select("before")).distinct()
    fresh = changes.filter("change <> 'removed'").select("path")
    again = files.withColumn("path", parts).join(fresh, "path", "left_semi")
    kept = known.withColumn("path", parts).join(stale, "path", "left_anti")
    return kept.select(*known.columns).union(entities.extract(again).select(*known.columns))
