"""Files between steps, in the folder that all machines of the cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The application's own folder below the session's ``spark.checkpoint.dir``, which all machines share.

    Where that is unset, a temporary folder is taken on a single machine only; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
        sc.setCheckpointDir(shared)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; a lost executor costs its running tasks only.

    Spark removes the files when ``df`` is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set (:func:`codeloom.session.session` does).
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """``df`` as Parquet in the shared folder, for wide rows: later reads take the columns that they need."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ()):
        spark = df.sparkSession
        path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Remove the files; ``df`` can't be read any more."""
        self._files.delete(self._path, True)


def renewed(df: DataFrame) -> DataFrame:
    """``df`` stored, so that its size is known again.

    Estimates multiply with every join and outlive checkpoints: after a dozen rounds of an iteration the numbers alone
    take seconds to multiply. Iterations call this every few rounds.
    """
    return Stored(df).df


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``most`` rows (counted, no further than that)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
