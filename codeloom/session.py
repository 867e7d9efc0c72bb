"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions are coalesced at run time.

    On a cluster, ``spark.checkpoint.dir`` must name a shared folder, here or in the cluster's own settings; files
    of :mod:`codeloom.runtime.scratch` go there and are removed when they are no longer used.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()
