"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str = "local[*]", app: str = "storyweft", **conf: str) -> SparkSession:
    """A session with this engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the cluster names in ``spark.checkpoint.dir``, or what the session was given.

    Only a session on this machine alone (tests, a laptop) gets a temporary one; on a cluster that would lie on one node, so
    there it is an error that none is named.
    """
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"storyweft-{os.getpid()}"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Partitions for a repartition that must not be coalesced away: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
