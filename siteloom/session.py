"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here relies on: joins whose key may be hot are
# left to AQE, which splits oversized shuffle partitions at run time. The
# force flag keeps that split even if the plan above wants the same layout.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# To be set when a session is built: without it every expression records its
# Python call site, which costs more than planning for audits of this size.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, since a driver-local folder would
    not be visible to the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="siteloom-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_dir(spark)}/siteloom/{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table feeds several joins. The files survive the loss of an
    executor, and their size lets Spark itself choose between a broadcast and
    a shuffle join.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
