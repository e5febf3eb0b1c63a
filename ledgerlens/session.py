"""Spark session and checkpoint-directory helpers.

On a cluster the session comes from the platform; ``configure`` only fills in
what is unset so that cluster settings win. ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and sets one only when it is missing
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Time zone matters: the tx view
# turns naive timestamps into epoch microseconds, which must be UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "ledgerlens",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL settings the operators need to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint directory of this session.

    The cluster names it in ``spark.checkpoint.dir``; we only set our own when
    it is unset: ``fallback`` or LEDGERLENS_CHECKPOINT_DIR, or, with a local
    master only, a temporary folder; elsewhere an unset folder is an error. Iterative operators write their
    per-round state below it, so that lost executors never lose lineage.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = fallback or os.environ.get("LEDGERLENS_CHECKPOINT_DIR")
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")  # one machine: driver and executors share it
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
