"""Session settings the operators rely on.

The session is always passed in (never built here). Only SQL confs that can be
changed at run time are touched, and a checkpoint directory is set only when the
cluster has not named one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONFS = {
    # duplicate JSON keys: last one wins, as Python's json module does
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in _RUNTIME_CONFS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session, registered once.

    A folder that is already registered stays (a second call opens no new one).  Else the one
    the cluster names in ``spark.checkpoint.dir`` is registered.  Only when both are unset *and*
    the master is local (tests) a scratch folder is created; on a cluster that is an error,
    never a machine-local fallback.
    """
    sc = spark.sparkContext
    registered = sc._jsc.sc().getCheckpointDir()
    if registered.isDefined():
        return registered.get()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder on shared storage "
                               "(a machine-local folder would not survive a lost executor)")
        d = tempfile.mkdtemp(prefix="colloquy-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared checkpoint folder, lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
