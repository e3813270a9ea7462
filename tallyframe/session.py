"""Session helpers: one place for the Spark settings the jobs rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job assumes. Time zone is pinned so `timestamp_ntz` values and
# epoch conversions agree across executors; AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splits a hot account's partition.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints of intermediates go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # local mode: the driver JVM is the executor; size it before it starts
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyframe", extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings on a session someone else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the JVM never compiles a method of more than 8000 bytes: steps that would need one run one by one
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is set only
    where it is unset and the master is local; elsewhere that is an error, as a
    machine-local folder cannot be read by other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join("/tmp", "tallyframe-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder for written tables; it is
    removed when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tallyframe/{name}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df):
    """Cut the lineage of an intermediate read by several consumers.

    A reliable checkpoint: the rows are written once under the cluster's
    shared ``spark.checkpoint.dir`` and read back, so later stages neither
    recompute the upstream work nor depend on the executors that produced it
    (never a local checkpoint, which dies with its executor). Rows that are cut already
    are returned as they are.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRDD":
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df):
    """Rows written once as a table of columns, of which each reader reads those it needs. What
    ``materialize`` keeps is whole rows, which every reader reads in full. A table that is kept
    already is returned as it is; columns keep their types."""
    if df._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        return df
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
