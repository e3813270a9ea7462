"""Structured Streaming forms of the sync dedup and of log counting.

Files may land in any order and hold rows of any age, so no watermark drops rows: ids
that were seen are keyed state without expiry, and counts are kept as partial counts of each batch, which add
up whatever the order. Sinks are Parquet tables under the cluster's shared checkpoint
folder, as are the streaming checkpoints: a restarted job resumes from its offsets, and
a repeated micro-batch overwrites its own folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1, only: str | None = None) -> DataFrame:
    """A file stream over one driver table, stored as a file or as a folder of files; ``only``
    names the files that are looked at."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    stream = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", files_per_batch))
    glob = only or (None if folder else f"{name}.parquet")
    stream = stream.option("pathGlobFilter", glob) if glob else stream
    return stream.parquet(path if folder else sf_dir)


def event_provider_ids(events: DataFrame) -> DataFrame:
    """Provider ids of landed events: cash events carry their own id, the
    others one id per user, type and day (re-sent during the overlap)."""
    et = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    pid = (F.when(et.isin("signup", "purchase"), F.concat(F.lit("ev-"), F.col("event_id").cast("string")))
           .otherwise(F.concat_ws("-", F.lit("ev"), F.col("user_id").cast("string"), et,
                                  F.date_format(ts, "yyyyMMdd"))))
    return events.select(pid.alias("provider_id"), ts.alias("ts"))


def _run(stream: DataFrame, write_batch, checkpoint: str) -> None:
    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _sink(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows written so far, with the number of their batch; none before the first batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return spark.read.schema(f"{schema}, batch_id long").parquet(out)


def stream_dedup(spark: SparkSession, sf_dir: str, ledger_ids: DataFrame) -> DataFrame:
    """New provider ids: each is written once, by the first batch that has it, unless the
    ledger has it. Returns the sink table.

    The ids seen are keyed state of the job (in the state store, by hash of the id, without
    expiry). The ledger's ids are its first input: they are written once as files, which the job takes
    in before it looks at the events. From then on a micro-batch reads its own files and the state of its
    own keys, neither the ledger nor the sink. A restarted job goes on with its state and offsets.
    """
    out, checkpoint, seed = (scratch_path(spark, f"stream-dedup{x}") for x in ("", "-ckpt", "-ledger"))
    ledger_ids.select(F.col("transaction_id").alias("provider_id")).write.parquet(seed)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.where("arrived").drop("arrived").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _state_store(spark):
        # the same job twice: first without files of events, so that all ledger ids are state
        for events in (table_stream(spark, sf_dir, "events", only="none*"), table_stream(spark, sf_dir, "events")):
            _run(dedup_stream(spark, seed, events), write_batch, checkpoint)
    return _sink(spark, out, "provider_id string").drop("batch_id")


def dedup_stream(spark: SparkSession, seed: str, events: DataFrame) -> DataFrame:
    """provider_id and arrived (false: from the ledger): the first row of each id."""
    known = spark.readStream.schema("provider_id string").parquet(seed).withColumn("arrived", F.lit(False))
    arrived = event_provider_ids(events).select("provider_id", F.lit(True).alias("arrived"))
    return known.unionByName(arrived).dropDuplicates(["provider_id"])


@contextmanager
def _state_store(spark: SparkSession):
    """State larger than memory: RocksDB, kept with the checkpoint, unless the session names another store."""
    name, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    if before.endswith("HDFSBackedStateStoreProvider"):  # the default
        spark.conf.set(name, ours)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-day counts of log events per type: partial counts of each batch, added up on read."""
    out, checkpoint = scratch_path(spark, "stream-logs"), scratch_path(spark, "stream-logs-ckpt")
    events = table_stream(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    _run(events, write_batch, checkpoint)
    return (_sink(spark, out, "day date, event_type string, n bigint")
            .groupBy("day", "event_type").agg(F.sum("n").alias("n")))
