"""Intermediate tables in the folder all executors share, and components of links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

FILTER_BITS, FILTER_CHUNK = 25, 16


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table under spark.checkpoint.dir, read again: later jobs neither
    repeat the work nor depend on the executors that did it. Removed when the session's
    JVM ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over the links, for every id in them.

    Each round every node hooks on to its smallest neighbour below it, and the links move to
    the nodes hooked on to. At least half of the nodes that still have links go in each
    round, so the number of rounds grows with the logarithm of the largest component."""
    links = written(links.where(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "links")
    labels = None
    while True:
        hooks = links.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("up"))
        if labels is None:
            roots = links.select(F.col("low").alias("id")).distinct().join(hooks.select("id"), "id", "left_anti")
            labels = hooks.select("id", F.col("up").alias("component")).union(roots.select("id", F.col("id").alias("component")))
        else:
            labels = (labels.join(hooks.withColumnRenamed("id", "component"), "component", "left")
                      .select("id", F.coalesce("up", "component").alias("component")))
        labels = written(labels, "labels")
        low = hooks.select(F.col("id").alias("low"), F.col("up").alias("low_up"))
        moved = (links.join(hooks, links["high"] == hooks["id"]).select("up", "low")
                 .join(low, "low", "left").select("up", F.coalesce("low_up", "low").alias("low")))
        links = written(moved.where("up != low").select(F.greatest("up", "low").alias("high"), F.least("up", "low").alias("low"))
                        .distinct(), "links")
        if links.isEmpty():
            return labels


def may_be_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose long `column` may be in the column of this name of `wanted`."""
    return split_by(rows, column, wanted)[0]


def split_by(rows: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose long `column` may be in the column of this name of `wanted`, and those
    where it surely isn't.

    A bit map of hashes, 4 MB whatever the input, keeps most of the latter from being
    shuffled to the join that decides; where very many are wanted, all rows pass."""
    size = 1 << FILTER_CHUNK
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS))

    def bits(batches):
        found = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            found[batch.column(0).to_numpy()] = True
        for i in np.flatnonzero(found.reshape(-1, size).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.packbits(found[i * size:(i + 1) * size]).tobytes()])], names=["chunk", "bits"])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(size // 8, np.uint8)
        for part in pdf["bits"]:
            whole |= np.frombuffer(part, np.uint8)
        return pd.DataFrame({"chunk": [key[0]], "bits": [whole.tobytes()]})

    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in (wanted.select(at.alias("at")).mapInArrow(bits, "chunk int, bits binary").groupBy("chunk")
              .applyInPandas(merge, "chunk int, bits binary").collect()):
        table[r["chunk"] * size // 8:(r["chunk"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    found = hit(F.coalesce(at, F.lit(0)))
    return rows.where(found), rows.where(~found)
