"""Known-id filter, merges of batches with repeated keys, stored tables, keyed streaming state."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import dedup, known, merge
from tallyframe.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_loses_nothing_and_leaves_most_out(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k string, id long"))
    keys = rows.where("id % 100 = 7 or id = -1").select(F.col("k").alias("key"))
    left = known.may_be_in(rows, "k", keys, "key")
    assert left.columns == ["k", "id"]
    got = {r.id for r in left.collect()}
    assert set(range(7, 20_000, 100)) <= got and len(got) < 220
    assert known.may_be_in(rows, "k", keys.limit(0), "key").count() == 0


def test_ledger_rows_are_filtered_before_they_are_shuffled(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 9)], "sf_id string, pos int")
    ledger = spark.createDataFrame([("b",), ("c",), (None,)], "sf_id string")
    new = dedup.new_by_provider_id(batch, "sf_id", ["pos"], ledger, "sf_id")
    assert [tuple(r) for r in new.collect()] == [("a", 1)]
    assert "BroadcastHashJoin" in plan(new) and "bit_or" in plan(new)


def brute_merge(existing, batch, key, precedence, columns):
    """Rows one after the other, as single upserts."""
    rule = {c: r for r, cs in precedence.items() for c in cs}
    table = {r[key]: dict(r) for r in existing}
    for row in batch:
        old = table.get(row[key])
        if old is None:
            table[row[key]] = dict(row)
            continue
        for c in columns:
            r = rule.get(c, "incoming")
            if r == "incoming" or (r == "incoming_first" and row[c] is not None) or (r == "existing_first" and old[c] is None):
                old[c] = row[c]
    return sorted((tuple(r[c] for c in [key, *columns]) for r in table.values()), key=str)


SCHEMA = "transaction_id string, amount int, is_manual boolean, sf_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def rows_of(*rows):
    return [dict(zip(["transaction_id", "amount", "is_manual", "sf_id", "created_at", "updated_at"], r)) for r in rows]


OLD = rows_of(("a", 1, None, "s1", T0, T0), ("b", 2, True, None, T0, T0), ("c", 3, False, None, None, T0))
BATCH = rows_of(*[("a", 10, None, None, T0, T0.replace(day=2)), ("a", 11, True, "s2", T0, T0.replace(day=3)), ("a", None, False, None, T0, T0.replace(day=4)),
                  ("n", 5, None, "s5", T0, T0.replace(day=2)), ("n", 6, True, None, T0.replace(day=9), T0.replace(day=3)), ("b", 7, False, "s7", T0, T0.replace(day=2))])


def test_a_key_twice_in_a_batch_is_merged_twice(spark):
    old, batch = spark.createDataFrame([tuple(r.values()) for r in OLD], SCHEMA), spark.createDataFrame([tuple(r.values()) for r in reversed(BATCH)], SCHEMA)
    columns = batch.columns[1:]
    want = brute_merge(OLD, BATCH, "transaction_id", merge.TRANSACTION_PRECEDENCE, columns)
    got = merge.merge_transactions(old, batch).select("transaction_id", *columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert merge.merge_transactions(old, batch.limit(0)).count() == 3 and merge.merge_transactions(old.limit(0), batch).count() == 3


def test_stored_tables_rewrite_the_parts_of_the_batch_alone(spark, tmp_path):
    old = spark.range(500).select(F.col("id").cast("string").alias("transaction_id"), F.lit(1).alias("amount"))
    path = str(tmp_path / "ledger")
    merge.store(old, path, "transaction_id", 8)
    before = {p: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "ledger").glob("part=*")}
    batch = spark.createDataFrame([("17", 5), ("17", 5), ("new", 6)], "transaction_id string, amount int")
    touched = merge.merge_stored(spark, path, 8, old.schema, batch, "transaction_id", merge.TRANSACTION_PRECEDENCE)
    assert 1 <= len(touched) <= 2
    after = {p: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "ledger").glob("part=*")}
    assert {int(p.name.split("=")[1]) for p in after if before.get(p) != after[p]} == set(touched)
    got = {r.transaction_id: r.amount for r in merge.stored(spark, path, old.schema).collect()}
    assert got == {str(i): 1 for i in range(500)} | {"17": 5, "new": 6}
    text = plan(merge.stored(spark, path, old.schema, touched))
    assert "PartitionFilters: [part" in text
    assert merge.merge_stored(spark, path, 8, old.schema, batch.limit(0), "transaction_id", merge.TRANSACTION_PRECEDENCE) == []


def test_a_micro_batch_reads_state_and_not_the_ledger(spark, sf_small, tmp_path):
    spark.createDataFrame([("ev-0",)], "provider_id string").write.parquet(str(tmp_path / "seed"))
    stream = jobs.dedup_stream(spark, str(tmp_path / "seed"), jobs.table_stream(spark, sf_small, "events"))
    seen = []
    with jobs._state_store(spark):
        q = (stream.writeStream.foreachBatch(lambda df, i: df.count()).option("checkpointLocation", str(tmp_path / "ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        seen = [s for p in q.recentProgress for s in p.stateOperators]
        text = q._jsq.explainInternal(False) if hasattr(q._jsq, "explainInternal") else ""
    assert seen and all(s.operatorName == "dedupe" for s in seen)
    assert "StreamingDeduplicate" in text or text == "" or "No physical plan" in text
    assert "Join" not in text
