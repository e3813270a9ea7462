"""Table changes as pure functions old-table, changes -> new-table (M1-M9).

Plain parquet tables have no MERGE / UPDATE / DELETE; each function returns
the next version of a table, which the caller writes as a new version
directory, or the parts it touches of a table stored by key. Merges join the table with
one row per key of the batch and apply per-column precedence (no row-at-a-time upserts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .known import may_be_in

# Per-column precedence of the account upsert (M1).
ACCOUNT_PRECEDENCE = {
    "incoming": ["name", "currency", "updated_at"],
    "existing_first": ["nickname", "account_type", "classification", "is_manual"],
    "incoming_first": ["institution_name", "institution_url", "institution_domain",
                       "sf_id", "sf_name", "sf_currency", "sf_balance", "sf_available_balance",
                       "sf_balance_date", "sf_org_name", "sf_org_url", "sf_org_domain", "sf_extra",
                       "lf_id", "lf_name", "lf_institution_name", "lf_institution_logo",
                       "lf_provider", "lf_currency", "lf_status"],
    "existing": ["created_at"],
}

# Per-column precedence of the transaction upsert (M2).
TRANSACTION_PRECEDENCE = {
    "incoming": ["account_id", "amount", "description", "transaction_date", "posted_date",
                 "tags", "parent_transaction_id", "updated_at"],
    "existing_first": ["is_manual", "tags_auto_applied"],
    "incoming_first": ["csv_fingerprint", "csv_batch_id", "sf_id", "sf_posted", "sf_amount",
                       "sf_description", "sf_transacted_at", "sf_pending", "sf_extra",
                       "lf_id", "lf_account_id", "lf_amount", "lf_currency", "lf_date",
                       "lf_merchant", "lf_description", "lf_is_pending"],
    "existing": ["created_at", "deleted_at"],
}


def _resolve(col: str, rule: str, has_e: Column, has_i: Column) -> Column:
    e, i = F.col(f"e.{col}"), F.col(f"i.{col}")
    if rule == "incoming":          # always the incoming value on a match
        return F.when(has_i, i).otherwise(e)
    if rule == "existing_first":    # keep the existing value unless it is null
        return F.when(has_e, F.coalesce(e, i)).otherwise(i)
    if rule == "incoming_first":    # take the incoming value unless it is null
        return F.when(has_i, F.coalesce(i, e)).otherwise(e)
    return F.when(has_e, e).otherwise(i)  # "existing": never overwritten


def one_per_key(incoming: DataFrame, key: str, precedence: dict[str, list[str]], order: list[str] | None = None) -> DataFrame:
    """A batch with one row per key, as if its rows were merged one after the other in the order
    of ``order`` (``updated_at`` if there, then all columns): by precedence the last value,
    the last or first one that isn't null, or the first one."""
    order = order or sorted((c for c in incoming.columns if c != key), key=lambda c: c != "updated_at")
    at = F.struct(*order)
    rule_of = {c: r for r, cs in precedence.items() for c in cs}

    def value(c: str) -> Column:
        rule, given = rule_of.get(c, "incoming"), F.when(F.col(c).isNotNull(), at)
        return {"incoming": F.max_by(c, at), "incoming_first": F.max_by(c, given),
                "existing_first": F.min_by(c, given), "existing": F.min_by(c, at)}[rule].alias(c)
    return incoming.groupBy(key).agg(*[value(c) for c in incoming.columns if c != key])


def upsert(existing: DataFrame, incoming: DataFrame, key: str,
           precedence: dict[str, list[str]], order: list[str] | None = None) -> DataFrame:
    """The next version of a table: its rows, those with a row in the batch by per-column
    precedence, and the new rows. A key that the batch has twice counts as merged twice.
    Columns missing on one side are taken as null there; columns in no rule keep the incoming
    value on a match.

    The table is joined once, with one row per key of the batch (broadcast where that measures
    small); new rows are told by the few keys of the table that may be in the batch."""
    return _merged(existing, materialize(one_per_key(incoming, key, precedence, order)), key, precedence)


def _merged(existing: DataFrame, batch: DataFrame, key: str, precedence: dict[str, list[str]]) -> DataFrame:
    cols = [c for c in existing.columns if c != key]
    cols += [c for c in batch.columns if c != key and c not in cols]
    e = existing.select(key, *[F.col(c) if c in existing.columns else F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in cols])
    i = batch.select(key, F.lit(True).alias("_i"), *[F.col(c) if c in batch.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in cols])
    rule_of = {c: r for r, cs in precedence.items() for c in cs}
    merged = e.alias("e").join(i.alias("i"), F.col(f"e.{key}") == F.col(f"i.{key}"), "left").select(
        F.col(f"e.{key}").alias(key), *[_resolve(c, rule_of.get(c, "incoming"), F.lit(True), F.col("i._i").isNotNull()).alias(c) for c in cols])
    new = i.drop("_i").join(may_be_in(existing.select(key), key, batch), key, "left_anti")
    return merged.unionByName(new)


def merge_accounts(existing: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """M1."""
    return upsert(existing, incoming, "account_id", ACCOUNT_PRECEDENCE, order)


def merge_transactions(existing: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """M2."""
    return upsert(existing, incoming, "transaction_id", TRANSACTION_PRECEDENCE, order)


def store(table: DataFrame, path: str, key: str, parts: int) -> None:
    """The table as Parquet in ``parts`` folders by a hash of its key (a null key in one of its own).
    Choose parts for some 256 MB each."""
    (table.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("part")
     .write.mode("overwrite").partitionBy("part").parquet(path))


def merge_stored(spark: SparkSession, path: str, parts: int, schema: T.StructType, incoming: DataFrame, key: str,
                 precedence: dict[str, list[str]], order: list[str] | None = None) -> list[int]:
    """An upsert into a stored table: only the parts that the batch's keys fall into are read
    and written again (a part is replaced when the new one is whole). Returns these parts.
    ``schema`` is that of the table without ``part``; ``parts`` as in ``store``."""
    batch = materialize(one_per_key(incoming, key, precedence, order))  # made once: for its parts and for the merge
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    touched = sorted(r["part"] for r in batch.select(part).distinct().collect())  # at most `parts` numbers
    if touched:
        new = _merged(stored(spark, path, schema, touched).select(*schema.names), batch, key, precedence)
        new = new.select(*schema.names).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        (new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part").parquet(path))
    return touched


def stored(spark: SparkSession, path: str, schema: T.StructType, parts: list[int] | None = None) -> DataFrame:
    """A stored table, or some of its parts (pruned before files are read)."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    # the null matches nothing; with it one part is a list in the plan too, as several are
    return df if parts is None else df.where(F.col("part").isin([*parts, None]))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M3: insert only rows whose key is absent (user edits are kept).
    Returns (new table, per-incoming-key 'inserted' flag)."""
    known = existing.select(key).withColumn("_known", F.lit(True))
    flagged = incoming.join(known, key, "left").withColumn("inserted", F.col("_known").isNull())
    absent = flagged.where("inserted").select(*incoming.columns)
    return existing.unionByName(absent, allowMissingColumns=True), flagged.select(key, "inserted")


def delete_accounts_cascade(accounts: DataFrame, transactions: DataFrame, snapshots: DataFrame,
                            doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: drop the accounts' transactions, then snapshots, then the accounts."""
    ids = doomed.select("account_id")
    return (accounts.join(ids, "account_id", "left_anti"),
            transactions.join(ids, "account_id", "left_anti"),
            snapshots.join(ids, "account_id", "left_anti"))


def soft_delete(transactions: DataFrame, ids: DataFrame, as_of_ts: str) -> DataFrame:
    """M5: set deleted_at on the listed, not yet deleted rows."""
    hit = ids.select("transaction_id").distinct().withColumn("_hit", F.lit(True))
    return (transactions.join(hit, "transaction_id", "left")
            .withColumn("deleted_at",
                        F.when(F.col("_hit") & F.col("deleted_at").isNull(),
                               F.expr(f"TIMESTAMP_NTZ '{as_of_ts}'"))
                        .otherwise(F.col("deleted_at")))
            .drop("_hit"))


def split_check(transactions: DataFrame) -> DataFrame:
    """M6: children of a split (parent hidden, children shown) should sum to
    the parent's amount; parents that do not exist are reported too."""
    kids = (transactions.where(F.col("parent_transaction_id").isNotNull()
                               & F.col("deleted_at").isNull())
            .groupBy(F.col("parent_transaction_id").alias("transaction_id"))
            .agg(F.count(F.lit(1)).alias("n_children"),
                 F.sum("amount").cast("decimal(18,2)").alias("children_total")))
    parents = transactions.select("transaction_id", F.col("amount").alias("parent_amount"))
    return (kids.join(parents, "transaction_id", "left")
            .withColumn("balanced", F.coalesce(F.col("children_total") == F.col("parent_amount"),
                                               F.lit(False))))


def update_snapshots(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """M8: new balance and / or source for listed snapshot ids (a null in the
    change keeps the current value)."""
    ch = changes.select("snapshot_id", F.col("balance").alias("_b"), F.col("source").alias("_s"))
    return (snapshots.join(ch, "snapshot_id", "left")
            .withColumn("balance", F.coalesce(F.col("_b"), F.col("balance")))
            .withColumn("source", F.coalesce(F.col("_s"), F.col("source")))
            .drop("_b", "_s"))
