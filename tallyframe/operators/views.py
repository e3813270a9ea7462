"""Enriched views and lookups.

The accounts table is the dimension: one row per account, orders of magnitude
smaller than the transaction fact table. It is joined without a hint: Spark broadcasts
it where its measured size is under the threshold. Where it is not, rows are dealt by
account and a salt (each account stands once for each salt), so a hot account's
rows are spread over SALTS tasks, in the join and in an aggregate above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_currency

# Account types counted as liabilities.
LIABILITY_TYPES = ["credit", "loan"]


# Source labels that stored rules and saved queries test for; the first
# whose column is set (or true) wins, else "unknown".
SOURCE_LABELS = {"sf_id": "simplefin", "lf_id": "lunchflow", "csv_batch_id": "csv_import",
                 "parent_transaction_id": "split", "is_manual": "manual"}


def source_label() -> Column:
    """V2: where a transaction came from; first match wins."""
    label = F
    for name, value in SOURCE_LABELS.items():
        label = label.when(F.col(name) if name == "is_manual" else F.col(name).isNotNull(), F.lit(value))
    return label.otherwise(F.lit("unknown"))


def active(transactions: DataFrame) -> DataFrame:
    """Reads skip soft-deleted rows (existence checks do not)."""
    return transactions.where(F.col("deleted_at").isNull())


SALTS = 8


def with_accounts(rows: DataFrame, accounts: DataFrame, row_id: str) -> DataFrame:
    """The rows with the columns of their account (null where there is none)."""
    salted = accounts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash(row_id), F.lit(SALTS))
    return rows.withColumn("_salt", salt).join(salted, ["account_id", "_salt"], "left").drop("_salt")


def transactions_view(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Non-deleted transactions + account columns + source."""
    acc = accounts.select(
        "account_id",
        F.col("name").alias("account_name"),
        "account_type",
        F.col("currency").alias("account_currency"),
        "institution_name",
    )
    return with_accounts(active(transactions), acc, "transaction_id").withColumn("source", source_label())


def classification(account_type: Column, override: Column | None = None) -> Column:
    """V6: an override wins; else credit/loan are liabilities, the rest assets."""
    computed = (F.when(F.lower(F.coalesce(account_type, F.lit(""))).isin(*LIABILITY_TYPES),
                       F.lit("liability")).otherwise(F.lit("asset")))
    return computed if override is None else F.coalesce(override, computed)


def classified_accounts(accounts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """V6 + N11: classification and normalised currency per account."""
    if overrides is not None:
        accounts = accounts.join(
            overrides.select("account_id", "classification_override"), "account_id", "left")
        cls = classification(F.col("account_type"),
                             F.coalesce(F.col("classification_override"), F.col("classification")))
    else:
        cls = classification(F.col("account_type"), F.col("classification"))
    return accounts.withColumn("classification", cls) \
        .withColumn("currency", norm_currency(F.col("currency")))


def invalid_accounts(accounts: DataFrame) -> DataFrame:
    """V9: name and currency must be non-blank."""
    blank_name = F.trim(F.coalesce(F.col("name"), F.lit(""))) == ""
    blank_ccy = F.trim(F.coalesce(F.col("currency"), F.lit(""))) == ""
    return (accounts.where(blank_name | blank_ccy)
            .select("account_id",
                    F.when(blank_name, F.lit("name")).otherwise(F.lit("currency")).alias("problem")))


def latest_balances(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot per account (ties: later created_at, then id).

    One aggregate with map-side partial max_by: a hot account costs one row
    per map task before the shuffle, not all its snapshots.
    """
    order = F.struct("snapshot_time", "created_at", "snapshot_id")
    return snapshots.groupBy("account_id").agg(
        F.max_by(F.col("balance"), order).alias("balance"),
        F.max("snapshot_time").alias("balance_time"),
    )


def accounts_with_balance(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Accounts left-joined with their latest snapshot balance."""
    return accounts.drop("balance").join(latest_balances(snapshots), "account_id", "left")


def snapshots_view(snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """Snapshots with account and institution name."""
    acc = accounts.select("account_id", F.col("name").alias("account_name"), "institution_name")
    return snapshots.join(acc, "account_id", "left")


def snapshots_in_range(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """V8: inclusive on the date part of the snapshot time."""
    d = F.to_date(F.col("snapshot_time"))
    return snapshots.where(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def snapshots_of(snapshots: DataFrame, account_id: str) -> DataFrame:
    """O2: one account's snapshots, newest first (id breaks ties)."""
    return snapshots.where(F.col("account_id") == account_id).orderBy(
        F.col("snapshot_time").desc(), F.col("snapshot_id").desc())


def transactions_in_range(transactions: DataFrame, start: str, end: str) -> DataFrame:
    """Non-deleted transactions with start <= date <= end (pushed to the scan)."""
    return active(transactions).where(
        F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def json_id_backfill(transactions: DataFrame) -> DataFrame:
    """V7: typed provider columns read out of the external_ids JSON blob.

    A key with a dot in it needs the single-quoted bracket path.
    """
    j = F.col("external_ids")
    return transactions.select(
        "transaction_id",
        F.get_json_object(j, "$.simplefin").alias("sf_id_json"),
        F.get_json_object(j, "$.lunchflow").alias("lf_id_json"),
        F.get_json_object(j, "$['csv_import.batch_id']").alias("csv_batch_id_json"),
        F.get_json_object(j, "$.fingerprint").alias("fingerprint_json"),
        F.coalesce(F.get_json_object(j, "$.manual").cast("boolean"), F.lit(False))
         .alias("is_manual_json"),
    )


def rank_newest_first(tx: DataFrame) -> DataFrame:
    """O1: position of each transaction in its account, newest date first.

    A window over a whole account would put a hot account (a third of all
    rows) in one task. Instead: rows per (account, day) are counted (an
    aggregate), a window over an account's days gives the rows of newer days
    (one row per day), and only a day's rows are ranked together.
    """
    per_day = tx.groupBy("account_id", "transaction_date").agg(F.count(F.lit(1)).alias("_n"))
    newer = (Window.partitionBy("account_id").orderBy(F.col("transaction_date").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_day.select("account_id", "transaction_date",
                             F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    in_day = Window.partitionBy("account_id", "transaction_date").orderBy(F.col("transaction_id").desc())
    return (tx.join(offsets, ["account_id", "transaction_date"])
            .withColumn("rank_in_account", (F.col("_before") + F.row_number().over(in_day)).cast("bigint"))
            .drop("_before"))
