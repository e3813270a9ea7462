"""The ledger workflows as whole jobs: what a user runs day to day.

Each function composes the operators into one Spark plan over DataFrames
(the ledger tables are DataFrames; nothing is collected). Results are the new
table versions and counters, for the caller to write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import balances, dedup, merge, quality, sync, tagging, views
from .plans import sql as sqlmod
from .sources import providers, statements


@dataclass
class ImportResult:
    transactions: DataFrame     # ledger after the import (new rows appended)
    new_rows: DataFrame         # the rows this import added
    snapshots: DataFrame        # snapshot table after the end-of-day snapshots
    counts: DataFrame           # per file: discovered, imported, skipped, ...
    errors: DataFrame           # files that were not imported: file_id, account_id, error


def import_statements(spark: SparkSession, paths, manifest: DataFrame, ledger_tx: DataFrame,
                      ledger_snapshots: DataFrame, accounts: DataFrame, batch_id: str,
                      rules: DataFrame | None = None) -> ImportResult:
    """Statement files -> deduplicated ledger rows, tags, snapshots, counts.

    Files of unknown accounts or without the columns they need are not imported; `errors`
    names them.
    """
    lines = statements.read_statement_files(spark, paths)
    errors = statements.file_errors(lines, manifest, accounts)
    rows = statements.parse_rows(lines, manifest.join(errors.select("file_id"), "file_id", "left_anti"))
    new = statements.new_rows(rows, ledger_tx)
    added = statements.to_transactions(new, batch_id)
    if rules is not None:
        view = views.transactions_view(
            added.withColumn("tags", F.array().cast("array<string>"))
            .withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
            .withColumn("sf_id", F.lit(None).cast("string"))
            .withColumn("lf_id", F.lit(None).cast("string"))
            .withColumn("parent_transaction_id", F.lit(None).cast("string"))
            .withColumn("is_manual", F.lit(False))
            .withColumn("tags_auto_applied", F.lit(False)), accounts)
        added = tagging.apply_rules(view, tagging.load_rules(rules)).select(
            *added.columns, "tags", "tags_auto_applied")
    eod = statements.end_of_day_snapshots(rows, ledger_snapshots)
    created = eod.groupBy("file_id").agg(F.count(F.lit(1)).alias("snapshots_created"))
    snap_rows = eod.select(
        F.substring(F.sha2(F.concat_ws("|", "account_id", F.col("day").cast("string"),
                                       F.lit(batch_id)), 256), 1, 32).alias("snapshot_id"),
        "account_id", "balance", "snapshot_time", "source")
    return ImportResult(
        transactions=ledger_tx.unionByName(added, allowMissingColumns=True),
        new_rows=added,
        snapshots=ledger_snapshots.unionByName(snap_rows, allowMissingColumns=True),
        counts=statements.import_counts(rows, new, created), errors=errors)


@dataclass
class SyncResult:
    accounts: DataFrame          # account table after the sync
    snapshots: DataFrame         # snapshot table after the sync
    transactions: DataFrame      # ledger after the sync
    new_transactions: DataFrame  # the rows this sync added, tagged
    stats: DataFrame             # discovered, new, skipped, new_accounts
    warnings: DataFrame          # payload_id, message


def _sync(ids: tuple[str, str], prov_acc: DataFrame, tx: DataFrame, new_snapshots: DataFrame,
          warnings: DataFrame, ledger_tx: DataFrame, accounts: DataFrame, snapshots: DataFrame, mapping: DataFrame,
          settings: DataFrame | None, rules: DataFrame | None, balances_only: bool, as_of_ts: str) -> SyncResult:
    id_col, ext_col = ids
    known = sync.with_new_accounts(mapping, prov_acc, id_col)
    incoming = (prov_acc.join(known.withColumnRenamed("ext_id", id_col), id_col)
                .withColumn("updated_at", F.expr(f"TIMESTAMP_NTZ '{as_of_ts}'")))
    merged_accounts = merge.merge_accounts(accounts, incoming)
    if balances_only:
        tx = tx.where(F.lit(False))
    elif settings is not None:
        skip = providers.balances_only_ids(settings)
        tx = tx.join(skip.select(F.col("ext_id").alias(ext_col)), ext_col, "left_anti")
    mapped = sync.map_accounts(tx, ext_col, known)
    new = sync.new_transactions(mapped, ledger_tx, id_col=id_col, ext_col=ext_col)
    rows = sync.ledger_rows(new, id_col)
    if rules is not None:
        view = views.transactions_view(rows, merged_accounts)
        rows = tagging.apply_rules(view, tagging.load_rules(rules)).select(*rows.columns)
    added = sync.map_accounts(new_snapshots, ext_col, known).select(
        F.substring(F.sha2(F.concat_ws("|", "payload_id", ext_col, F.col("snapshot_time").cast("string")), 256), 1, 32).alias("snapshot_id"),
        "account_id", "balance", "snapshot_time", "source")
    return SyncResult(
        accounts=merged_accounts, snapshots=snapshots.unionByName(added, allowMissingColumns=True),
        transactions=ledger_tx.unionByName(rows, allowMissingColumns=True), new_transactions=rows,
        stats=sync.sync_stats(mapped, new, prov_acc, id_col, mapping), warnings=warnings)


def sync_provider_a(payloads: DataFrame, ledger_tx: DataFrame, accounts: DataFrame, snapshots: DataFrame,
                    mapping: DataFrame, as_of_ts: str, settings: DataFrame | None = None,
                    rules: DataFrame | None = None, balances_only: bool = False) -> SyncResult:
    """S2 for payload A: accounts upsert, every account mapped (new ones too), all snapshots,
    new transactions (J6) tagged and added, counters and the provider's messages. With
    ``balances_only`` (S5) accounts and snapshots alone."""
    parsed = providers.parse(payloads, providers.SCHEMA_A)
    return _sync(("sf_id", "sf_account_id"), providers.a_accounts(parsed), providers.a_transactions(parsed),
                 providers.a_snapshots(parsed, as_of_ts), providers.a_warnings(parsed), ledger_tx, accounts, snapshots,
                 mapping, settings, rules, balances_only, as_of_ts)


def sync_provider_b(payloads: DataFrame, ledger_tx: DataFrame, accounts: DataFrame, snapshots: DataFrame,
                    mapping: DataFrame, as_of_ts: str, settings: DataFrame | None = None,
                    rules: DataFrame | None = None, balances_only: bool = False) -> SyncResult:
    """S2 for payload B; rows of accounts that are not active are left out (see the warnings)."""
    parsed = providers.parse(payloads, providers.SCHEMA_B)
    prov_acc = providers.b_accounts(parsed)
    active = prov_acc.select(F.col("lf_id").alias("lf_account_id"))
    tx = providers.b_transactions(parsed).join(active, "lf_account_id", "left_semi")
    shots = prov_acc.where(F.col("balance").isNotNull()).select(
        F.col("lf_id").alias("payload_id"), F.col("lf_id").alias("lf_account_id"), "balance",
        F.expr(f"TIMESTAMP_NTZ '{as_of_ts}'").alias("snapshot_time"), F.lit("sync").alias("source"))
    return _sync(("lf_id", "lf_account_id"), prov_acc.drop("balance"), tx, shots, providers.b_warnings(parsed),
                 ledger_tx, accounts, snapshots, mapping, settings, rules, balances_only, as_of_ts)


def backfill(transactions: DataFrame, snapshots: DataFrame, anchors: DataFrame,
             start: str | None = None, end: str | None = None, execute: bool = False) -> DataFrame:
    """The preview, or the new snapshot table when ``execute``."""
    if execute:
        return balances.backfill_execute(transactions, snapshots, anchors, start, end)
    return balances.backfill_preview(transactions, snapshots, anchors, start, end)


def doctor(transactions: DataFrame, snapshots: DataFrame, accounts: DataFrame, as_of: str,
           categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(check rows, summary row)."""
    checks = quality.all_checks(transactions, snapshots, accounts, as_of, categories)
    return checks, quality.check_summary(checks)


def status(transactions: DataFrame, snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """A1-A5: the status roll-up."""
    return quality.status_summary(transactions, snapshots, accounts)


def query(spark: SparkSession, sf_dir: str, text: str, args=None) -> DataFrame:
    """Q1/Q3: read-only SQL over the registered ledger views."""
    sqlmod.register_views(spark, sf_dir)
    return sqlmod.run_readonly(spark, text, args)


def add_snapshot(snapshots: DataFrame, incoming: DataFrame) -> DataFrame:
    """M7: append manual snapshots unless a same-day one within 0.01 exists."""
    return snapshots.unionByName(dedup.new_snapshots(incoming, snapshots), allowMissingColumns=True)
