"""Balance history (A6, W1-W3): the reference's per-account loops as windows.

Shape of the plan, for all accounts at once:

  transactions --partial agg--> shuffle (account, day) --final agg-- daily totals
  snapshots    --partial agg--> shuffle (account, day) --final agg-- first snapshot/day
        full outer join on (account, day)   (both sides already co-partitioned)
        join with the anchors, then a running sum window over days (newest first)

The rows are aggregated before they meet the anchors, so what is shuffled by account is
days and not transactions: a hot account that holds a third of all transactions costs one
row per day and map task, and its window has its active days (<= 366 a year). A start
bound goes into both scans, as the sum runs from the newest day back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import end_of_day
from .views import active

MONEY = "decimal(18,2)"


def daily_totals(transactions: DataFrame) -> DataFrame:
    """Σ amount per account and transaction day (non-deleted rows)."""
    return (active(transactions)
            .groupBy("account_id", F.col("transaction_date").alias("day"))
            .agg(F.sum("amount").cast(MONEY).alias("daily_change"),
                 F.count(F.lit(1)).alias("n_transactions")))


def _anchored_days(transactions: DataFrame, snapshots: DataFrame, anchors: DataFrame,
                   start: str | None = None) -> DataFrame:
    """U1 + W3: every (account, day) from `start` to the anchor date that has a
    transaction or a snapshot, with the day's total and its earliest snapshot."""
    tx, snaps = active(transactions), snapshots
    if start is not None:
        first = F.lit(start).cast("date")
        tx = tx.where(F.col("transaction_date") >= first)
        snaps = snaps.where(F.col("snapshot_time") >= F.lit(start).cast("timestamp_ntz"))
    tx = (tx.groupBy("account_id", F.col("transaction_date").alias("day"))
          .agg(F.sum("amount").alias("daily_change"), F.count(F.lit(1)).alias("n_transactions")))
    snap = (snaps.groupBy("account_id", F.to_date("snapshot_time").alias("day"))
            .agg(F.min_by(F.struct(F.col("balance").alias("b"), F.col("source").alias("s")),
                          F.struct("snapshot_time", "snapshot_id")).alias("first_snap")))
    return (tx.join(snap, ["account_id", "day"], "full_outer")
            .join(anchors.select("account_id", "known_balance", "known_date"), "account_id")
            .where(F.col("day") <= F.col("known_date")))


def backfill_balances(transactions: DataFrame, snapshots: DataFrame, anchors: DataFrame,
                      start: str | None = None) -> DataFrame:
    """End-of-day balance of every listed day, computed backwards from the
    known balance: balance(d) = known - Σ totals of the listed days after d."""
    days = _anchored_days(transactions, snapshots, anchors, start)
    newer = (Window.partitionBy("account_id").orderBy(F.col("day").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    change = F.coalesce(F.col("daily_change"), F.lit(0))
    return days.select(
        "account_id", "day", "known_date",
        (F.col("known_balance") - F.coalesce(F.sum(change).over(newer), F.lit(0)))
        .cast(MONEY).alias("balance"),
        change.cast(MONEY).alias("daily_change"),
        F.coalesce(F.col("n_transactions"), F.lit(0)).alias("n_transactions"),
        F.col("first_snap").isNull().alias("is_new"),
        F.col("first_snap.b").cast(MONEY).alias("existing_balance"),
        F.col("first_snap.s").alias("existing_source"),
    )


def backfill_preview(transactions: DataFrame, snapshots: DataFrame, anchors: DataFrame,
                     start: str | None = None, end: str | None = None) -> DataFrame:
    """W1 preview: days after `end` count in the running sum, so this bound comes after the window."""
    days = backfill_balances(transactions, snapshots, anchors, start)
    return days.where(F.col("day") <= F.coalesce(F.lit(end).cast("date"), F.col("known_date"))).drop("known_date")


def backfill_details(transactions: DataFrame, preview: DataFrame) -> DataFrame:
    """A7 as rows: the transactions listed under each preview day.

    The reference nests them in the preview; here they stay rows joined on
    (account, day), so a busy day is never collected into one value.
    """
    return (active(transactions)
            .select("account_id", F.col("transaction_date").alias("day"),
                    "transaction_id", F.coalesce(F.col("description"), F.lit("")).alias("description"),
                    "amount")
            .join(preview.select("account_id", "day"), ["account_id", "day"], "left_semi"))


def backfill_execute(transactions: DataFrame, snapshots: DataFrame, anchors: DataFrame,
                     start: str | None = None, end: str | None = None) -> DataFrame:
    """The new snapshot table.

    For each anchored account, snapshots dated between the earliest and the latest
    listed day of the range are replaced by one 'backfill' snapshot per listed
    day, stamped 23:59:59.999999 (N14). Other snapshots are kept unchanged.
    """
    preview = backfill_preview(transactions, snapshots, anchors, start, end)
    new = preview.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("account_id"), F.col("day").cast("string"),
                                       F.lit("backfill")), 256), 1, 32).alias("snapshot_id"),
        "account_id",
        F.col("balance").cast("decimal(15,2)").alias("balance"),
        end_of_day(F.col("day")).alias("snapshot_time"),
        F.lit("backfill").alias("source"),
    )
    span = preview.groupBy("account_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    sday = F.to_date(F.col("snapshot_time"))
    kept = (snapshots.select("snapshot_id", "account_id", "balance", "snapshot_time", "source")
            .join(span, "account_id", "left")
            .where(F.col("lo").isNull() | ~sday.between(F.col("lo"), F.col("hi")))
            .drop("lo", "hi"))
    return kept.unionByName(new)
