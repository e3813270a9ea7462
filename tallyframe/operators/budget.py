"""Budget and net worth (B1-B4), derived from the reference's budget schema.

Categories are user configuration (a few rows per month). They are grouped to one array
per month and joined to the transactions on the month (Spark broadcasts the measured few
rows), so one projection over one scan finds a transaction's categories and the fact
table is never shuffled for B1, D6 or D7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import active, classification, latest_balances

CATEGORY_SCHEMA = ("category_id string, month string, type string, name string, "
                   "expected decimal(12,2), tags array<string>, require_all boolean, "
                   "amount_sign string, sort_order int")
ROLLOVER_SCHEMA = ("rollover_id string, source_month string, from_category string, "
                   "to_category string, to_month string, amount decimal(12,2)")
OVERRIDE_SCHEMA = ("account_id string, classification_override string, "
                   "exclude_from_net_worth boolean")


def with_categories(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Each active transaction with its month, `hits` (its categories: same month, tags any /
    all, sign) and `budgeted` (whether the month has categories at all)."""
    by_month = categories.groupBy("month").agg(F.collect_list(F.struct(
        "category_id", "type", "name", F.col("tags").alias("tags"), "require_all", "amount_sign")).alias("cats"))
    tx = (active(transactions)
          .withColumn("tx_tags", F.coalesce(F.col("tags"), F.array().cast("array<string>")))
          .withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
          .join(by_month, "month", "left"))

    def hit(c):
        all_tags = F.size(F.array_except(c["tags"], F.col("tx_tags"))) == 0
        any_tag = F.coalesce(F.arrays_overlap(c["tags"], F.col("tx_tags")), F.lit(False))
        sign = (F.when(c["amount_sign"] == "positive", F.col("amount") > 0)
                .when(c["amount_sign"] == "negative", F.col("amount") < 0).otherwise(F.lit(True)))
        return (F.size(c["tags"]) > 0) & F.when(c["require_all"], all_tags).otherwise(any_tag) & sign

    empty = F.filter(F.col("cats"), lambda c: F.lit(False))
    return (tx.withColumn("budgeted", F.col("cats").isNotNull())
            .withColumn("hits", F.when(F.col("budgeted"), F.filter("cats", hit)).otherwise(empty))
            .drop("cats", "tx_tags"))


def category_matches(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """B1: (transaction, category) pairs."""
    return (with_categories(transactions, categories).withColumn("c", F.explode("hits"))
            .select("transaction_id", "account_id", "amount", "transaction_date", "month",
                    "c.category_id", "c.name", "c.type"))


# D6 and D7 (intent of the reference's stubs) over the columns of with_categories
def in_several():
    return F.coalesce(F.size("hits") > 1, F.lit(False))


def uncovered():
    return (F.col("amount") < 0) & F.col("budgeted") & (F.size("hits") == 0)


def budget_actuals(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """B2: expected vs actual per category and month."""
    actual = (category_matches(transactions, categories)
              .groupBy("category_id", "month")
              .agg(F.sum("amount").alias("actual"), F.count(F.lit(1)).alias("n_transactions")))
    return (categories.select("category_id", "month", "name", "type", "expected")
            .join(actual, ["category_id", "month"], "left")
            .select("category_id", "month", "name", "type",
                    F.col("expected").cast("decimal(18,2)").alias("expected"),
                    F.coalesce(F.col("actual"), F.lit(0)).cast("decimal(18,2)").alias("actual"),
                    F.coalesce(F.col("n_transactions"), F.lit(0)).alias("n_transactions"),
                    (F.col("expected") - F.abs(F.coalesce(F.col("actual"), F.lit(0))))
                    .cast("decimal(18,2)").alias("remaining")))


def budget_rollovers(rollovers: DataFrame) -> DataFrame:
    """Amount rolled in and out per (category, month): union of signed legs."""
    out_leg = rollovers.select(F.col("from_category").alias("category_id"),
                               F.col("source_month").alias("month"),
                               F.lit(0).cast("decimal(12,2)").alias("r_in"),
                               F.col("amount").alias("r_out"))
    in_leg = rollovers.select(F.col("to_category").alias("category_id"),
                              F.col("to_month").alias("month"),
                              F.col("amount").alias("r_in"),
                              F.lit(0).cast("decimal(12,2)").alias("r_out"))
    return (out_leg.unionByName(in_leg).groupBy("category_id", "month")
            .agg(F.sum("r_in").cast("decimal(18,2)").alias("rollover_in"),
                 F.sum("r_out").cast("decimal(18,2)").alias("rollover_out")))


def net_worth(accounts: DataFrame, snapshots: DataFrame, overrides: DataFrame) -> DataFrame:
    """Σ latest balances per class, excluded accounts left out."""
    acc = accounts.join(overrides, "account_id", "left").where(
        ~F.coalesce(F.col("exclude_from_net_worth"), F.lit(False)))
    cls = classification(F.col("account_type"),
                         F.coalesce(F.col("classification_override"), F.col("classification")))
    return (acc.select("account_id", cls.alias("classification"))
            .join(latest_balances(snapshots), "account_id", "inner")
            .groupBy("classification")
            .agg(F.sum("balance").cast("decimal(18,2)").alias("total"),
                 F.count(F.lit(1)).alias("n_accounts")))


def double_counted(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions in more than one category."""
    ids = F.transform("hits", lambda c: c["category_id"])
    return with_categories(transactions, categories).where(in_several()).select(
        "transaction_id", "month", F.size("hits").cast("long").alias("n_categories"),
        F.array_join(F.array_sort(F.array_distinct(ids)), "|").alias("categories"))


def uncovered_expenses(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Expenses in a budgeted month that match no category."""
    return with_categories(transactions, categories).where(uncovered()).select(
        "transaction_id", "account_id", "amount", "transaction_date", "month")
