"""Data-quality checks (D1-D8), A9-A11, and the status roll-up (A1-A5).

Each check is one aggregate over its input; the summary unions the one-row
check frames and counts by status. Details stay distributed DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import budget
from .views import active

def orphan_transactions(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Non-deleted transactions whose account does not exist."""
    return (active(transactions).select("transaction_id", "account_id")
            .join(accounts.select("account_id"), "account_id", "left_anti"))


def orphan_snapshots(snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """Snapshots whose account does not exist."""
    return (snapshots.select("snapshot_id", "account_id")
            .join(accounts.select("account_id"), "account_id", "left_anti"))


def insane_dates(transactions: DataFrame, as_of: str) -> DataFrame:
    """D3: dates before 1970 or more than 365 days after as_of."""
    d = F.col("transaction_date")
    return (active(transactions)
            .where((d > F.date_add(F.lit(as_of).cast("date"), 365)) |
                   (d < F.lit("1970-01-01").cast("date")))
            .select("transaction_id", "transaction_date",
                    F.coalesce(F.col("description"), F.lit("")).alias("description"), "amount"))


def sample(details: DataFrame, n: int = 100) -> DataFrame:
    """The n earliest rows of a check's details, as a screen shows them."""
    return details.orderBy("transaction_date", "transaction_id").limit(n)


def future_transactions(transactions: DataFrame, as_of: str) -> DataFrame:
    """Dated after as_of + 1 day."""
    return active(transactions).where(
        F.col("transaction_date") > F.date_add(F.lit(as_of).cast("date"), 1))


def untagged(tags_col: str = "tags"):
    t = F.col(tags_col)
    return t.isNull() | (F.size(t) == 0)


def untagged_stats(transactions: DataFrame) -> DataFrame:
    """Untagged count, truncated percentage, uncategorised expenses."""
    a = active(transactions)
    n = F.count(F.lit(1))
    u = F.count_if(untagged())
    return a.agg(
        u.alias("untagged"),
        n.alias("total"),
        F.when(n > 0, F.floor(u * 100 / n)).otherwise(F.lit(0)).cast("bigint").alias("untagged_pct"),
        F.count_if(untagged() & (F.col("amount") < 0)).alias("uncategorized_expenses"),
    )


# Per check, its failing status and its messages.
CHECKS = {
    "orphaned_transactions": ("error", "%d transaction(s) reference missing accounts",
                              "No orphaned transactions found"),
    "orphaned_snapshots": ("error", "%d snapshot(s) reference missing accounts",
                           "No orphaned snapshots found"),
    "date_sanity": ("error", "%d transaction(s) have unreasonable dates",
                    "All transaction dates are valid"),
    "untagged_transactions": ("warning", "%d transaction(s) have no tags",
                              "All transactions are tagged"),
    "budget_double_counting": ("warning", "%d transaction(s) counted in several categories",
                               "No double-counted transactions found"),
    "uncategorized_expenses": ("warning", "%d expense(s) in no budget category",
                               "All expenses are categorized in budget"),
}


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """One aggregate row with a count column per check -> (check, n) rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("n")) for n in names]))
        .alias("c")).select("c.*")


def all_checks(transactions: DataFrame, snapshots: DataFrame, accounts: DataFrame,
               as_of: str, categories: DataFrame | None = None) -> DataFrame:
    """D1-D7 as rows (check, status, n, message); D6 and D7 where categories are given.

    All transaction checks are counts of one aggregate over one scan: the rows carry
    their categories and whether their account is known.
    """
    d = F.col("transaction_date")
    tx = active(transactions) if categories is None else budget.with_categories(transactions, categories)
    known = accounts.select("account_id", F.lit(True).alias("_known"))
    counts = {
        "orphaned_transactions": F.col("_known").isNull(),
        "date_sanity": (d > F.date_add(F.lit(as_of).cast("date"), 365)) | (d < F.lit("1970-01-01").cast("date")),
        "untagged_transactions": untagged()}
    if categories is not None:
        counts |= {"budget_double_counting": budget.in_several(), "uncategorized_expenses": budget.uncovered()}
    tx_counts = tx.join(known, "account_id", "left").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    out = _long(tx_counts, list(counts)).unionByName(
        _long(orphan_snapshots(snapshots, accounts).agg(F.count(F.lit(1)).alias("orphaned_snapshots")), ["orphaned_snapshots"]))
    status = F.lit("pass")
    message = None
    for name, (fail, msg, ok) in CHECKS.items():
        is_it = F.col("check") == name
        st = F.when(F.col("n") == 0, F.lit("pass")).otherwise(F.lit(fail))
        mg = F.when(F.col("n") == 0, F.lit(ok)).otherwise(F.format_string(msg, F.col("n")))
        status = F.when(is_it, st).otherwise(status)
        message = F.when(is_it, mg) if message is None else message.when(is_it, mg)
    return out.select("check", status.alias("status"), "n", message.alias("message"))


def check_summary(checks: DataFrame) -> DataFrame:
    """Pass / warning / error counts."""
    return checks.agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def status_accounts(accounts: DataFrame) -> DataFrame:
    """A5: the account list of the status screen."""
    return accounts.select(F.col("account_id").alias("id"), "name", "institution_name")


def status_summary(transactions: DataFrame, snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """A1-A5 in one pass: the three inputs are unioned into one narrow frame
    and reduced by a single global aggregate (partial per partition)."""
    t = active(transactions).select(F.lit("tx").alias("kind"), F.col("transaction_date").alias("d"))
    s = snapshots.select(F.lit("snap").alias("kind"), F.lit(None).cast("date").alias("d"))
    a = accounts.select(F.lit("acct").alias("kind"), F.lit(None).cast("date").alias("d"))
    u = t.unionByName(s).unionByName(a)
    return u.agg(
        F.count_if(F.col("kind") == "acct").alias("total_accounts"),
        F.count_if(F.col("kind") == "tx").alias("total_transactions"),
        F.count_if(F.col("kind") == "snap").alias("total_snapshots"),
        F.min("d").alias("first_transaction_date"),
        F.max("d").alias("last_transaction_date"),
    )
