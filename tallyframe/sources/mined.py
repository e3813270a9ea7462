"""Budget categories, rollovers and tag rules proposed from the ledger itself.

A user starts from what the transactions show: last month's totals per tag and sign become
this month's budget, what is left of it rolls over, and words that go with a tag become rules.
All are aggregates over the ledger; the results are as many rows as there are months, tags and words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.budget import budget_actuals
from ..operators.views import active


def _month(date):
    return F.date_format(date, "yyyy-MM")


def categories(transactions: DataFrame) -> DataFrame:
    """One category per tag and sign seen in a month, for the month after: expected is that total."""
    tagged = active(transactions).where("amount <> 0").select(
        F.explode(F.array_distinct("tags")).alias("tag"), "amount", F.when(F.col("amount") > 0, "positive").otherwise("negative").alias("sign"),
        _month(F.add_months("transaction_date", 1)).alias("month"))
    total = tagged.groupBy("tag", "sign", "month").agg(F.sum(F.abs("amount")).cast("decimal(12,2)").alias("expected"))
    kind = F.when(F.col("sign") == "positive", "income").otherwise("expense")
    return total.select(
        F.concat_ws("-", "tag", kind).alias("category_id"), "month", kind.alias("type"), F.col("tag").alias("name"), "expected",
        F.array("tag").alias("tags"), F.lit(False).alias("require_all"), F.col("sign").alias("amount_sign"), F.lit(0).alias("sort_order"))


def rollovers(transactions: DataFrame) -> DataFrame:
    """What a month leaves of a category goes to the same category of the next month."""
    left = budget_actuals(transactions, categories(transactions)).where("remaining > 0")
    return left.select(
        F.concat_ws("/", "category_id", "month").alias("rollover_id"), F.col("month").alias("source_month"),
        F.col("category_id").alias("from_category"), F.col("category_id").alias("to_category"),
        _month(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1)).alias("to_month"), F.col("remaining").cast("decimal(12,2)").alias("amount"))


def rules(transactions: DataFrame, enabled_from: int = 100) -> DataFrame:
    """A rule for each first word of a description and each tag that goes with it, the most
    frequent pairs first; those seen `enabled_from` times or more are enabled."""
    pairs = (active(transactions).select(F.regexp_extract("description", "^[A-Za-z]+", 0).alias("word"), F.explode(F.array_distinct("tags")).alias("tag"))
             .where("word <> ''").groupBy("word", "tag").agg(F.count("*").alias("n")))
    return pairs.select(
        F.concat_ws("-", "word", "tag").alias("rule_id"), F.concat_ws(" ", "word", "tag").alias("name"),
        F.concat(F.lit("description LIKE '"), "word", F.lit("%'")).alias("sql_condition"), F.array("tag").alias("tags"),
        (F.col("n") >= enabled_from).alias("enabled"),
        # one row per word and tag
        F.row_number().over(Window.orderBy(F.col("n").desc(), "word", "tag")).alias("sort_order"))
