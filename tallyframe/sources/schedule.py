"""Recurring-schedule expansion (I18): schedule rules -> dated transactions.

Each rule is either monthly on a day of the month or every N days, over the
window of ``days`` days ending at ``as_of``; amounts cycle through a list by
the number of days back. Each rule explodes a sequence of its own due dates (months, or
every n days); no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

WINDOW_DAYS = 180


def expand(rules: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """rules: schedule_id, account_id, kind ('monthly'|'every_n'), day, n,
    amounts array<decimal>, description."""
    asof = F.lit(as_of).cast("date")
    first = F.date_sub(asof, days - 1)
    months = F.sequence(F.trunc(first, "MM").cast("date"), asof, F.expr("interval 1 month"))
    monthly = F.filter(F.transform(months, lambda m: F.date_add(m, F.col("day").cast("int") - 1)),
                       lambda x: (F.dayofmonth(x) == F.col("day")) & x.between(first, asof))
    steps = F.sequence(F.lit(0), F.floor(F.lit(days - 1) / F.col("n")).cast("int"))
    every_n = F.transform(steps, lambda k: F.date_sub(asof, (k * F.col("n")).cast("int")))
    due = (F.when(F.col("kind") == "monthly", monthly)
           .when((F.col("kind") == "every_n") & (F.col("n") > 0), every_n))
    d = rules.withColumn("date", F.explode(due))
    ago = F.datediff(asof, F.col("date"))
    amount = F.element_at(F.col("amounts"), (F.pmod(ago, F.size("amounts")) + 1).cast("int"))
    return d.select(
        "schedule_id", "account_id", "date", amount.alias("amount"), "description")


def fixture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schedule per customer: household and building accounts get a
    monthly deposit on a day set by their nation; the others spend every
    3 to 7 days in a cycle of three amounts."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    monthly = F.col("c_mktsegment").isin("HOUSEHOLD", "BUILDING")
    bal = F.col("c_acctbal").cast("decimal(15,2)")
    amounts = F.when(monthly, F.array(bal, (bal * 2).cast("decimal(15,2)"))).otherwise(
        F.array((-bal).cast("decimal(15,2)"), (-bal * 3).cast("decimal(15,2)"),
                F.lit(-12.34).cast("decimal(15,2)")))
    return c.select(
        F.concat(F.lit("sched-"), F.col("c_custkey").cast("string")).alias("schedule_id"),
        F.col("c_custkey").cast("string").alias("account_id"),
        F.when(monthly, F.lit("monthly")).otherwise(F.lit("every_n")).alias("kind"),
        (F.col("c_nationkey") + 1).alias("day"),
        (F.lit(3) + F.floor(F.col("c_nationkey") / 5)).cast("int").alias("n"),
        amounts.alias("amounts"),
        F.when(monthly, F.lit("PAYROLL DEPOSIT")).otherwise(F.lit("CARD SPEND")).alias("description"),
    )
