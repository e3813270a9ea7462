"""The driver's tables seen as a ledger.

Every ledger table is a lazy projection of a driver table, so its size grows
with the data and Catalyst prunes the columns a job does not read. The same
definitions exist as DuckDB text in ``plans/oracle_views.py`` for the oracle.

  accounts           customer (+ nation); customers with a negative account
                     balance are closed, so their rows become orphans
  transactions       orders, plus the cash events (signup / purchase)
  balance_snapshots  events of type view (source sync) and click (manual)
  logs               all events
  statement lines    lineitem (see sources/statements.py)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from .tables import table

# Fixed parameters of the fixture (no now(): results must be repeatable).
AS_OF = "2001-08-01"            # "today" for the orders ledger
EVENTS_KNOWN_DATE = "2024-01-25"  # backfill anchor date for the event accounts
CREATED_AT = "2024-01-01 00:00:00"

# Market segment -> account type.
SEGMENT_TYPES = {"HOUSEHOLD": "depository", "AUTOMOBILE": "loan", "FURNITURE": "credit",
                 "MACHINERY": "investment"}


def ts_ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _segment_type(seg: Column) -> Column:
    expr = None
    for k, v in SEGMENT_TYPES.items():
        expr = F.when(seg == k, v) if expr is None else expr.when(seg == k, v)
    return expr.otherwise("other")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # nation is a fixed 25-row dimension: a proven bound for a broadcast.
    n = F.broadcast(table(spark, sf_dir, "nation"))
    j = c.where(F.col("c_acctbal") >= 0).join(n, c.c_nationkey == n.n_nationkey, "left")
    currency = (F.when(F.col("n_regionkey") == 3, F.lit(" eur "))
                .when((F.col("n_regionkey") == 0) & (F.col("c_mktsegment") == "BUILDING"),
                      F.lit(""))
                .otherwise(F.lit("usd ")))
    return j.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("nickname"),
        _segment_type(F.col("c_mktsegment")).alias("account_type"),
        F.lit(None).cast("string").alias("classification"),
        currency.alias("currency"),
        F.lit(None).cast("decimal(15,2)").alias("balance"),
        F.col("n_name").alias("institution_name"),
        ts_ntz(CREATED_AT).alias("created_at"),
        ts_ntz(CREATED_AT).alias("updated_at"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_manual"),
    )


def _order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    prio, st, key = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
    keys = key.cast("string")
    amount = F.when(st == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    description = F.concat(
        F.when(st == "P", F.lit("null ")).otherwise(F.lit("")),
        F.lit("POS "), prio, F.lit(" XXXXXXXXXXXX"),
        F.substring(F.concat(F.lit("0000"), F.col("o_custkey").cast("string")), -4, 4),
        F.lit(" REF "), keys)
    word = F.lower(F.substring(prio, 3, 100))
    tags = (F.when(prio == "5-LOW", F.array().cast("array<string>"))
            .when((prio == "4-NOT SPECIFIED") & (st == "O"), F.lit(None).cast("array<string>"))
            .when(st == "F", F.array(word))
            .otherwise(F.array(word, F.when(st == "O", F.lit("open")).otherwise(F.lit("pending")))))
    tx_date = F.col("o_orderdate").cast("date")
    is_sf, is_lf = prio == "2-HIGH", prio == "3-MEDIUM"
    is_csv = prio == "4-NOT SPECIFIED"
    is_split = (prio == "5-LOW") & (st == "P")
    is_manual = (prio == "5-LOW") & (st == "O")
    batch = F.concat(F.lit("import_"), F.date_format(F.col("o_orderdate"), "yyyyMMdd"),
                     F.lit("_000000"))
    ext = (F.when(is_sf, F.concat(F.lit('{"simplefin":"sf-'), keys, F.lit('"}')))
           .when(is_lf, F.concat(F.lit('{"lunchflow":"lf-'), keys, F.lit('"}')))
           .when(is_csv, F.concat(F.lit('{"csv_import.batch_id":"'), batch,
                                  F.lit('","fingerprint":"fp-'), keys, F.lit('"}')))
           .when(is_manual, F.lit('{"manual":true}'))
           .otherwise(F.lit("{}")))
    base = o.select(
        keys.alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        amount.cast("decimal(15,2)").alias("amount"),
        description.alias("description"),
        tx_date.alias("transaction_date"),
        F.date_add(tx_date, 1).alias("posted_date"),
        tags.alias("tags"),
        ext.alias("external_ids"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when((st == "P") & (prio == "1-URGENT"), ts_ntz(AS_OF + " 00:00:00"))
         .alias("deleted_at"),
        F.when(is_split, F.concat(F.lit("split-"), keys)).alias("parent_transaction_id"),
        F.when(is_csv, batch).alias("csv_batch_id"),
        is_manual.alias("is_manual"),
        F.lit(False).alias("tags_auto_applied"),
        F.when(is_sf, F.concat(F.lit("sf-"), keys)).alias("sf_id"),
        F.when(is_lf, F.concat(F.lit("lf-"), keys)).alias("lf_id"),
    )
    return base.withColumn(
        "csv_fingerprint",
        F.when(F.col("csv_batch_id").isNotNull(),
               fingerprint("account_id", "transaction_date", "amount", "description")))


def _cash_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    amount = F.when(F.col("event_type") == "signup", F.col("value")).otherwise(-F.col("value"))
    tx_date = F.to_date(F.col("ts"))
    return e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("user_id").cast("string").alias("account_id"),
        amount.cast("decimal(15,2)").alias("amount"),
        F.concat(F.upper(F.col("event_type")), F.lit(" "), F.col("props")).alias("description"),
        tx_date.alias("transaction_date"),
        tx_date.alias("posted_date"),
        F.array(F.col("event_type")).alias("tags"),
        F.lit("{}").alias("external_ids"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        F.lit(None).cast("string").alias("parent_transaction_id"),
        F.lit(None).cast("string").alias("csv_batch_id"),
        F.lit(False).alias("is_manual"),
        F.lit(False).alias("tags_auto_applied"),
        F.lit(None).cast("string").alias("sf_id"),
        F.lit(None).cast("string").alias("lf_id"),
        F.lit(None).cast("string").alias("csv_fingerprint"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ledger transactions, deleted ones included (they stay for dedup)."""
    return _order_transactions(spark, sf_dir).unionByName(_cash_transactions(spark, sf_dir))


def balance_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(
        F.col("event_id").cast("string").alias("snapshot_id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("value").cast("decimal(15,2)").alias("balance"),
        F.col("ts").alias("snapshot_time"),
        F.when(F.col("event_type") == "view", F.lit("sync")).otherwise(F.lit("manual"))
         .alias("source"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(et.isin("view", "click"), F.lit("app")).otherwise(F.lit("cli"))
         .alias("entry_point"),
        F.lit("1.0.0").alias("app_version"),
        F.lit("linux").alias("platform"),
        et.alias("event"),
        F.when(et == "signup", F.lit("simplefin")).when(et == "error", F.lit("lunchflow"))
         .alias("integration"),
        F.when(et.isin("view", "click"),
               F.concat(F.lit("page-"), F.get_json_object(F.col("props"), "$.k")))
         .alias("page"),
        F.when(et.isin("signup", "error"), F.lit("sync")).when(et == "purchase", F.lit("import"))
         .alias("command"),
        F.when(et == "error", F.col("props")).alias("error_message"),
        F.when(et == "error", F.concat(F.lit("value="), F.col("value").cast("decimal(15,2)").cast("string")))
         .alias("error_details"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill anchors: each open account's known end-of-day balance."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return c.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("known_balance"),
        F.lit(EVENTS_KNOWN_DATE).cast("date").alias("known_date"),
    )
