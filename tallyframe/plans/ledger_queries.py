"""Registered queries over the ledger views: views, lookups, balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balances, views
from ..sources import ledger
from .oracle_views import with_views
from .registry import query

BACKFILL_START = "2024-01-05"
RANGE = ("1996-01-01", "1996-03-31")
SNAP_RANGE = ("2024-01-10", "2024-01-12")


def _tags_text(col="tags"):
    return F.array_join(F.col(col), "|")


@query("view_transactions", with_views("""
SELECT transaction_id, account_id, amount, description, transaction_date,
  array_to_string(tags, '|') AS tags, account_name, account_type, institution_name, source
FROM tx_view""", "tx_view"))
def view_transactions(spark, d):
    v = views.transactions_view(ledger.transactions(spark, d), ledger.accounts(spark, d))
    return v.select("transaction_id", "account_id", "amount", "description", "transaction_date",
                    _tags_text().alias("tags"), "account_name", "account_type",
                    "institution_name", "source")


@query("tx_source_counts", with_views("""
SELECT source, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total
FROM tx_view GROUP BY source""", "tx_view"))
def tx_source_counts(spark, d):
    v = views.transactions_view(ledger.transactions(spark, d), ledger.accounts(spark, d))
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum("amount").cast("decimal(18,2)").alias("total"))


SNAP_ACCOUNT = "7"


@query("snap_by_account", with_views(f"""
SELECT snapshot_id, balance, snapshot_time FROM balance_snapshots WHERE account_id = '{SNAP_ACCOUNT}'""", "balance_snapshots"))
def snap_by_account(spark, d):
    """O2: the snapshots of one account, newest first (the account is the feature)."""
    return views.snapshots_of(ledger.balance_snapshots(spark, d), SNAP_ACCOUNT).select("snapshot_id", "balance", "snapshot_time")


@query("parse_timestamp", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_timestamp(spark, d):
    """Event times written in three layouts, and text that is no time."""
    from ..functions.dates import parse_timestamp as parse
    from ..sources.tables import table
    ts, k = F.col("ts"), F.col("event_id") % 4
    text = (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k == 2, F.concat(F.lit("  "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z "))).otherwise(F.lit("no time")))
    return table(spark, d, "events").select("event_id", parse(text).cast("timestamp_ntz").alias("parsed"))


@query("split_list", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ',x|' || o_orderstatus
  ELSE o_orderpriority || '|x|' || o_orderstatus END AS items FROM orders""")
def split_list(spark, d):
    """Lists typed as text, by lines where there is a line end, else by commas."""
    from ..functions.text import split_list as split
    from ..sources.tables import table
    text = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit(",x\n\r\n "), "o_orderstatus")).otherwise(
        F.concat(F.lit(" ,"), "o_orderpriority", F.lit(" , x,, "), "o_orderstatus", F.lit(", ")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(split(text), "|").alias("items"))


@query("snap_update", with_views("""
SELECT snapshot_id, CASE WHEN source = 'manual' THEN CAST(balance + 1 AS DECIMAL(15,2)) ELSE balance END AS balance,
  CASE WHEN source = 'manual' AND CAST(snapshot_id AS BIGINT) % 2 = 0 THEN 'corrected' ELSE source END AS source
FROM balance_snapshots""", "balance_snapshots"))
def snap_update(spark, d):
    """M8: the snapshot table after manual snapshots were corrected."""
    from ..operators import merge
    snaps = ledger.balance_snapshots(spark, d)
    changes = snaps.where(F.col("source") == "manual").select(
        "snapshot_id", (F.col("balance") + 1).cast("decimal(15,2)").alias("balance"),
        F.when(F.col("snapshot_id").cast("long") % 2 == 0, F.lit("corrected")).alias("source"))
    return merge.update_snapshots(snaps, changes).select("snapshot_id", "balance", "source")


@query("status_accounts", with_views("SELECT account_id AS id, name, institution_name FROM accounts", "accounts"))
def status_accounts(spark, d):
    """A5: the account list of the status."""
    from ..operators import quality
    return quality.status_accounts(ledger.accounts(spark, d))


@query("tx_active", with_views("""
SELECT transaction_id, account_id, amount, transaction_date FROM transactions
WHERE deleted_at IS NULL""", "transactions"))
def tx_active(spark, d):
    return views.active(ledger.transactions(spark, d)).select(
        "transaction_id", "account_id", "amount", "transaction_date")


@query("tx_by_account", with_views("""
SELECT account_id, transaction_id, transaction_date, amount,
  row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, transaction_id DESC)
    AS rank_in_account
FROM transactions WHERE deleted_at IS NULL""", "transactions"))
def tx_by_account(spark, d):
    """O1 for every account at once: the newest-first position of each
    transaction in its account (ties by id)."""
    return views.rank_newest_first(views.active(ledger.transactions(spark, d)).select(
        "account_id", "transaction_id", "transaction_date", "amount"))


@query("tx_date_range_scan", with_views(f"""
SELECT transaction_id, account_id, amount, transaction_date FROM transactions
WHERE deleted_at IS NULL AND transaction_date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'
""", "transactions"))
def tx_date_range_scan(spark, d):
    return views.transactions_in_range(ledger.transactions(spark, d), *RANGE).select(
        "transaction_id", "account_id", "amount", "transaction_date")


@query("acct_classification", with_views("""
SELECT account_id, CASE WHEN lower(coalesce(account_type, '')) IN ('credit', 'loan')
  THEN 'liability' ELSE 'asset' END AS classification, upper(trim(currency)) AS currency
FROM accounts""", "accounts"))
def acct_classification(spark, d):
    return views.classified_accounts(ledger.accounts(spark, d)).select(
        "account_id", "classification", "currency")


@query("acct_invalid", with_views("""
SELECT account_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' ELSE 'currency' END AS problem
FROM accounts WHERE trim(coalesce(name, '')) = '' OR trim(coalesce(currency, '')) = ''
""", "accounts"))
def acct_invalid(spark, d):
    return views.invalid_accounts(ledger.accounts(spark, d))


@query("acct_latest_balance", with_views("""
SELECT a.account_id, a.name, l.balance, l.balance_time FROM accounts a LEFT JOIN (
  SELECT account_id, balance, snapshot_time AS balance_time FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id
      ORDER BY snapshot_time DESC, created_at DESC, snapshot_id DESC) AS rn
    FROM balance_snapshots) WHERE rn = 1) l USING (account_id)
""", "accounts", "balance_snapshots"))
def acct_latest_balance(spark, d):
    return views.accounts_with_balance(ledger.accounts(spark, d),
                                       ledger.balance_snapshots(spark, d)).select(
        "account_id", "name", "balance", "balance_time")


@query("view_balance_snapshots", with_views("""
SELECT s.snapshot_id, s.account_id, s.balance, s.snapshot_time, s.source,
  a.name AS account_name, a.institution_name
FROM balance_snapshots s LEFT JOIN accounts a USING (account_id)
""", "accounts", "balance_snapshots"))
def view_balance_snapshots(spark, d):
    return views.snapshots_view(ledger.balance_snapshots(spark, d), ledger.accounts(spark, d)) \
        .select("snapshot_id", "account_id", "balance", "snapshot_time", "source",
                "account_name", "institution_name")


@query("snap_in_range", with_views(f"""
SELECT snapshot_id, account_id, balance, snapshot_time FROM balance_snapshots
WHERE CAST(snapshot_time AS DATE) BETWEEN DATE '{SNAP_RANGE[0]}' AND DATE '{SNAP_RANGE[1]}'
""", "balance_snapshots"))
def snap_in_range(spark, d):
    return views.snapshots_in_range(ledger.balance_snapshots(spark, d), *SNAP_RANGE).select(
        "snapshot_id", "account_id", "balance", "snapshot_time")


@query("json_id_backfill", with_views("""
SELECT transaction_id,
  json_extract_string(external_ids, '$.simplefin') AS sf_id_json,
  json_extract_string(external_ids, '$.lunchflow') AS lf_id_json,
  json_extract_string(external_ids, '$."csv_import.batch_id"') AS csv_batch_id_json,
  json_extract_string(external_ids, '$.fingerprint') AS fingerprint_json,
  coalesce(CAST(json_extract_string(external_ids, '$.manual') AS BOOLEAN), false) AS is_manual_json
FROM transactions""", "transactions"))
def json_id_backfill(spark, d):
    return views.json_id_backfill(ledger.transactions(spark, d))


@query("daily_totals", with_views("""
SELECT account_id, transaction_date AS day, CAST(sum(amount) AS DECIMAL(18,2)) AS daily_change,
  count(*) AS n_transactions
FROM transactions WHERE deleted_at IS NULL GROUP BY account_id, transaction_date
""", "transactions"))
def daily_totals(spark, d):
    return balances.daily_totals(ledger.transactions(spark, d))


_BACKFILL_CTES = """
tx AS (SELECT t.account_id, t.transaction_date AS day, sum(t.amount) AS daily_change,
         count(*) AS n FROM transactions t JOIN anchors a USING (account_id)
       WHERE t.deleted_at IS NULL AND t.transaction_date <= a.known_date GROUP BY 1, 2),
sn AS (SELECT account_id, day, balance AS eb, source AS es FROM (
         SELECT s.account_id, CAST(s.snapshot_time AS DATE) AS day, s.balance, s.source,
           row_number() OVER (PARTITION BY s.account_id, CAST(s.snapshot_time AS DATE)
                              ORDER BY s.snapshot_time, s.snapshot_id) AS rn
         FROM balance_snapshots s JOIN anchors a USING (account_id)
         WHERE CAST(s.snapshot_time AS DATE) <= a.known_date) WHERE rn = 1),
days AS (SELECT coalesce(tx.account_id, sn.account_id) AS account_id,
           coalesce(tx.day, sn.day) AS day, tx.daily_change, tx.n, sn.eb, sn.es
         FROM tx FULL OUTER JOIN sn ON tx.account_id = sn.account_id AND tx.day = sn.day),
w AS (SELECT d.*, a.known_date, a.known_balance - coalesce(sum(coalesce(d.daily_change, 0)) OVER (
         PARTITION BY d.account_id ORDER BY d.day DESC
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bal
      FROM days d JOIN anchors a USING (account_id)),
pv AS (SELECT account_id, day, CAST(bal AS DECIMAL(18,2)) AS balance,
         CAST(coalesce(daily_change, 0) AS DECIMAL(18,2)) AS daily_change,
         coalesce(n, 0) AS n_transactions, eb IS NULL AS is_new,
         CAST(eb AS DECIMAL(18,2)) AS existing_balance, es AS existing_source
       FROM w WHERE day >= DATE '{start}' AND day <= known_date)
"""


def _backfill_sql(body: str) -> str:
    base = with_views("SELECT 1", "transactions", "balance_snapshots", "anchors")
    ctes = base[len("WITH "):-len("\nSELECT 1")]
    return f"WITH {ctes},\n{_BACKFILL_CTES.format(start=BACKFILL_START)}\n{body}"


@query("backfill_preview", _backfill_sql("SELECT * FROM pv"))
def backfill_preview(spark, d):
    return balances.backfill_preview(ledger.transactions(spark, d),
                                     ledger.balance_snapshots(spark, d),
                                     ledger.anchors(spark, d), start=BACKFILL_START)


@query("backfill_details", _backfill_sql("""
SELECT t.account_id, t.transaction_date AS day, t.transaction_id,
  coalesce(t.description, '') AS description, t.amount
FROM transactions t JOIN pv ON t.account_id = pv.account_id AND t.transaction_date = pv.day
WHERE t.deleted_at IS NULL"""))
def backfill_details(spark, d):
    tx = ledger.transactions(spark, d)
    pv = balances.backfill_preview(tx, ledger.balance_snapshots(spark, d),
                                   ledger.anchors(spark, d), start=BACKFILL_START)
    return balances.backfill_details(tx, pv)


@query("backfill_execute", _backfill_sql("""
, span AS (SELECT account_id, min(day) AS lo, max(day) AS hi FROM pv GROUP BY account_id)
SELECT s.snapshot_id, s.account_id, s.balance, s.snapshot_time, s.source
FROM balance_snapshots s LEFT JOIN span USING (account_id)
WHERE span.lo IS NULL OR NOT (CAST(s.snapshot_time AS DATE) BETWEEN span.lo AND span.hi)
UNION ALL
SELECT substr(sha256(account_id || '|' || CAST(day AS VARCHAR) || '|backfill'), 1, 32),
  account_id, CAST(balance AS DECIMAL(15,2)),
  CAST(day AS TIMESTAMP) + to_microseconds(86399999999), 'backfill'
FROM pv""".lstrip()))
def backfill_execute(spark, d):
    return balances.backfill_execute(ledger.transactions(spark, d),
                                     ledger.balance_snapshots(spark, d),
                                     ledger.anchors(spark, d), start=BACKFILL_START)
