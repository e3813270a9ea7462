"""Registered queries: provider payloads, sync, table merges, schedules.

Payloads are derived from orders / customer / nation (sources/providers.py);
the oracle computes the expected rows from those tables directly, so every key
is a round trip through to_json / from_json.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, merge, sync, tagging, views
from ..session import materialize, scratch_path
from ..sources import config, ledger, providers, schedule
from .oracle_views import with_views, with_views_ctes
from .registry import ORACLES, query

AS_OF = ledger.AS_OF
AS_OF_TS = AS_OF + " 00:00:00"
SOFT_DELETE_DAY = "1996-06-03"


# --------------------------------------------------------------------------- Spark helpers

def _pa(spark, d):
    return providers.parse(providers.fixture_payloads_a(spark, d), providers.SCHEMA_A)


def _pb(spark, d):
    return providers.parse(providers.fixture_payloads_b(spark, d), providers.SCHEMA_B)


def _mapping(spark, d):
    """Provider A ids of the ledger's accounts."""
    return ledger.accounts(spark, d).select(
        F.concat(F.lit("cust-"), F.col("account_id")).alias("ext_id"), "account_id")


def _sync_mapping(spark, d, pa=None):
    """The map of this sync: known accounts and those that provider A shows first now."""
    return sync.with_new_accounts(_mapping(spark, d), providers.a_accounts(_pa(spark, d) if pa is None else pa), "sf_id")


def _synced_tx(spark, d, pa=None):
    """Mapped provider A transactions of accounts that sync transactions. The payloads are parsed once,
    for the map and for the rows."""
    pa = materialize(_pa(spark, d) if pa is None else pa)
    tx = providers.a_transactions(pa)
    bo = providers.balances_only_ids(providers.fixture_settings(spark, d))
    tx = tx.join(bo.select(F.col("ext_id").alias("sf_account_id")), "sf_account_id", "left_anti")
    return sync.map_accounts(tx, "sf_account_id", _sync_mapping(spark, d, pa))


# --------------------------------------------------------------------------- oracle helpers

_BASE = """
oc AS (SELECT o.*, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
pa_tx AS (
  SELECT o_orderkey AS payload_id, 0 AS tx_pos, 'cust-' || CAST(c_custkey AS VARCHAR) AS sf_account_id,
    'sf-' || CAST(o_orderkey AS VARCHAR) AS sf_id,
    CAST(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0
      ELSE CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(15,2))
      END AS DECIMAL(15,2)) AS amount,
    'ORDER ' || o_orderpriority AS description, CAST(o_orderdate AS DATE) + 1 AS transaction_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN ['urgent'] WHEN '2-HIGH' THEN ['high']
      ELSE CAST([] AS VARCHAR[]) END AS tags,
    o_orderstatus = 'P' AS sf_pending
  FROM oc WHERE o_orderstatus <> 'O'
  UNION ALL
  SELECT o_orderkey, 1, 'cust-' || CAST(c_custkey AS VARCHAR),
    'fee-' || CAST(c_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m'),
    CAST(-1.50 AS DECIMAL(15,2)), 'MONTHLY FEE', CAST(o_orderdate AS DATE),
    CAST([] AS VARCHAR[]), false
  FROM oc WHERE o_orderstatus <> 'O'),
bo AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS ext_id FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
mapping AS (SELECT 'cust-' || account_id AS ext_id, account_id FROM accounts),
sync_mapping AS (SELECT * FROM mapping UNION ALL SELECT DISTINCT sf_account_id, 'acct-' || sf_account_id FROM pa_tx
                 WHERE sf_account_id NOT IN (SELECT ext_id FROM mapping)),
synced AS (SELECT t.*, m.account_id FROM pa_tx t JOIN sync_mapping m ON t.sf_account_id = m.ext_id
           WHERE t.sf_account_id NOT IN (SELECT ext_id FROM bo)),
first_tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sf_id ORDER BY payload_id, tx_pos) AS rn
             FROM synced) WHERE rn = 1),
new_tx AS (SELECT * FROM first_tx WHERE sf_id NOT IN (SELECT sf_id FROM transactions WHERE sf_id IS NOT NULL))
"""


def _sql(body: str, *views_needed: str) -> str:
    return with_views_ctes(_BASE, body, "accounts", "transactions", *views_needed)


# --------------------------------------------------------------------------- provider A

@query("prov_a_transactions", _sql("""
SELECT payload_id, tx_pos, sf_account_id, sf_id, amount, description, transaction_date,
  array_to_string(tags, '|') AS tags, sf_pending FROM pa_tx"""))
def prov_a_transactions(spark, d):
    """Payload A transactions, flattened and typed."""
    t = providers.a_transactions(_pa(spark, d))
    return t.select("payload_id", "tx_pos", "sf_account_id", "sf_id", "amount", "description",
                    "transaction_date", F.array_join("tags", "|").alias("tags"), "sf_pending")


@query("prov_a_accounts", _sql("""
SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS sf_id, c_name AS name,
  CASE WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS currency,
  n_name AS institution_name, 'https://' || lower(n_name) || '.example' AS institution_url,
  lower(n_name) || '.example' AS institution_domain,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'n/a'
    ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) END AS sf_balance,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) END
    AS sf_balance_date
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn
      FROM oc WHERE o_orderstatus <> 'O') WHERE rn = 1"""))
def prov_a_accounts(spark, d):
    """Provider accounts; the newest payload's values win."""
    return providers.a_accounts(_pa(spark, d)).select(
        "sf_id", "name", "currency", "institution_name", "institution_url", "institution_domain",
        "sf_balance", "sf_balance_date")


@query("prov_a_snapshots", _sql(f"""
SELECT o_orderkey AS payload_id, 'cust-' || CAST(c_custkey AS VARCHAR) AS sf_account_id,
  CAST(c_acctbal AS DECIMAL(15,2)) AS balance,
  CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '{AS_OF_TS}' ELSE o_orderdate END AS snapshot_time,
  'sync' AS source
FROM oc WHERE o_orderstatus <> 'O' AND c_mktsegment <> 'AUTOMOBILE'"""))
def prov_a_snapshots(spark, d):
    """A snapshot per payload account whose balance parses."""
    return providers.a_snapshots(_pa(spark, d), AS_OF_TS)


# --------------------------------------------------------------------------- provider B

@query("prov_b_accounts", _sql("""
SELECT CAST(c_custkey AS VARCHAR) AS lf_id, c_name AS name,
  CASE WHEN n_regionkey = 1 THEN 'CAD' WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS currency,
  n_name AS institution_name, 'bank' AS lf_provider,
  CASE WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS lf_currency,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'ACTIVE' END AS lf_status,
  CAST(c_acctbal AS DECIMAL(15,2)) AS balance
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn
      FROM oc WHERE o_orderstatus = 'O' AND c_mktsegment <> 'FURNITURE') WHERE rn = 1"""))
def prov_b_accounts(spark, d):
    """Active accounts; balance currency replaces a USD core currency."""
    return providers.b_accounts(_pb(spark, d))


@query("prov_b_transactions", _sql("""
SELECT o_orderkey AS payload_id, 0 AS tx_pos, 'lf-' || CAST(o_orderkey AS VARCHAR) AS lf_id,
  CAST(c_custkey AS VARCHAR) AS lf_account_id, CAST(-o_totalprice AS DECIMAL(15,2)) AS amount,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'MERCHANT ' || CAST(c_custkey AS VARCHAR)
    ELSE 'ORDER ' || CAST(o_orderkey AS VARCHAR) END AS description,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS transaction_date,
  o_orderpriority = '4-NOT SPECIFIED' AS lf_is_pending
FROM oc WHERE o_orderstatus = 'O'"""))
def prov_b_transactions(spark, d):
    """Numbers-or-strings, first non-blank description."""
    return providers.b_transactions(_pb(spark, d)).select(
        "payload_id", "tx_pos", "lf_id", "lf_account_id", "amount", "description",
        "transaction_date", "lf_is_pending")


# --------------------------------------------------------------------------- sync

@query("sync_balances_only", _sql("""
SELECT DISTINCT sf_account_id AS ext_id FROM pa_tx WHERE sf_account_id IN (SELECT ext_id FROM bo)"""))
def sync_balances_only(spark, d):
    """Payload accounts whose settings ask for balances only."""
    bo = providers.balances_only_ids(providers.fixture_settings(spark, d))
    acc = providers.a_accounts(_pa(spark, d)).select(F.col("sf_id").alias("ext_id"))
    return acc.join(bo, "ext_id", "left_semi")


@query("sync_map_accounts", _sql("""
SELECT sf_id, payload_id, tx_pos, account_id FROM synced"""))
def sync_map_accounts(spark, d):
    """Provider transactions mapped to ledger accounts; unmapped dropped."""
    return _synced_tx(spark, d).select("sf_id", "payload_id", "tx_pos", "account_id")


@query("dedup_provider_id", _sql("""
SELECT sf_id, payload_id, tx_pos FROM new_tx"""))
def dedup_provider_id(spark, d):
    """First per provider id in the batch, minus ids already in the ledger."""
    new = sync.new_transactions(_synced_tx(spark, d), ledger.transactions(spark, d))
    return new.select("sf_id", "payload_id", "tx_pos")


@query("sync_stats", _sql("""
SELECT (SELECT count(*) FROM synced) AS discovered, (SELECT count(*) FROM new_tx) AS new,
  (SELECT count(*) FROM synced) - (SELECT count(*) FROM new_tx) AS skipped,
  (SELECT count(DISTINCT sf_account_id) FROM pa_tx
   WHERE sf_account_id NOT IN (SELECT ext_id FROM mapping)) AS new_accounts"""))
def sync_stats(spark, d):
    """One row of sync counters."""
    pa = materialize(_pa(spark, d))
    tx = _synced_tx(spark, d, pa)
    new = sync.new_transactions(tx, ledger.transactions(spark, d))
    acc = providers.a_accounts(pa)
    return sync.sync_stats(tx, new, acc, "sf_id", _mapping(spark, d))


@query("sync_window", with_views("""
SELECT max(transaction_date) AS max_date, CAST(max(transaction_date) - INTERVAL 7 DAY AS DATE) AS start_date,
  DATE '{as_of}' AS end_date,
  CAST(epoch(max(transaction_date) - INTERVAL 7 DAY) AS BIGINT) AS start_epoch,
  CAST(epoch(DATE '{as_of}') AS BIGINT) + 86399 AS end_epoch
FROM transactions WHERE deleted_at IS NULL""".format(as_of=AS_OF), "transactions"))
def sync_window(spark, d):
    """The fetch window of the next sync."""
    return sync.sync_window(ledger.transactions(spark, d), AS_OF).select(
        "max_date", F.col("start_date").cast("date").alias("start_date"), "end_date",
        "start_epoch", "end_epoch")


def _fold_sql(inner: str) -> str:
    sql = inner
    for rid, _name, cond, tags, enabled, _order in sorted(config.RULE_ROWS, key=lambda r: r[5]):
        if not enabled or not tags or rid in config.BROKEN_RULES:
            continue
        arr = "[" + ", ".join(f"'{t}'" for t in tags) + "]"
        sql = (f"SELECT * REPLACE (CASE WHEN coalesce(({cond}), false) THEN tags || "
               f"list_filter({arr}, lambda x: NOT list_contains(tags, x)) ELSE tags END AS tags) "
               f"FROM ({sql}) q_{rid}")
    return sql


@query("sync_end_to_end", _sql(", fresh AS (SELECT 'tx-' || n.sf_id AS transaction_id, n.account_id, "
                               "n.amount, n.description, n.transaction_date, n.tags, len(n.tags) AS n0, "
                               "a.account_type, 'simplefin' AS source FROM new_tx n "
                               "LEFT JOIN accounts a USING (account_id))\n" + f"""
SELECT transaction_id, account_id, amount, transaction_date, array_to_string(tags, '|') AS tags,
  len(tags) > n0 AS tags_auto_applied FROM ({_fold_sql('SELECT * FROM fresh')}) f"""))
def sync_end_to_end(spark, d):
    """Map -> balances-only filter -> dedup -> ledger rows -> auto-tag."""
    new = sync.new_transactions(_synced_tx(spark, d), ledger.transactions(spark, d))
    view = views.transactions_view(sync.ledger_rows(new, "sf_id"), ledger.accounts(spark, d))
    tagged = tagging.apply_rules(view, tagging.load_rules(config.rules(spark)))
    return tagged.select("transaction_id", "account_id", "amount", "transaction_date",
                         F.array_join("tags", "|").alias("tags"), "tags_auto_applied")


# --------------------------------------------------------------------------- merges

_ACC_COLS = ["account_id", "name", "nickname", "account_type", "classification", "currency",
             "institution_name", "created_at", "updated_at", "is_manual"]


def _incoming_accounts(spark, d):
    acc = providers.a_accounts(_pa(spark, d))
    m = _mapping(spark, d).withColumnRenamed("ext_id", "sf_id")
    return acc.join(m, "sf_id", "left").select(
        F.coalesce(F.col("account_id"), F.concat(F.lit("acct-"), F.col("sf_id"))).alias("account_id"),
        "name", "currency", "institution_name", "institution_url", "sf_id", "sf_balance",
        F.lit(False).alias("is_manual"),
        F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}'").alias("created_at"),
        F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}'").alias("updated_at"))


@query("merge_accounts", _sql(f"""
, inc AS (SELECT coalesce(m.account_id, 'acct-' || p.sf_id) AS account_id, p.* EXCLUDE (sf_id), p.sf_id
  FROM (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS sf_id, c_name AS name,
          CASE WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS currency, n_name AS institution_name,
          'https://' || lower(n_name) || '.example' AS institution_url
        FROM (SELECT DISTINCT c_custkey, c_name, n_regionkey, n_name FROM oc WHERE o_orderstatus <> 'O')) p
  LEFT JOIN mapping m ON m.ext_id = p.sf_id)
SELECT coalesce(e.account_id, i.account_id) AS account_id,
  CASE WHEN i.account_id IS NOT NULL THEN i.name ELSE e.name END AS name,
  e.nickname AS nickname,
  CASE WHEN e.account_id IS NOT NULL THEN e.account_type END AS account_type,
  CASE WHEN e.account_id IS NOT NULL THEN e.classification END AS classification,
  CASE WHEN i.account_id IS NOT NULL THEN i.currency ELSE e.currency END AS currency,
  CASE WHEN i.account_id IS NOT NULL THEN coalesce(i.institution_name, e.institution_name)
       ELSE e.institution_name END AS institution_name,
  i.institution_url AS institution_url, i.sf_id AS sf_id,
  CASE WHEN e.account_id IS NOT NULL THEN coalesce(e.is_manual, false) ELSE false END AS is_manual,
  CASE WHEN e.account_id IS NOT NULL THEN e.created_at ELSE TIMESTAMP '{AS_OF_TS}' END AS created_at,
  CASE WHEN i.account_id IS NOT NULL THEN TIMESTAMP '{AS_OF_TS}' ELSE e.updated_at END AS updated_at
FROM accounts e FULL OUTER JOIN inc i ON e.account_id = i.account_id"""))
def merge_accounts(spark, d):
    """M1: ledger accounts upserted with the provider's view of them."""
    existing = ledger.accounts(spark, d).select(*_ACC_COLS)
    inc = _incoming_accounts(spark, d)
    older = inc.withColumn("name", F.lit("older")).withColumn("updated_at", F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}' - INTERVAL 1 DAY"))
    merged = merge.merge_accounts(existing, inc.unionByName(older), ["updated_at"])
    return merged.select("account_id", "name", "nickname", "account_type", "classification",
                         "currency", "institution_name", "institution_url", "sf_id", "is_manual",
                         "created_at", "updated_at")


_TX_COLS = ["transaction_id", "account_id", "amount", "description", "transaction_date", "tags",
            "is_manual", "tags_auto_applied", "deleted_at", "created_at", "updated_at", "sf_id"]


@query("merge_transactions", _sql(f"""
, inc AS (SELECT coalesce(t.transaction_id, 'tx-' || f.sf_id) AS transaction_id, f.account_id, f.amount,
    f.description, f.transaction_date, f.tags, f.sf_id
  FROM first_tx f LEFT JOIN (SELECT transaction_id, sf_id FROM transactions WHERE sf_id IS NOT NULL) t
    USING (sf_id))
SELECT coalesce(e.transaction_id, i.transaction_id) AS transaction_id,
  CASE WHEN i.transaction_id IS NOT NULL THEN i.account_id ELSE e.account_id END AS account_id,
  CASE WHEN i.transaction_id IS NOT NULL THEN i.amount ELSE e.amount END AS amount,
  CASE WHEN i.transaction_id IS NOT NULL THEN i.description ELSE e.description END AS description,
  CASE WHEN i.transaction_id IS NOT NULL THEN i.transaction_date ELSE e.transaction_date END
    AS transaction_date,
  array_to_string(CASE WHEN i.transaction_id IS NOT NULL THEN i.tags ELSE e.tags END, '|') AS tags,
  CASE WHEN e.transaction_id IS NOT NULL THEN coalesce(e.is_manual, false) ELSE false END AS is_manual,
  CASE WHEN e.transaction_id IS NOT NULL THEN coalesce(e.tags_auto_applied, false) ELSE false END
    AS tags_auto_applied,
  e.deleted_at AS deleted_at,
  CASE WHEN i.transaction_id IS NOT NULL THEN coalesce(i.sf_id, e.sf_id) ELSE e.sf_id END AS sf_id
FROM transactions e FULL OUTER JOIN inc i ON e.transaction_id = i.transaction_id"""))
def merge_transactions(spark, d):
    """M2: the provider batch upserted into the ledger; known provider ids
    refresh their ledger row (user flags and deleted_at kept), new ones insert."""
    tx = ledger.transactions(spark, d)
    inc = _batch(spark, d, tx)
    return _shown(merge.merge_transactions(tx.select(*_TX_COLS), _sent_twice(inc), ["updated_at", "amount"]))


def _batch(spark, d, tx):
    """The provider's first row per id under its ledger id, or a new one."""
    first = dedup.first_per_key(_synced_tx(spark, d), "sf_id", ["payload_id", "tx_pos"])
    known = tx.where(F.col("sf_id").isNotNull()).select("transaction_id", "sf_id")
    return first.join(known, "sf_id", "left").select(
        F.coalesce(F.col("transaction_id"), F.concat(F.lit("tx-"), F.col("sf_id"))).alias("transaction_id"),
        "account_id", "amount", "description", "transaction_date", "tags", "sf_id",
        F.lit(False).alias("is_manual"), F.lit(False).alias("tags_auto_applied"),
        F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}'").alias("created_at"),
        F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}'").alias("updated_at"))


def _sent_twice(batch):
    """The batch, with an older and wrong version of every row before it."""
    older = batch.withColumn("amount", F.lit(0).cast("decimal(15,2)")).withColumn("description", F.lit("older")) \
        .withColumn("updated_at", F.expr(f"TIMESTAMP_NTZ '{AS_OF_TS}' - INTERVAL 1 DAY"))
    return batch.unionByName(older)


def _shown(merged):
    return merged.select("transaction_id", "account_id", "amount", "description", "transaction_date",
                         F.array_join("tags", "|").alias("tags"), "is_manual", "tags_auto_applied",
                         "deleted_at", "sf_id")


STORED_PARTS = 16


@query("merge_stored", ORACLES["merge_transactions"])
def merge_stored(spark, d):
    """M2 on a table stored by key: only the parts that the batch falls into are written again."""
    tx = ledger.transactions(spark, d).select(*_TX_COLS)
    path = scratch_path(spark, "ledger")
    merge.store(tx, path, "transaction_id", STORED_PARTS)
    merge.merge_stored(spark, path, STORED_PARTS, tx.schema, _sent_twice(materialize(_batch(spark, d, tx))), "transaction_id",
                       merge.TRANSACTION_PRECEDENCE, ["updated_at", "amount"])
    return _shown(merge.stored(spark, path, tx.schema))


@query("insert_if_absent", _sql("""
SELECT transaction_id, account_id, amount, false AS inserted FROM transactions
UNION ALL
SELECT sf_id, arg_min(sf_account_id, payload_id), arg_min(amount, payload_id), true FROM pa_tx WHERE tx_pos = 1
GROUP BY sf_id"""))
def insert_if_absent(spark, d):
    """M3: the new table; rows are inserted only when absent (user edits kept)."""
    tx = ledger.transactions(spark, d).select("transaction_id", "account_id", "amount")
    b = providers.b_transactions(_pb(spark, d)).select(
        F.col("payload_id").cast("string").alias("transaction_id"),
        F.col("lf_account_id").alias("account_id"), "amount")
    fees = dedup.first_per_key(
        providers.a_transactions(_pa(spark, d)).where(F.col("tx_pos") == 1)
        .select(F.col("sf_id").alias("transaction_id"), F.col("sf_account_id").alias("account_id"),
                "amount", "payload_id"), "transaction_id", ["payload_id"]).drop("payload_id")
    new, flags = merge.insert_if_absent(tx, b.unionByName(fees), "transaction_id")
    return (new.join(flags.where("inserted").select("transaction_id", "inserted"), "transaction_id", "left")
            .withColumn("inserted", F.coalesce("inserted", F.lit(False))))


@query("delete_account_cascade", with_views("""
SELECT 'accounts' AS table_name, account_id AS row_id, account_id FROM accounts WHERE trim(currency) <> ''
UNION ALL SELECT 'transactions', transaction_id, account_id FROM transactions WHERE account_id NOT IN
  (SELECT account_id FROM accounts WHERE trim(currency) = '')
UNION ALL SELECT 'balance_snapshots', snapshot_id, account_id FROM balance_snapshots WHERE account_id NOT IN
  (SELECT account_id FROM accounts WHERE trim(currency) = '')""",
                                           "accounts", "transactions", "balance_snapshots"))
def delete_account_cascade(spark, d):
    """M4: the rows of all three tables after the invalid accounts were deleted with theirs."""
    acc = ledger.accounts(spark, d)
    doomed = views.invalid_accounts(acc)
    a, t, s = merge.delete_accounts_cascade(acc, ledger.transactions(spark, d),
                                            ledger.balance_snapshots(spark, d), doomed)
    rows = lambda name, df, key: df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "account_id")
    return (rows("accounts", a, "account_id").unionByName(rows("transactions", t, "transaction_id"))
            .unionByName(rows("balance_snapshots", s, "snapshot_id")))


@query("soft_delete", with_views(f"""
SELECT transaction_id, CASE WHEN transaction_date = DATE '{SOFT_DELETE_DAY}' THEN coalesce(deleted_at, TIMESTAMP '{AS_OF_TS}')
  ELSE deleted_at END AS deleted_at FROM transactions""", "transactions"))
def soft_delete(spark, d):
    """M5: the new table after one day's transactions were soft-deleted; rows stay for dedup."""
    tx = ledger.transactions(spark, d)
    ids = tx.where(F.col("transaction_date") == F.lit(SOFT_DELETE_DAY).cast("date")).select("transaction_id")
    return merge.soft_delete(tx, ids, AS_OF_TS).select("transaction_id", "deleted_at")


@query("split_balance_check", with_views("""
SELECT k.transaction_id, k.n_children, k.children_total, p.amount AS parent_amount,
  coalesce(k.children_total = p.amount, false) AS balanced
FROM (SELECT parent_transaction_id AS transaction_id, count(*) AS n_children,
        CAST(sum(amount) AS DECIMAL(18,2)) AS children_total FROM transactions
      WHERE parent_transaction_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1) k
LEFT JOIN transactions p USING (transaction_id)""", "transactions"))
def split_balance_check(spark, d):
    """M6: split children should add up to their parent."""
    return merge.split_check(ledger.transactions(spark, d))


@query("dedup_snapshots", with_views("""
SELECT 'in-' || CAST(event_id AS VARCHAR) AS snapshot_id, CAST(user_id AS VARCHAR) AS account_id,
  round(CAST(value AS DECIMAL(15,2)), 1) AS balance, ts AS snapshot_time
FROM events e WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM balance_snapshots s WHERE s.account_id = CAST(e.user_id AS VARCHAR)
    AND CAST(s.snapshot_time AS DATE) = CAST(e.ts AS DATE)
    AND abs(s.balance - round(CAST(e.value AS DECIMAL(15,2)), 1)) < 0.01)""", "balance_snapshots"))
def dedup_snapshots(spark, d):
    """Incoming snapshots (balances rounded to 0.1) that are not within
    0.01 of a same-day snapshot of the account."""
    from ..sources.tables import table
    e = table(spark, d, "events").where(F.col("event_type") == "click")
    inc = e.select(F.concat(F.lit("in-"), F.col("event_id").cast("string")).alias("snapshot_id"),
                   F.col("user_id").cast("string").alias("account_id"),
                   F.round(F.col("value").cast("decimal(15,2)"), 1).alias("balance"),
                   F.col("ts").alias("snapshot_time"))
    return dedup.new_snapshots(inc, ledger.balance_snapshots(spark, d))


# --------------------------------------------------------------------------- schedules

@query("schedule_expand", f"""
WITH r AS (SELECT 'sched-' || CAST(c_custkey AS VARCHAR) AS schedule_id,
    CAST(c_custkey AS VARCHAR) AS account_id,
    c_mktsegment IN ('HOUSEHOLD', 'BUILDING') AS monthly, c_nationkey + 1 AS dom,
    3 + CAST(floor(c_nationkey / 5) AS INTEGER) AS n,
    CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING')
      THEN [CAST(c_acctbal AS DECIMAL(15,2)), CAST(CAST(c_acctbal AS DECIMAL(15,2)) * 2 AS DECIMAL(15,2))]
      ELSE [CAST(-CAST(c_acctbal AS DECIMAL(15,2)) AS DECIMAL(15,2)),
            CAST(-CAST(c_acctbal AS DECIMAL(15,2)) * 3 AS DECIMAL(15,2)), CAST(-12.34 AS DECIMAL(15,2))] END
      AS amounts,
    CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'PAYROLL DEPOSIT' ELSE 'CARD SPEND' END
      AS description
  FROM customer WHERE c_acctbal >= 0),
g AS (SELECT r.*, CAST(t.d AS DATE) AS date, DATE '{AS_OF}' - CAST(t.d AS DATE) AS ago
  FROM r, generate_series(DATE '{AS_OF}' - INTERVAL 179 DAY, DATE '{AS_OF}', INTERVAL 1 DAY) t(d))
SELECT schedule_id, account_id, date, amounts[(ago % len(amounts)) + 1] AS amount, description
FROM g WHERE CASE WHEN monthly THEN day(date) = dom ELSE ago % n = 0 END""")
def schedule_expand(spark, d):
    """Recurring schedules expanded over 180 days."""
    return schedule.expand(schedule.fixture_rules(spark, d), AS_OF)


@query("sync_snapshots", _sql(f"""
, inc AS (SELECT m.account_id, CAST(c_acctbal AS DECIMAL(15,2)) AS balance,
    CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '{AS_OF_TS}' ELSE o_orderdate END AS snapshot_time,
    o_orderkey AS payload_id
  FROM oc JOIN sync_mapping m ON m.ext_id = 'cust-' || CAST(c_custkey AS VARCHAR)
  WHERE o_orderstatus <> 'O' AND c_mktsegment <> 'AUTOMOBILE')
SELECT i.payload_id, i.account_id, i.balance, i.snapshot_time FROM inc i"""))
def sync_snapshots(spark, d):
    """S2 snapshot branch: every provider balance, mapped to its ledger account."""
    snaps = providers.a_snapshots(_pa(spark, d), AS_OF_TS)
    return sync.map_accounts(snaps, "sf_account_id", _sync_mapping(spark, d)).select(
        "payload_id", "account_id", "balance", "snapshot_time")


@query("sync_b_transactions", _sql("""
, b AS (SELECT o_orderkey AS payload_id, 0 AS tx_pos, 'lf-' || CAST(o_orderkey AS VARCHAR) AS lf_id,
    CAST(c_custkey AS VARCHAR) AS lf_account_id FROM oc
  WHERE o_orderstatus = 'O' AND c_mktsegment <> 'FURNITURE')
SELECT b.lf_id, b.payload_id, coalesce(a.account_id, 'acct-' || b.lf_account_id) AS account_id
FROM b LEFT JOIN accounts a ON a.account_id = b.lf_account_id
WHERE b.lf_id NOT IN (SELECT lf_id FROM transactions WHERE lf_id IS NOT NULL)"""))
def sync_b_transactions(spark, d):
    """S2 for provider B: transactions of active accounts, mapped by the
    provider's account id, first per id, minus ids the ledger has (J6)."""
    pb = _pb(spark, d)
    active_ids = providers.b_accounts(pb).select(F.col("lf_id").alias("lf_account_id"))
    tx = providers.b_transactions(pb).join(active_ids, "lf_account_id", "left_semi")
    known = ledger.accounts(spark, d).select(F.col("account_id").alias("ext_id"), "account_id")
    mapping = sync.with_new_accounts(known, providers.b_accounts(pb), "lf_id")
    mapped = sync.map_accounts(tx, "lf_account_id", mapping)
    new = sync.new_transactions(mapped, ledger.transactions(spark, d), id_col="lf_id",
                                ext_col="lf_account_id")
    return new.select("lf_id", "payload_id", "account_id")
