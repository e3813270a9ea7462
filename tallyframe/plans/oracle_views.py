"""The ledger views of ``sources/ledger.py`` as DuckDB text, for the oracle.

``with_views(body, *names)`` prefixes a query with the CTEs it needs, so each
oracle string is one self-contained statement over the driver's tables.
"""

from __future__ import annotations

AS_OF = "2001-08-01"
EVENTS_KNOWN_DATE = "2024-01-25"


def sql_norm_description(x: str) -> str:
    """N1 in DuckDB: same steps as functions.text.norm_description."""
    a = (f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\bnull\\b', '', 'g'), "
         f"'x{{10,}}\\d{{4}}', '', 'g')")
    r = "'[x0-9]{7,12}'"
    digits = "regexp_replace(z[2], '[^0-9]', '', 'g')"
    glued = (f"list_transform(list_zip(string_split_regex({a}, {r}), regexp_extract_all({a}, {r})), "
             f"lambda z: coalesce(z[1], '') || CASE WHEN z[2] IS NULL THEN '' "
             f"WHEN length({digits}) >= 4 THEN right({digits}, 4) ELSE z[2] END)")
    return f"regexp_replace(array_to_string({glued}, ''), '[^a-z0-9]', '', 'g')"


def sql_fingerprint(account: str, date: str, amount: str, desc: str) -> str:
    payload = (f"coalesce(CAST({account} AS VARCHAR), '') || '|' || "
               f"coalesce(strftime({date}, '%Y-%m-%d'), '') || '|' || "
               f"coalesce(CAST(CAST({amount} AS DECIMAL(15,2)) AS VARCHAR), '') || '|' || "
               f"{sql_norm_description(desc)}")
    return f"substr(sha256({payload}), 1, 16)"


VIEWS: dict[str, str] = {}

VIEWS["accounts"] = """
SELECT CAST(c.c_custkey AS VARCHAR) AS account_id, c.c_name AS name,
  CAST(NULL AS VARCHAR) AS nickname,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'depository' WHEN 'AUTOMOBILE' THEN 'loan'
    WHEN 'FURNITURE' THEN 'credit' WHEN 'MACHINERY' THEN 'investment' ELSE 'other' END
    AS account_type,
  CAST(NULL AS VARCHAR) AS classification,
  CASE WHEN n.n_regionkey = 3 THEN ' eur '
       WHEN n.n_regionkey = 0 AND c.c_mktsegment = 'BUILDING' THEN '' ELSE 'usd ' END
    AS currency,
  CAST(NULL AS DECIMAL(15,2)) AS balance, n.n_name AS institution_name,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at,
  c.c_mktsegment = 'BUILDING' AS is_manual
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal >= 0
"""

_ORDER_TX_BASE = """
SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
  CAST(o_custkey AS VARCHAR) AS account_id,
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(15,2))
    AS amount,
  (CASE WHEN o_orderstatus = 'P' THEN 'null ' ELSE '' END) || 'POS ' || o_orderpriority
    || ' XXXXXXXXXXXX' || right('0000' || CAST(o_custkey AS VARCHAR), 4) || ' REF '
    || CAST(o_orderkey AS VARCHAR) AS description,
  CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(o_orderdate AS DATE) + 1 AS posted_date,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST([] AS VARCHAR[])
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN CAST(NULL AS VARCHAR[])
       WHEN o_orderstatus = 'F' THEN [lower(substr(o_orderpriority, 3, 100))]
       ELSE [lower(substr(o_orderpriority, 3, 100)),
             CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'pending' END] END AS tags,
  CASE WHEN o_orderpriority = '2-HIGH' THEN '{"simplefin":"sf-' || CAST(o_orderkey AS VARCHAR) || '"}'
       WHEN o_orderpriority = '3-MEDIUM' THEN '{"lunchflow":"lf-' || CAST(o_orderkey AS VARCHAR) || '"}'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '{"csv_import.batch_id":"import_'
            || strftime(o_orderdate, '%Y%m%d') || '_000000","fingerprint":"fp-'
            || CAST(o_orderkey AS VARCHAR) || '"}'
       WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN '{"manual":true}'
       ELSE '{}' END AS external_ids,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
       THEN TIMESTAMP '2001-08-01 00:00:00' END AS deleted_at,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
       THEN 'split-' || CAST(o_orderkey AS VARCHAR) END AS parent_transaction_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
       THEN 'import_' || strftime(o_orderdate, '%Y%m%d') || '_000000' END AS csv_batch_id,
  (o_orderpriority = '5-LOW' AND o_orderstatus = 'O') AS is_manual,
  false AS tags_auto_applied,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'sf-' || CAST(o_orderkey AS VARCHAR) END AS sf_id,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'lf-' || CAST(o_orderkey AS VARCHAR) END AS lf_id
FROM orders
"""

VIEWS["transactions"] = f"""
SELECT *, CASE WHEN csv_batch_id IS NOT NULL THEN
  {sql_fingerprint('account_id', 'transaction_date', 'amount', 'description')} END AS csv_fingerprint
FROM ({_ORDER_TX_BASE}) ot
UNION ALL BY NAME
SELECT 'ev-' || CAST(event_id AS VARCHAR) AS transaction_id,
  CAST(user_id AS VARCHAR) AS account_id,
  CAST(CASE WHEN event_type = 'signup' THEN value ELSE -value END AS DECIMAL(15,2)) AS amount,
  upper(event_type) || ' ' || props AS description,
  CAST(ts AS DATE) AS transaction_date, CAST(ts AS DATE) AS posted_date,
  [event_type] AS tags, '{{}}' AS external_ids, ts AS created_at, ts AS updated_at,
  CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS VARCHAR) AS parent_transaction_id,
  CAST(NULL AS VARCHAR) AS csv_batch_id, false AS is_manual, false AS tags_auto_applied,
  CAST(NULL AS VARCHAR) AS sf_id, CAST(NULL AS VARCHAR) AS lf_id,
  CAST(NULL AS VARCHAR) AS csv_fingerprint
FROM events WHERE event_type IN ('signup', 'purchase')
"""

VIEWS["balance_snapshots"] = """
SELECT CAST(event_id AS VARCHAR) AS snapshot_id, CAST(user_id AS VARCHAR) AS account_id,
  CAST(value AS DECIMAL(15,2)) AS balance, ts AS snapshot_time,
  CASE WHEN event_type = 'view' THEN 'sync' ELSE 'manual' END AS source,
  ts AS created_at, ts AS updated_at
FROM events WHERE event_type IN ('view', 'click')
"""

VIEWS["logs"] = """
SELECT event_id AS id, epoch_us(ts) // 1000 AS "timestamp",
  CASE WHEN event_type IN ('view', 'click') THEN 'app' ELSE 'cli' END AS entry_point,
  '1.0.0' AS app_version, 'linux' AS platform, event_type AS event,
  CASE WHEN event_type = 'signup' THEN 'simplefin' WHEN event_type = 'error' THEN 'lunchflow' END
    AS integration,
  CASE WHEN event_type IN ('view', 'click') THEN 'page-' || json_extract_string(props, '$.k') END
    AS page,
  CASE WHEN event_type IN ('signup', 'error') THEN 'sync' WHEN event_type = 'purchase' THEN 'import' END
    AS command,
  CASE WHEN event_type = 'error' THEN props END AS error_message,
  CASE WHEN event_type = 'error' THEN 'value=' || CAST(CAST(value AS DECIMAL(15,2)) AS VARCHAR) END
    AS error_details
FROM events
"""

VIEWS["anchors"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS account_id,
  CAST(c_acctbal AS DECIMAL(15,2)) AS known_balance, DATE '{EVENTS_KNOWN_DATE}' AS known_date
FROM customer WHERE c_acctbal >= 0
"""

# Views derived from the base views (kept in dependency order).
VIEWS["tx_view"] = """
SELECT t.*, a.name AS account_name, a.account_type, a.currency AS account_currency,
  a.institution_name,
  CASE WHEN t.sf_id IS NOT NULL THEN 'simplefin' WHEN t.lf_id IS NOT NULL THEN 'lunchflow'
       WHEN t.csv_batch_id IS NOT NULL THEN 'csv_import'
       WHEN t.parent_transaction_id IS NOT NULL THEN 'split'
       WHEN t.is_manual THEN 'manual' ELSE 'unknown' END AS source
FROM transactions t LEFT JOIN accounts a ON t.account_id = a.account_id
WHERE t.deleted_at IS NULL
"""

_DEPS = {"tx_view": ["transactions", "accounts"]}


def with_views(body: str, *names: str) -> str:
    needed: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in needed:
            needed.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def _config_views():
    from ..operators.budget import CATEGORY_SCHEMA, OVERRIDE_SCHEMA, ROLLOVER_SCHEMA
    from ..sources import config
    VIEWS["categories"] = config.values_sql(config.category_rows(), CATEGORY_SCHEMA)
    VIEWS["rollovers"] = config.values_sql(config.rollover_rows(), ROLLOVER_SCHEMA)
    VIEWS["overrides"] = config.values_sql(config.OVERRIDE_ROWS, OVERRIDE_SCHEMA)
    VIEWS["rules"] = config.values_sql(config.RULE_ROWS, config.RULE_SCHEMA)


_config_views()


def with_views_ctes(extra_ctes: str, body: str, *names: str) -> str:
    """Like ``with_views`` with more CTEs (text 'a AS (...), b AS (...)') after
    the views and before the body."""
    base = with_views("SELECT 1", *names)
    ctes = base[len("WITH "):-len("\nSELECT 1")]
    return f"WITH {ctes},\n{extra_ctes.strip().rstrip(',')}\n{body}"
