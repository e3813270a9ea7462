"""Registered queries: data quality, status, event log, budget, tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, logs, quality, tagging, views
from ..sources import config, ledger
from .oracle_views import with_views, with_views_ctes
from .registry import query

AS_OF = ledger.AS_OF
LOG_AS_OF_MS = 1707955200000      # 2024-02-15 00:00:00 UTC
RECENT_N = 50
TAG_DAY = "1996-06-03"
TAG_EXTRA_IDS = ["", "missing-1"]


def _tx(spark, d):
    return ledger.transactions(spark, d)


# --- data quality -----------------------------------------------------------

@query("dq_orphan_transactions", with_views("""
SELECT t.transaction_id, t.account_id FROM transactions t
WHERE t.deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = t.account_id)
""", "transactions", "accounts"))
def dq_orphan_transactions(spark, d):
    return quality.orphan_transactions(_tx(spark, d), ledger.accounts(spark, d))


@query("dq_orphan_snapshots", with_views("""
SELECT s.snapshot_id, s.account_id FROM balance_snapshots s
WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = s.account_id)
""", "balance_snapshots", "accounts"))
def dq_orphan_snapshots(spark, d):
    return quality.orphan_snapshots(ledger.balance_snapshots(spark, d), ledger.accounts(spark, d))


@query("dq_date_sanity", with_views(f"""
SELECT transaction_id, transaction_date, coalesce(description, '') AS description, amount
FROM transactions WHERE deleted_at IS NULL
  AND (transaction_date > DATE '{AS_OF}' + INTERVAL 365 DAY OR transaction_date < DATE '1970-01-01')""", "transactions"))
def dq_date_sanity(spark, d):
    """D3 details: all offending rows; a screen takes its first ones by `quality.sample`."""
    return quality.insane_dates(_tx(spark, d), AS_OF)


@query("dq_future", with_views(f"""
SELECT transaction_id, transaction_date FROM transactions
WHERE deleted_at IS NULL AND transaction_date > DATE '{AS_OF}' + INTERVAL 1 DAY""", "transactions"))
def dq_future(spark, d):
    return quality.future_transactions(_tx(spark, d), AS_OF).select(
        "transaction_id", "transaction_date")


@query("dq_untagged", with_views("""
SELECT count(*) FILTER (WHERE tags IS NULL OR len(tags) = 0) AS untagged, count(*) AS total,
  CAST(CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE tags IS NULL OR len(tags) = 0)
       * 100 / count(*)) ELSE 0 END AS BIGINT) AS untagged_pct,
  count(*) FILTER (WHERE (tags IS NULL OR len(tags) = 0) AND amount < 0) AS uncategorized_expenses
FROM transactions WHERE deleted_at IS NULL""", "transactions"))
def dq_untagged(spark, d):
    return quality.untagged_stats(_tx(spark, d))


_BUDGET_MATCH_SQL = """
bm AS (SELECT t.transaction_id, t.account_id, t.amount, t.transaction_date,
         strftime(t.transaction_date, '%Y-%m') AS month, c.category_id, c.name, c.type
       FROM transactions t JOIN categories c ON strftime(t.transaction_date, '%Y-%m') = c.month
       WHERE t.deleted_at IS NULL AND len(c.tags) > 0
         AND (CASE WHEN c.require_all
                   THEN len(list_filter(c.tags, lambda x: NOT list_contains(coalesce(t.tags, []), x))) = 0
                   ELSE coalesce(list_has_any(c.tags, coalesce(t.tags, [])), false) END)
         AND (CASE WHEN c.amount_sign = 'positive' THEN t.amount > 0
                   WHEN c.amount_sign = 'negative' THEN t.amount < 0 ELSE true END))
"""


def _budget_sql(body: str, *extra: str) -> str:
    base = with_views("SELECT 1", "transactions", "categories", *extra)
    ctes = base[len("WITH "):-len("\nSELECT 1")]
    return f"WITH {ctes},\n{_BUDGET_MATCH_SQL}\n{body}"


@query("dq_budget_double_count", _budget_sql("""
SELECT transaction_id, month, count(*) AS n_categories,
  array_to_string(list_sort(list(DISTINCT category_id)), '|') AS categories
FROM bm GROUP BY transaction_id, month HAVING count(*) > 1"""))
def dq_budget_double_count(spark, d):
    return budget.double_counted(_tx(spark, d), config.categories(spark))


@query("dq_budget_uncovered", _budget_sql("""
SELECT t.transaction_id, t.account_id, t.amount, t.transaction_date,
  strftime(t.transaction_date, '%Y-%m') AS month
FROM transactions t
WHERE t.deleted_at IS NULL AND t.amount < 0
  AND strftime(t.transaction_date, '%Y-%m') IN (SELECT month FROM categories)
  AND t.transaction_id NOT IN (SELECT transaction_id FROM bm)"""))
def dq_budget_uncovered(spark, d):
    return budget.uncovered_expenses(_tx(spark, d), config.categories(spark))


_CHECKS_SQL = f"""
checks AS (
  SELECT 'orphaned_transactions' AS "check", n FROM (SELECT count(*) AS n FROM transactions t
    WHERE t.deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = t.account_id))
  UNION ALL SELECT 'orphaned_snapshots', n FROM (SELECT count(*) AS n FROM balance_snapshots s
    WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = s.account_id))
  UNION ALL SELECT 'date_sanity', n FROM (SELECT count(*) AS n FROM transactions
    WHERE deleted_at IS NULL AND (transaction_date > DATE '{AS_OF}' + INTERVAL 365 DAY
      OR transaction_date < DATE '1970-01-01'))
  UNION ALL SELECT 'untagged_transactions', n FROM (SELECT count(*) AS n FROM transactions
    WHERE deleted_at IS NULL AND (tags IS NULL OR len(tags) = 0))
  UNION ALL SELECT 'budget_double_counting', n FROM (SELECT count(*) AS n FROM (
    SELECT transaction_id FROM bm GROUP BY transaction_id, month HAVING count(*) > 1))
  UNION ALL SELECT 'uncategorized_expenses', n FROM (SELECT count(*) AS n FROM transactions t
    WHERE t.deleted_at IS NULL AND t.amount < 0
      AND strftime(t.transaction_date, '%Y-%m') IN (SELECT month FROM categories)
      AND t.transaction_id NOT IN (SELECT transaction_id FROM bm))),
checked AS (
  SELECT "check", CASE WHEN n = 0 THEN 'pass'
      WHEN "check" IN ('untagged_transactions', 'budget_double_counting', 'uncategorized_expenses')
      THEN 'warning' ELSE 'error' END AS status, n,
    CASE "check"
      WHEN 'orphaned_transactions' THEN CASE WHEN n = 0 THEN 'No orphaned transactions found'
        ELSE printf('%d transaction(s) reference missing accounts', n) END
      WHEN 'orphaned_snapshots' THEN CASE WHEN n = 0 THEN 'No orphaned snapshots found'
        ELSE printf('%d snapshot(s) reference missing accounts', n) END
      WHEN 'date_sanity' THEN CASE WHEN n = 0 THEN 'All transaction dates are valid'
        ELSE printf('%d transaction(s) have unreasonable dates', n) END
      WHEN 'untagged_transactions' THEN CASE WHEN n = 0 THEN 'All transactions are tagged'
        ELSE printf('%d transaction(s) have no tags', n) END
      WHEN 'budget_double_counting' THEN CASE WHEN n = 0 THEN 'No double-counted transactions found'
        ELSE printf('%d transaction(s) counted in several categories', n) END
      ELSE CASE WHEN n = 0 THEN 'All expenses are categorized in budget'
        ELSE printf('%d expense(s) in no budget category', n) END END AS message
  FROM checks)
"""


def _checks_df(spark, d):
    return quality.all_checks(_tx(spark, d), ledger.balance_snapshots(spark, d), ledger.accounts(spark, d),
                              AS_OF, config.categories(spark))


@query("dq_checks", _budget_sql(", " + _CHECKS_SQL.strip() + "\nSELECT * FROM checked",
                                "balance_snapshots", "accounts"))
def dq_checks(spark, d):
    return _checks_df(spark, d)


@query("dq_summary", _budget_sql(", " + _CHECKS_SQL.strip() + """
SELECT count(*) FILTER (WHERE status = 'pass') AS passed,
  count(*) FILTER (WHERE status = 'warning') AS warnings,
  count(*) FILTER (WHERE status = 'error') AS errors FROM checked""",
                                 "balance_snapshots", "accounts"))
def dq_summary(spark, d):
    return quality.check_summary(_checks_df(spark, d))


@query("status_summary", with_views("""
SELECT (SELECT count(*) FROM accounts) AS total_accounts,
  (SELECT count(*) FROM transactions WHERE deleted_at IS NULL) AS total_transactions,
  (SELECT count(*) FROM balance_snapshots) AS total_snapshots,
  (SELECT min(transaction_date) FROM transactions WHERE deleted_at IS NULL) AS first_transaction_date,
  (SELECT max(transaction_date) FROM transactions WHERE deleted_at IS NULL) AS last_transaction_date
""", "accounts", "transactions", "balance_snapshots"))
def status_summary(spark, d):
    return quality.status_summary(_tx(spark, d), ledger.balance_snapshots(spark, d),
                                  ledger.accounts(spark, d))


# --- event log ----------------------------------------------------------------

_CONTEXT = "concat_ws(', ', command, page, integration)"


@query("logs_recent", with_views(f"""
SELECT id, "timestamp", entry_point, event, {_CONTEXT} AS context, error_message
FROM logs ORDER BY "timestamp" DESC, id DESC LIMIT {RECENT_N}""", "logs"))
def logs_recent(spark, d):
    return logs.recent(ledger.logs(spark, d), RECENT_N)


@query("logs_errors", with_views(f"""
SELECT id, "timestamp", entry_point, event, {_CONTEXT} AS context, error_message
FROM logs WHERE error_message IS NOT NULL ORDER BY "timestamp" DESC, id DESC LIMIT {RECENT_N}
""", "logs"))
def logs_errors(spark, d):
    return logs.recent(ledger.logs(spark, d), RECENT_N, errors_only=True)


@query("logs_stats", with_views("""
SELECT count(*) AS total_entries, count(*) FILTER (WHERE error_message IS NOT NULL) AS error_count,
  min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM logs""", "logs"))
def logs_stats(spark, d):
    return logs.stats(ledger.logs(spark, d))


@query("logs_event_counts", with_views("""
SELECT event, entry_point, count(*) AS n,
  count(*) FILTER (WHERE error_message IS NOT NULL) AS errors FROM logs GROUP BY ALL""", "logs"))
def logs_event_counts(spark, d):
    return logs.event_counts(ledger.logs(spark, d))


@query("logs_retention", with_views(f"""
SELECT id, "timestamp", event FROM logs WHERE "timestamp" >= {LOG_AS_OF_MS - 30 * 86400000}
""", "logs"))
def logs_retention(spark, d):
    return logs.retain(ledger.logs(spark, d), LOG_AS_OF_MS).select("id", "timestamp", "event")


# --- budget -------------------------------------------------------------------

@query("budget_categories", with_views("""
SELECT category_id, month, type, name, expected, array_to_string(tags, '|') AS tags,
  require_all, amount_sign FROM categories""", "categories"))
def budget_categories(spark, d):
    """V5: the categories table as the budget screen reads it."""
    return config.categories(spark).select(
        "category_id", "month", "type", "name", "expected",
        F.array_join("tags", "|").alias("tags"), "require_all", "amount_sign")


@query("budget_match", _budget_sql("SELECT transaction_id, category_id, month FROM bm"))
def budget_match(spark, d):
    return budget.category_matches(_tx(spark, d), config.categories(spark)).select(
        "transaction_id", "category_id", "month")


@query("budget_actuals", _budget_sql("""
SELECT c.category_id, c.month, c.name, c.type, CAST(c.expected AS DECIMAL(18,2)) AS expected,
  CAST(coalesce(a.actual, 0) AS DECIMAL(18,2)) AS actual, coalesce(a.n, 0) AS n_transactions,
  CAST(c.expected - abs(coalesce(a.actual, 0)) AS DECIMAL(18,2)) AS remaining
FROM categories c LEFT JOIN (SELECT category_id, month, sum(amount) AS actual, count(*) AS n
  FROM bm GROUP BY ALL) a USING (category_id, month)"""))
def budget_actuals(spark, d):
    return budget.budget_actuals(_tx(spark, d), config.categories(spark))


@query("budget_rollovers", with_views("""
SELECT category_id, month, CAST(sum(r_in) AS DECIMAL(18,2)) AS rollover_in,
  CAST(sum(r_out) AS DECIMAL(18,2)) AS rollover_out FROM (
  SELECT from_category AS category_id, source_month AS month, 0 AS r_in, amount AS r_out FROM rollovers
  UNION ALL SELECT to_category, to_month, amount, 0 FROM rollovers) GROUP BY ALL""", "rollovers"))
def budget_rollovers(spark, d):
    """B3 over the configured rollovers (a budget parameter table)."""
    return budget.budget_rollovers(config.rollovers(spark))


@query("net_worth", with_views("""
SELECT classification, CAST(sum(balance) AS DECIMAL(18,2)) AS total, count(*) AS n_accounts FROM (
  SELECT coalesce(o.classification_override, a.classification,
      CASE WHEN lower(coalesce(a.account_type, '')) IN ('credit', 'loan') THEN 'liability'
           ELSE 'asset' END) AS classification, l.balance
  FROM accounts a LEFT JOIN overrides o USING (account_id)
  JOIN (SELECT account_id, balance FROM (SELECT *, row_number() OVER (PARTITION BY account_id
          ORDER BY snapshot_time DESC, created_at DESC, snapshot_id DESC) AS rn
        FROM balance_snapshots) WHERE rn = 1) l USING (account_id)
  WHERE NOT coalesce(o.exclude_from_net_worth, false)) GROUP BY classification
""", "accounts", "overrides", "balance_snapshots"))
def net_worth(spark, d):
    return budget.net_worth(ledger.accounts(spark, d), ledger.balance_snapshots(spark, d),
                            config.overrides(spark))


# --- tagging ------------------------------------------------------------------

def _rules_sql_fold() -> str:
    """The auto-tag fold written as nested DuckDB selects (oracle only)."""
    sql = "SELECT transaction_id, account_id, amount, description, account_type, source, " \
          "coalesce(tags, CAST([] AS VARCHAR[])) AS tags, " \
          "len(coalesce(tags, CAST([] AS VARCHAR[]))) AS n0 FROM tx_view"
    for rid, _name, cond, tags, enabled, _order in sorted(config.RULE_ROWS, key=lambda r: r[5]):
        if not enabled or not tags or rid in config.BROKEN_RULES:
            continue
        arr = "[" + ", ".join(f"'{t}'" for t in tags) + "]"
        sql = (f"SELECT * REPLACE (CASE WHEN coalesce(({cond}), false) THEN tags || "
               f"list_filter({arr}, lambda x: NOT list_contains(tags, x)) ELSE tags END AS tags) "
               f"FROM ({sql}) q_{rid}")
    return sql


@query("rules_enabled", with_views("""
SELECT rule_id, name, sort_order, array_to_string(tags, '|') AS tags FROM rules WHERE enabled
""", "rules"))
def rules_enabled(spark, d):
    return tagging.enabled_rules(config.rules(spark)).select(
        "rule_id", "name", "sort_order", F.array_join("tags", "|").alias("tags"))


@query("auto_tag", with_views(f"""
SELECT transaction_id, array_to_string(tags, '|') AS tags, len(tags) > n0 AS tags_auto_applied
FROM ({_rules_sql_fold()}) f""", "tx_view"))
def auto_tag(spark, d):
    view = views.transactions_view(_tx(spark, d), ledger.accounts(spark, d))
    rules = tagging.load_rules(config.rules(spark))
    return tagging.apply_rules(view, rules).select(
        "transaction_id", F.array_join("tags", "|").alias("tags"), "tags_auto_applied")


def _rule_stats_sql() -> str:
    """Per-rule counters of the fold, in DuckDB text (oracle only): each level
    flags its matches on the tags as they stand before the rule."""
    sql = ("SELECT transaction_id, account_id, amount, description, account_type, source, "
           "coalesce(tags, CAST([] AS VARCHAR[])) AS tags FROM tx_view")
    valid, invalid = [], []
    for rid, _name, cond, tags, enabled, order in sorted(config.RULE_ROWS, key=lambda r: r[5]):
        if not enabled:
            continue
        if rid in config.BROKEN_RULES:
            invalid.append((rid, order))
            continue
        valid.append((rid, order))
        arr = "CAST([" + ", ".join(f"'{t}'" for t in tags) + "] AS VARCHAR[])"
        missing = f"list_filter({arr}, lambda x: NOT list_contains(tags, x))"
        sql = (f"SELECT * REPLACE (CASE WHEN m_{rid} THEN tags || {missing} ELSE tags END AS tags) "
               f"FROM (SELECT *, coalesce(({cond}), false) AS m_{rid}, "
               f"coalesce(({cond}), false) AND len({missing}) > 0 AS a_{rid} FROM ({sql}) p_{rid}) q_{rid}")
    parts = [f"SELECT '{rid}' AS rule_id, {order} AS sort_order, true AS valid, "
             f"count(*) FILTER (WHERE m_{rid}) AS matched, count(*) FILTER (WHERE a_{rid}) AS tagged "
             f"FROM folded" for rid, order in valid]
    parts += [f"SELECT '{rid}', {order}, false, CAST(0 AS BIGINT), CAST(0 AS BIGINT)"
              for rid, order in invalid]
    return with_views_ctes(f"folded AS ({sql})", "\nUNION ALL\n".join(parts), "tx_view")


@query("auto_tag_stats", _rule_stats_sql())
def auto_tag_stats(spark, d):
    """Per rule matched / tagged counts; the broken rule is reported
    invalid (also checked against a brute-force loop in tests/)."""
    view = views.transactions_view(_tx(spark, d), ledger.accounts(spark, d))
    return tagging.rule_stats(view, tagging.load_rules(config.rules(spark)))


@query("tag_apply", with_views_ctes(f"""
req AS (SELECT DISTINCT trim(transaction_id) AS transaction_id FROM (
    SELECT transaction_id FROM transactions WHERE transaction_date = DATE '{TAG_DAY}'
    UNION ALL SELECT * FROM (VALUES (''), ('missing-1')) v(transaction_id)))""", """
SELECT r.transaction_id, CASE WHEN r.transaction_id = '' THEN 'invalid'
    WHEN t.transaction_id IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
  array_to_string(CASE WHEN t.transaction_id IS NULL THEN NULL
    WHEN list_contains(coalesce(t.tags, []), 'reviewed') THEN coalesce(t.tags, [])
    ELSE coalesce(t.tags, []) || ['reviewed'] END, '|') AS tags
FROM req r LEFT JOIN transactions t ON r.transaction_id = t.transaction_id""", "transactions"))
def tag_apply(spark, d):
    tx = _tx(spark, d)
    req = tx.where(F.col("transaction_date") == F.lit(TAG_DAY).cast("date")) \
        .select("transaction_id") \
        .unionByName(spark.createDataFrame([(i,) for i in TAG_EXTRA_IDS], "transaction_id string"))
    updated, status = tagging.tag_apply(tx, req, ["reviewed"])
    return (status.join(updated.select("transaction_id", "tags"), "transaction_id", "left")
            .select("transaction_id", "status", F.array_join("tags", "|").alias("tags")))


@query("norm_tags", with_views("""
SELECT transaction_id, array_to_string(list_filter(list_transform(l, lambda x: trim(x)),
  lambda x, i: x <> '' AND list_position(list_transform(l, lambda y: trim(y)), x) = i), '|') AS tags
FROM (SELECT transaction_id, coalesce(tags, CAST([] AS VARCHAR[])) || [' extra ', '', '  open']
        || coalesce(tags, CAST([] AS VARCHAR[])) AS l FROM transactions)""", "transactions"))
def norm_tags_q(spark, d):
    from ..functions.text import norm_tags
    t = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return _tx(spark, d).select(
        "transaction_id",
        F.array_join(norm_tags(F.concat(t, F.array(F.lit(" extra "), F.lit(""), F.lit("  open")), t)),
                     "|").alias("tags"))


MATCH_RANGE = ("1996-06-01", "1996-06-30")


def _rules_match_sql() -> str:
    parts = []
    for rid, _name, cond, _tags, enabled, _order in config.RULE_ROWS:
        if not enabled or rid in config.BROKEN_RULES:
            continue
        parts.append(f"SELECT transaction_id, '{rid}' AS rule_id FROM ids WHERE coalesce(({cond}), false)")
    body = "\nUNION ALL\n".join(parts)
    return with_views_ctes(f"""ids AS (SELECT * FROM tx_view
  WHERE transaction_date BETWEEN DATE '{MATCH_RANGE[0]}' AND DATE '{MATCH_RANGE[1]}')""", body, "tx_view")


@query("rules_match", _rules_match_sql())
def rules_match(spark, d):
    """Which enabled rules match which of a set of transactions."""
    tx = _tx(spark, d)
    view = views.transactions_view(tx, ledger.accounts(spark, d))
    ids = views.transactions_in_range(tx, *MATCH_RANGE).select("transaction_id")
    return tagging.rules_match(view, ids, tagging.load_rules(config.rules(spark)))


@query("dq_uncategorized", with_views("""
SELECT count(*) AS uncategorized_expenses FROM transactions
WHERE deleted_at IS NULL AND amount < 0 AND (tags IS NULL OR len(tags) = 0)""", "transactions"))
def dq_uncategorized(spark, d):
    """A10: expenses without tags."""
    return quality.untagged_stats(_tx(spark, d)).select("uncategorized_expenses")
