"""Registered queries: SQL over the ledger views, result encodings, sinks,
extension sessions, and the two streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import ledger
from ..sources.tables import table
from ..streaming import jobs
from . import sql
from .oracle_views import with_views
from .registry import query

# User SQL, written once; the oracle runs the same text with the enriched
# view under its oracle name.
SQL_CTE = """
WITH totals AS (SELECT account_id, count(*) AS n, sum(amount) AS total FROM {tx} GROUP BY account_id)
SELECT a.account_id, a.name, t.n, CAST(t.total AS DECIMAL(18,2)) AS total
FROM accounts a JOIN totals t ON a.account_id = t.account_id"""
SQL_IN = """
SELECT transaction_id, account_id, amount FROM {tx}
WHERE account_id IN (SELECT account_id FROM accounts WHERE account_type = 'credit') AND amount > 400000"""
SQL_HAVING = """
SELECT account_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total
FROM {tx} GROUP BY account_id HAVING count(*) > 12"""
SQL_PARAMS = """
SELECT transaction_id, amount, source FROM {tx}
WHERE transaction_date BETWEEN {p1} AND {p2} AND source = {p3}"""
PARAMS = ["1997-01-01", "1997-06-30", "csv_import"]
EXT_SQL = "SELECT source, count(*) AS n FROM {tx} GROUP BY source"


def _spark_sql(spark, d, text, args=None):
    sql.register_views(spark, d)
    return sql.run_readonly(spark, text, args)


@query("sql_cte", with_views("SELECT * FROM (" + SQL_CTE.format(tx="tx_view") + ") q", "tx_view"))
def sql_cte(spark, d):
    """Q6: CTE + join over the registered views."""
    return _spark_sql(spark, d, SQL_CTE.format(tx="transactions"))


@query("sql_in_subquery", with_views(SQL_IN.format(tx="tx_view"), "tx_view"))
def sql_in_subquery(spark, d):
    """Q6: IN-subquery (planned as a semi join)."""
    return _spark_sql(spark, d, SQL_IN.format(tx="transactions"))


@query("sql_group_having", with_views(SQL_HAVING.format(tx="tx_view"), "tx_view"))
def sql_group_having(spark, d):
    """Q1/Q6: guarded read-only GROUP BY + HAVING."""
    return _spark_sql(spark, d, SQL_HAVING.format(tx="transactions"))


@query("sql_params", with_views(SQL_PARAMS.format(
    tx="tx_view", p1=f"DATE '{PARAMS[0]}'", p2=f"DATE '{PARAMS[1]}'", p3=f"'{PARAMS[2]}'"), "tx_view"))
def sql_params(spark, d):
    """Q3: positional parameters bound by Spark, not spliced into the text."""
    text = SQL_PARAMS.format(tx="transactions", p1="CAST(? AS DATE)", p2="CAST(? AS DATE)", p3="?")
    return _spark_sql(spark, d, text, PARAMS)


@query("result_json", with_views("""
SELECT account_id, to_json(struct_pack(account_id := account_id, name := name,
  account_type := account_type, nickname := nickname)) AS json FROM accounts""", "accounts"))
def result_json(spark, d):
    """Q4: rows encoded as JSON objects, null fields kept."""
    acc = ledger.accounts(spark, d).select("account_id", "name", "account_type", "nickname")
    return acc.select("account_id", sql.json_column(acc).alias("json"))


@query("result_csv", with_views("""
SELECT transaction_id, account_id, amount, description, transaction_date
FROM transactions WHERE deleted_at IS NULL""", "transactions"))
def result_csv(spark, d):
    """Q5: the CSV sink written to the shared scratch folder and read back."""
    from ..operators.views import active
    df = active(ledger.transactions(spark, d)).select(
        "transaction_id", "account_id", "amount", "description", "transaction_date")
    path = scratch_path(spark, "result-csv")
    sql.write_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)


@query("ext_read_allowlist", with_views(EXT_SQL.format(tx="tx_view"), "tx_view"))
def ext_read_allowlist(spark, d):
    """Q7: an extension session that sees only transactions and accounts."""
    ext = sql.extension_session(spark, d, ["transactions", "accounts"])
    return ext.query(EXT_SQL.format(tx="transactions"))


# --- streaming ---------------------------------------------------------------

@query("stream_dedup", with_views("""
SELECT DISTINCT pid AS provider_id FROM (
  SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN 'ev-' || CAST(event_id AS VARCHAR)
    ELSE 'ev-' || CAST(user_id AS VARCHAR) || '-' || event_type || '-' || strftime(ts, '%Y%m%d') END AS pid
  FROM events) WHERE pid NOT IN (SELECT transaction_id FROM transactions)""", "transactions"))
def stream_dedup(spark, d):
    """Structured Streaming: each batch against the ledger and the earlier batches."""
    return jobs.stream_dedup(spark, d, ledger.transactions(spark, d)).select("provider_id")


@query("stream_log_counts", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_log_counts(spark, d):
    """Structured Streaming: tumbling one-day counts per event type."""
    return jobs.stream_log_counts(spark, d)


# --- writes, types and the catalog -------------------------------------------------

SQL_UPDATE = """
UPDATE transactions t SET amount = amount * 2, description = concat('checked ', description)
WHERE account_id IN (SELECT account_id FROM accounts WHERE account_type = 'credit') AND t.amount < 0"""
SQL_DELETE = """
DELETE FROM transactions WHERE transaction_date < DATE '1996-01-01'
  AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = transactions.account_id)"""
SQL_INSERT = """
INSERT INTO transactions (account_id, transaction_id, amount, transaction_date)
SELECT account_id, concat('fee-', account_id), -1.5, DATE '2001-07-31' FROM accounts WHERE account_type = 'loan'"""


def _write(spark, d, text):
    sql.register_views(spark, d, ["accounts"])
    return sql.run_readwrite(spark, text, {"transactions": ledger.transactions(spark, d)})


_CREDIT = "account_id IN (SELECT account_id FROM accounts WHERE account_type = 'credit') AND amount < 0"


@query("sql_update", with_views(f"""
SELECT transaction_id, account_id, transaction_date,
  CAST(CASE WHEN {_CREDIT} THEN amount * 2 ELSE amount END AS DECIMAL(15,2)) AS amount,
  CASE WHEN {_CREDIT} THEN 'checked ' || description ELSE description END AS description FROM transactions""", "transactions", "accounts"))
def sql_update(spark, d):
    """Q2: UPDATE with a subquery, as the next version of the table."""
    return _write(spark, d, SQL_UPDATE).rows.select("transaction_id", "account_id", "transaction_date", "amount", "description")


_GONE = "transaction_date < DATE '1996-01-01' AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = t.account_id)"


@query("sql_delete", with_views(f"SELECT transaction_id, amount FROM transactions t WHERE NOT ({_GONE})", "transactions", "accounts"))
def sql_delete(spark, d):
    """Q2: DELETE with a correlated subquery."""
    return _write(spark, d, SQL_DELETE).rows.select("transaction_id", "amount")


@query("sql_insert", with_views("""
SELECT transaction_id, account_id, amount, description, transaction_date FROM transactions
UNION ALL SELECT 'fee-' || account_id, account_id, CAST(-1.5 AS DECIMAL(15,2)), NULL, DATE '2001-07-31'
FROM accounts WHERE account_type = 'loan'""", "transactions", "accounts"))
def sql_insert(spark, d):
    """Q2: INSERT of a query's rows by named columns."""
    return _write(spark, d, SQL_INSERT).rows.select("transaction_id", "account_id", "amount", "description", "transaction_date")


@query("sql_affected_rows", with_views(f"""
SELECT 'update' AS kind, count(*) AS affected_rows FROM transactions WHERE {_CREDIT}
UNION ALL SELECT 'delete', count(*) FROM transactions t WHERE {_GONE}
UNION ALL SELECT 'insert', count(*) FROM accounts WHERE account_type = 'loan'""", "transactions", "accounts"))
def sql_affected_rows(spark, d):
    """Q2: what each write reports."""
    kinds = {"update": SQL_UPDATE, "delete": SQL_DELETE, "insert": SQL_INSERT}
    found = [_write(spark, d, text).affected.select(F.lit(kind).alias("kind"), "affected_rows") for kind, text in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("result_types", """
SELECT event_id, '{"id":' || event_id || ',"wide":"' || CAST(CAST(event_id AS HUGEINT) + 123450000000000000000000::HUGEINT AS VARCHAR) || '"'
  || ',"price":' || CAST(floor(value) + 0.5 AS VARCHAR) || ',"day":"' || strftime(ts, '%Y-%m-%d') || '"'
  || ',"at":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00"'
  || ',"exact":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
     WHEN microsecond(ts) % 1000 = 0 THEN '.' || lpad(CAST(microsecond(ts) % 1000000 // 1000 AS VARCHAR), 3, '0')
     ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00"'
  || ',"blob":"<blob ' || strlen(event_type) || ' bytes>"'
  || ',"list":["' || event_type || '",null],"nested":{"days":["' || strftime(ts, '%Y-%m-%d') || '"],"none":null}'
  || ',"map":{"' || user_id || '":"<blob 1 bytes>"},"age":{"months":' || user_id % 30 || ',"days":0,"nanos":0}'
  || ',"span":{"months":0,"days":' || event_id % 9 || ',"nanos":' || user_id % 50 * 1000000000 || '}'
  || ',"nan":null,"flag":' || CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END || '}' AS json FROM events""")
def result_types(spark, d):
    """Q4: values of all types as JSON."""
    rows = table(spark, d, "events").select(
        "event_id", F.col("event_id").alias("id"), (F.col("event_id").cast("decimal(17,0)") + F.expr("123450000000000000000000BD")).cast("decimal(38,0)").alias("wide"),
        (F.floor("value") + F.expr("0.5BD")).cast("decimal(15,1)").alias("price"), F.col("ts").cast("date").alias("day"),
        F.date_trunc("second", "ts").cast("timestamp").alias("at"), F.col("ts").alias("exact"), F.col("event_type").cast("binary").alias("blob"),
        F.array("event_type", F.lit(None)).alias("list"),
        F.struct(F.array(F.col("ts").cast("date")).alias("days"), F.lit(None).alias("none")).alias("nested"),
        F.create_map("user_id", F.lit("x").cast("binary")).alias("map"),
        F.make_ym_interval(F.lit(0), (F.col("user_id") % 30).cast("int")).alias("age"),
        F.make_dt_interval((F.col("event_id") % 9).cast("int"), F.lit(0), F.lit(0), (F.col("user_id") % 50).cast("decimal(18,6)")).alias("span"),
        F.lit(float("nan")).alias("nan"), (F.col("event_type") == "error").alias("flag"))
    columns = [c for c in rows.columns if c != "event_id"]
    return rows.select("event_id", sql.json_column(rows, columns).alias("json"))


@query("sql_param_values", with_views(f"""
SELECT transaction_id FROM tx_view WHERE source = 'csv_import' AND amount < -200000.5
  AND transaction_date >= DATE '{PARAMS[0]}'""", "tx_view"))
def sql_param_values(spark, d):
    """Q3: lists come joined by commas, objects as JSON text, numbers as numbers."""
    return _spark_sql(spark, d, "SELECT transaction_id FROM transactions WHERE array_contains(split(?, ','), source) AND amount < ? "
                      "AND transaction_date >= CAST(get_json_object(?, '$.from') AS DATE)",
                      [["csv_import", "none"], -200000.5, {"from": PARAMS[0]}])


@query("table_exists", with_views("""
SELECT 'accounts' AS name, true AS found, (SELECT count(*) FROM accounts) AS n_rows
UNION ALL SELECT 'transactions', true, (SELECT count(*) FROM tx_view) UNION ALL SELECT 'balance_snapshots', false, NULL
UNION ALL SELECT 'no_such_table', false, NULL""", "accounts", "tx_view"))
def table_exists(spark, d):
    """Q8: which names a session that was allowed two views can read, and how many rows they have."""
    session = spark.newSession()
    sql.register_views(session, d, ["accounts", "transactions"])
    found = None
    for name in ["accounts", "transactions", "balance_snapshots", "no_such_table"]:
        there = sql.table_exists(session, name)
        rows = (session.table(name).agg(F.count("*").alias("n_rows")) if there else session.range(1).select(F.lit(None).cast("long").alias("n_rows")))
        row = rows.select(F.lit(name).alias("name"), F.lit(there).alias("found"), "n_rows")
        found = row if found is None else found.unionByName(row)
    return found
