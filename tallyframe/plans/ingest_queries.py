"""Registered queries: statement ingest and the scalar parsers over data.

The statement fixture renders lineitem as CSV lines (sources/statements.py);
the oracle does not parse any text: it computes the expected typed rows straight
from lineitem, so every key here is a round trip through the parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, dates, text
from ..session import kept, materialize, scratch_path
from ..sources import ledger, statements
from .oracle_views import sql_fingerprint, sql_norm_description, with_views_ctes
from .registry import query

PRIOR_LAST_YEAR = 1997              # files up to this year were imported once before
PRIOR_BATCH = "import_19980101_000000"
BATCH = "import_20010801_000000"


# --------------------------------------------------------------------------- Spark side

def _file_year():
    return F.substring_index(F.col("file_id"), "-", -1).cast("int")


def _stmt(spark, d):
    """(lines, manifest of files whose account exists) - I1 rejects the rest.

    The rendered lines stand for landed statement files; every query renders and
    parses them itself."""
    lines, man = statements.fixture_lines(spark, d)
    return lines, materialize(man.join(ledger.accounts(spark, d).select("account_id"), "account_id", "left_semi"))


def _rows(spark, d, shared: bool = False):
    """Typed statement rows; ``shared`` writes them once (as columns) for
    queries that read them several times."""
    lines, man = _stmt(spark, d)
    rows = statements.parse_rows(lines, man)
    return kept(rows) if shared else rows


def _existing(spark, d, rows):
    """The ledger before this import: the ledger's own rows plus the earlier
    import of the files up to PRIOR_LAST_YEAR."""
    tx = ledger.transactions(spark, d)
    prior = statements.new_rows(rows.where(_file_year() <= PRIOR_LAST_YEAR), tx)
    prior_tx = statements.to_transactions(prior, PRIOR_BATCH)
    return tx.select("csv_fingerprint").unionByName(prior_tx.select("csv_fingerprint")), prior


def _existing_snapshots(spark, d, rows):
    snaps = ledger.balance_snapshots(spark, d)
    prior = statements.end_of_day_snapshots(rows.where(_file_year() <= PRIOR_LAST_YEAR), snaps)
    return snaps.select("account_id", "snapshot_time", "balance").unionByName(
        prior.select("account_id", "snapshot_time", "balance"))


# --------------------------------------------------------------------------- oracle side

_EXPECTED = """
files AS (SELECT s_suppkey, s_acctbal,
    CASE WHEN s_nationkey < 9 THEN 'us' WHEN s_nationkey < 17 THEN 'eu' ELSE 'eu_space' END AS fmt,
    s_nationkey = 3 AS flip FROM supplier
  WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT account_id FROM accounts)),
li AS (SELECT l.*, f.fmt, f.s_acctbal, 'stmt-' || CAST(l.l_suppkey AS VARCHAR) || '-'
    || CAST(year(l.l_shipdate) AS VARCHAR) AS file_id, year(l.l_shipdate) AS yr,
    date_diff('day', DATE '1990-01-01', CAST(l.l_shipdate AS DATE)) * 10000000000000
      + l.l_orderkey * 8 + l.l_linenumber + 1
      + CASE f.fmt WHEN 'us' THEN 0 WHEN 'eu' THEN 1 ELSE 2 END AS pos,
    CAST(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice ELSE -l.l_extendedprice END
      AS DECIMAL(15,2)) AS base
  FROM lineitem l JOIN files f ON l.l_suppkey = f.s_suppkey),
ex0 AS (SELECT file_id, pos, yr, fmt, CAST(l_suppkey AS VARCHAR) AS account_id,
    CAST(s_acctbal AS DECIMAL(15,2)) AS anchor_balance, make_date(yr, 6, 30) AS anchor_date,
    CASE WHEN fmt = 'us' AND l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END
      AS transaction_date,
    CASE WHEN fmt IN ('eu', 'eu_space') AND l_linenumber = 7 THEN NULL ELSE base END AS amount,
    CASE fmt WHEN 'us' THEN 'SHIP ' || l_returnflag || l_linestatus || ', ORDER '
        || CAST(l_orderkey AS VARCHAR)
      WHEN 'eu' THEN 'Lieferung ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)
      ELSE 'Faktura ' || CAST(l_partkey AS VARCHAR) || ' nr ' || CAST(l_orderkey AS VARCHAR) END
      AS description,
    CASE WHEN fmt = 'eu_space' THEN CAST(l_quantity AS DECIMAL(15,2)) * 100
      + CAST(l_extendedprice AS DECIMAL(15,2)) END AS balance
  FROM li WHERE NOT (l_linenumber = 6 AND l_returnflag = 'N')),
ex1 AS (SELECT *, CASE WHEN transaction_date IS NULL THEN 'bad_date'
    WHEN amount IS NULL THEN 'bad_amount' ELSE 'ok' END AS status FROM ex0),
ex AS (SELECT *, CASE WHEN status = 'ok' THEN {fp} END AS fingerprint FROM ex1),
prior_fp AS (SELECT fingerprint FROM ex WHERE status = 'ok' AND yr <= {prior}
  UNION ALL SELECT csv_fingerprint FROM transactions WHERE csv_fingerprint IS NOT NULL),
newrows AS (SELECT * FROM ex WHERE status = 'ok' AND fingerprint NOT IN (SELECT fingerprint FROM prior_fp)),
eod AS (SELECT file_id, yr, account_id, transaction_date AS day, arg_max(balance, pos) AS balance
  FROM ex WHERE status = 'ok' AND balance IS NOT NULL GROUP BY ALL),
eod_new AS (SELECT e.* FROM eod e WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT account_id, CAST(snapshot_time AS DATE) AS day, balance FROM balance_snapshots
                   UNION ALL SELECT account_id, day, balance FROM eod WHERE yr <= {prior}) s
    WHERE s.account_id = e.account_id AND s.day = e.day AND abs(s.balance - e.balance) < 0.01))
""".format(fp=sql_fingerprint("account_id", "transaction_date", "amount", "description"),
           prior=PRIOR_LAST_YEAR)


def _stmt_sql(body: str) -> str:
    return with_views_ctes(_EXPECTED, body, "accounts", "transactions", "balance_snapshots")


# --------------------------------------------------------------------------- queries

@query("stmt_headers", _stmt_sql("""
SELECT DISTINCT file_id, CASE fmt WHEN 'us' THEN ',' WHEN 'eu' THEN ';' ELSE chr(9) END AS delimiter,
  CASE fmt WHEN 'us' THEN 'Date|Description|Amount' WHEN 'eu' THEN 'Buchungstag|Verwendungszweck|Debit|Credit'
    ELSE 'Posted Date|Memo|Amt|Balance' END AS header,
  CASE fmt WHEN 'us' THEN 3 ELSE 4 END AS width FROM li"""))
def stmt_headers(spark, d):
    """Skip N lines, find the header, detect the delimiter, clean names."""
    lines, man = _stmt(spark, d)
    return statements.headers(lines, man).select(
        "file_id", "delimiter", F.array_join("header", "|").alias("header"), "width")


@query("stmt_detect_columns", _stmt_sql("""
SELECT DISTINCT file_id,
  CASE fmt WHEN 'us' THEN 'Date' WHEN 'eu_space' THEN 'Posted Date' END AS date,
  CASE fmt WHEN 'us' THEN 'Amount' WHEN 'eu_space' THEN 'Amt' END AS amount,
  CASE fmt WHEN 'eu' THEN 'Debit' END AS debit,
  CASE fmt WHEN 'eu' THEN 'Credit' END AS credit,
  CASE fmt WHEN 'us' THEN 'Description' WHEN 'eu_space' THEN 'Memo' END AS description FROM li"""))
def stmt_detect_columns(spark, d):
    """I7 on every file's header."""
    lines, man = _stmt(spark, d)
    return statements.detect_columns(statements.headers(lines, man))


@query("stmt_ragged", _stmt_sql("""
SELECT file_id, count(*) AS ragged FROM li WHERE l_linenumber = 6 AND l_returnflag = 'N'
GROUP BY file_id"""))
def stmt_ragged(spark, d):
    """Records whose field count differs from the header's."""
    lines, man = _stmt(spark, d)
    return statements.ragged_counts(lines, man)


@query("stmt_rows", _stmt_sql("""
SELECT file_id, pos, account_id, transaction_date, amount, description,
  CAST(balance AS DECIMAL(15,2)) AS balance, status, fingerprint FROM ex"""))
def stmt_rows(spark, d):
    """Every data line typed, with its status."""
    return _rows(spark, d).select("file_id", "pos", "account_id", "transaction_date", "amount",
                                  "description", "balance", "status", "fingerprint")


@query("dedup_fingerprint", _stmt_sql("""
SELECT file_id, pos, fingerprint FROM ex
WHERE status = 'ok' AND fingerprint IN (SELECT fingerprint FROM prior_fp)"""))
def dedup_fingerprint(spark, d):
    """Rows of this import already in the ledger by fingerprint."""
    rows = _rows(spark, d, shared=True)
    existing, _ = _existing(spark, d, rows)
    fps = statements.known_fingerprints(rows, existing)
    return (rows.where(F.col("status") == "ok").join(fps, "fingerprint", "left_semi")
            .select("file_id", "pos", "fingerprint"))


@query("stmt_ingest", _stmt_sql(f"""
SELECT substr(sha256(file_id || '|' || CAST(pos AS VARCHAR) || '|{BATCH}'), 1, 32) AS transaction_id,
  account_id, amount, description, transaction_date, fingerprint AS csv_fingerprint,
  '{BATCH}' AS csv_batch_id FROM newrows"""))
def stmt_ingest(spark, d):
    """The ledger rows this import appends (after J7)."""
    rows = _rows(spark, d, shared=True)
    existing, _ = _existing(spark, d, rows)
    new = statements.new_rows(rows, existing)
    return statements.to_transactions(new, BATCH).select(
        "transaction_id", "account_id", "amount", "description", "transaction_date",
        "csv_fingerprint", "csv_batch_id")


@query("stmt_eod_snapshots", _stmt_sql("""
SELECT file_id, account_id, day, CAST(balance AS DECIMAL(15,2)) AS balance,
  CAST(day AS TIMESTAMP) + to_microseconds(86399999999) AS snapshot_time FROM eod_new"""))
def stmt_eod_snapshots(spark, d):
    """A8 + N14 + J9: end-of-day snapshots from the balance column."""
    rows = _rows(spark, d, shared=True)
    snaps = _existing_snapshots(spark, d, rows)
    return statements.end_of_day_snapshots(rows, snaps).select(
        "file_id", "account_id", "day", "balance", "snapshot_time")


@query("stmt_files", _stmt_sql("""
SELECT file_id, transaction_date, amount, description, CAST(balance AS DECIMAL(15,2)) AS balance, status FROM ex"""))
def stmt_files(spark, d):
    """I1, I2, I5 over files: the statements written as files (line ends LF, CR LF or CR, some with a byte
    order mark) and read by the file reader."""
    lines, man = _stmt(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    kind = F.pmod(F.hash("file_id"), F.lit(4))
    end = F.when(kind == 0, "\r").when(kind == 1, "\r\n").otherwise("\n")
    files = lines.groupBy("file_id").agg(text.alias("value")).select("file_id", F.concat(
        F.when(kind >= 2, "").otherwise("\ufeff"), F.replace(F.col("value"), F.lit("\n"), end)).alias("value"))
    path = scratch_path(spark, "statements")
    # each task moves its own files into place: a job that ends by moving them all does it one by one in the driver
    files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file_id").text(path)
    read = statements.read_statement_files(spark, path, "file_id")
    return statements.parse_rows(read, man).select("file_id", "transaction_date", "amount", "description", "balance", "status")


@query("stmt_counts", _stmt_sql("""
SELECT e.file_id, count(*) FILTER (WHERE status = 'ok') AS discovered,
  coalesce(max(n.imported), 0) AS imported,
  count(*) FILTER (WHERE status <> 'ok') + count(*) FILTER (WHERE status = 'ok')
    - coalesce(max(n.imported), 0) AS skipped,
  count(*) FILTER (WHERE status = 'ok') AS fingerprints_checked,
  coalesce(max(s.created), 0) AS snapshots_created
FROM ex e
LEFT JOIN (SELECT file_id, count(*) AS imported FROM newrows GROUP BY file_id) n USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS created FROM eod_new GROUP BY file_id) s USING (file_id)
GROUP BY e.file_id"""))
def stmt_counts(spark, d):
    """I8: per-file counters of one import."""
    rows = _rows(spark, d, shared=True)
    existing, _ = _existing(spark, d, rows)
    new = statements.new_rows(rows, existing)
    snaps = statements.end_of_day_snapshots(rows, _existing_snapshots(spark, d, rows)) \
        .groupBy("file_id").agg(F.count(F.lit(1)).alias("snapshots_created"))
    return statements.import_counts(rows, new, snaps)


@query("stmt_running_balance", _stmt_sql("""
, elig AS (SELECT * FROM ex WHERE status = 'ok' AND file_id NOT IN (
    SELECT file_id FROM ex WHERE status = 'ok' AND balance IS NOT NULL))
SELECT file_id, pos, transaction_date, amount,
  CASE WHEN transaction_date <= anchor_date THEN CAST(anchor_balance - coalesce(sum(CASE
      WHEN transaction_date <= anchor_date THEN amount END) OVER (PARTITION BY file_id
      ORDER BY transaction_date DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS DECIMAL(18,2)) END AS running_balance
FROM elig""".lstrip()))
def stmt_running_balance(spark, d):
    """Per-row running balance from the anchor (files without balances)."""
    return statements.running_balance(_rows(spark, d))


@query("stmt_preview", _stmt_sql("""
, elig AS (SELECT * FROM ex WHERE status = 'ok' AND file_id NOT IN (
    SELECT file_id FROM ex WHERE status = 'ok' AND balance IS NOT NULL)),
rb AS (SELECT file_id, pos, CASE WHEN transaction_date <= anchor_date THEN CAST(anchor_balance
    - coalesce(sum(CASE WHEN transaction_date <= anchor_date THEN amount END) OVER (
      PARTITION BY file_id ORDER BY transaction_date DESC, pos DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) END AS running_balance
  FROM elig)
SELECT e.file_id, e.pos, e.transaction_date, e.amount,
  row_number() OVER (PARTITION BY e.file_id ORDER BY e.transaction_date DESC, e.pos DESC) AS preview_rank,
  coalesce(CAST(e.balance AS DECIMAL(18,2)), rb.running_balance) AS balance
FROM ex e LEFT JOIN rb USING (file_id, pos) WHERE e.status = 'ok'""".lstrip()))
def stmt_preview(spark, d):
    """I1 preview / O3: rows newest day first, with the balance shown for each."""
    return statements.preview(_rows(spark, d)).select(
        "file_id", "pos", "transaction_date", "amount", "preview_rank", "balance")


@query("stmt_rejected_files", _stmt_sql("""
SELECT DISTINCT 'stmt-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS file_id,
  CAST(l_suppkey AS VARCHAR) AS account_id, 'account not found' AS reason
FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) NOT IN (SELECT account_id FROM accounts)"""))
def stmt_rejected_files(spark, d):
    """Files whose account does not exist are not imported; reported."""
    _, man = statements.fixture_lines(spark, d)
    return (man.join(ledger.accounts(spark, d).select("account_id"), "account_id", "left_anti")
            .select("file_id", "account_id", F.lit("account not found").alias("reason")))


# --- scalar parsers over data -------------------------------------------------

@query("parse_amount", """
SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(15,2)) AS us,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(15,2)) AS eu,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(15,2)) AS eu_space,
  CAST(-l_extendedprice AS DECIMAL(15,2)) AS paren,
  CAST(NULL AS DECIMAL(15,2)) AS junk
FROM lineitem""")
def parse_amount_q(spark, d):
    """N5-N7 on every lineitem price rendered in each locale, with a
    currency suffix, in parentheses, and as junk text."""
    from ..sources.tables import table
    li = table(spark, d, "lineitem")
    base = (F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
            .otherwise(-F.col("l_extendedprice"))).cast("decimal(15,2)")
    us = F.format_number(base, 2)
    eu = F.translate(us, ",.", ".,")
    eus = F.concat(F.translate(us, ",.", " ,"), F.lit(" PLN"))
    paren = F.concat(F.lit("("), F.format_number(F.col("l_extendedprice").cast("decimal(15,2)"), 2),
                     F.lit(") USD"))
    junk = F.concat(F.lit("1-"), F.col("l_linenumber").cast("string"))
    return li.select(
        "l_orderkey", "l_linenumber",
        amounts.parse_amount(us, "us").cast("decimal(15,2)").alias("us"),
        amounts.parse_amount(eu, "eu").cast("decimal(15,2)").alias("eu"),
        amounts.parse_amount(eus, "eu_space").cast("decimal(15,2)").alias("eu_space"),
        amounts.parse_amount(paren, "us").cast("decimal(15,2)").alias("paren"),
        amounts.parse_amount(junk, "us").cast("decimal(15,2)").alias("junk"))


@query("parse_date", """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS iso, CAST(l_shipdate AS DATE) AS us,
  CASE WHEN day(l_shipdate) <= 12 THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate))
       ELSE CAST(l_shipdate AS DATE) END AS dmy,
  CAST(l_shipdate AS DATE) AS ymd_slash, CAST(NULL AS DATE) AS junk
FROM lineitem""")
def parse_date_q(spark, d):
    """N8 on every ship date rendered in several layouts; day-first text is
    read month-first when both fit, as the reference does."""
    from ..sources.tables import table
    li = table(spark, d, "lineitem")
    sd = F.col("l_shipdate")
    return li.select(
        "l_orderkey", "l_linenumber",
        dates.parse_date(F.date_format(sd, "yyyy-MM-dd")).alias("iso"),
        dates.parse_date(F.date_format(sd, "M/d/yyyy")).alias("us"),
        dates.parse_date(F.date_format(sd, "d/M/yyyy")).alias("dmy"),
        dates.parse_date(F.date_format(sd, "yyyy/M/d")).alias("ymd_slash"),
        dates.parse_date(F.concat(F.date_format(sd, "M/d/yyyy"), F.lit("x"))).alias("junk"))


@query("norm_description", with_views_ctes("x AS (SELECT 1)", f"""
SELECT transaction_id, {sql_norm_description('description')} AS normalized FROM transactions""",
                                           "transactions"))
def norm_description_q(spark, d):
    """N1 over every ledger description."""
    return ledger.transactions(spark, d).select(
        "transaction_id", text.norm_description(F.col("description")).alias("normalized"))


@query("fingerprint", with_views_ctes("x AS (SELECT 1)", f"""
SELECT transaction_id,
  {sql_fingerprint('account_id', 'transaction_date', 'amount', 'description')} AS fingerprint
FROM transactions""", "transactions"))
def fingerprint_q(spark, d):
    """N2 over every ledger transaction."""
    return ledger.transactions(spark, d).select(
        "transaction_id",
        text.fingerprint("account_id", "transaction_date", "amount", "description").alias("fingerprint"))


@query("debit_credit", """
SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN d IS NOT NULL AND c IS NULL THEN (CASE WHEN neg AND d > 0 THEN -d ELSE d END)
       WHEN d IS NULL AND c IS NOT NULL THEN c
       WHEN d IS NOT NULL AND c IS NOT NULL THEN
         (CASE WHEN abs(d) >= abs(c) THEN (CASE WHEN neg AND d > 0 THEN -d ELSE d END) ELSE c END)
  END AS DECIMAL(15,2)) AS amount,
  CAST(-(CASE WHEN d IS NOT NULL AND c IS NULL THEN (CASE WHEN neg AND d > 0 THEN -d ELSE d END)
       WHEN d IS NULL AND c IS NOT NULL THEN c
       WHEN d IS NOT NULL AND c IS NOT NULL THEN
         (CASE WHEN abs(d) >= abs(c) THEN (CASE WHEN neg AND d > 0 THEN -d ELSE d END) ELSE c END)
  END) AS DECIMAL(15,2)) AS flipped
FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS neg,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(15,2)) END AS d,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity * 1000 AS DECIMAL(15,2)) END AS c FROM lineitem)""")
def debit_credit_q(spark, d):
    """Debit / credit columns resolved to one amount, and flipped."""
    from ..sources.tables import table
    li = table(spark, d, "lineitem")
    deb = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice").cast("decimal(15,2)"))
    cre = F.when(F.col("l_returnflag") != "N", (F.col("l_quantity") * 1000).cast("decimal(15,2)"))
    staged = li.select("l_orderkey", "l_linenumber", deb.alias("d"), cre.alias("c"),
                       (F.col("l_returnflag") == "A").alias("neg"))
    amt = amounts.resolve_debit_credit("d", "c", F.col("neg"))
    return staged.select("l_orderkey", "l_linenumber",
                         amt.cast("decimal(15,2)").alias("amount"),
                         amounts.flip_sign(amt, True).cast("decimal(15,2)").alias("flipped"))


@query("stmt_skip_rows", _stmt_sql("""
SELECT DISTINCT file_id, CAST(CASE fmt WHEN 'us' THEN 0 WHEN 'eu' THEN 1 ELSE 2 END AS BIGINT) AS header_pos,
  CASE fmt WHEN 'us' THEN 'Date,Description,Amount' WHEN 'eu' THEN 'Buchungstag;Verwendungszweck;Debit;Credit'
    ELSE '#Posted Date' || chr(9) || 'Memo' || chr(9) || 'Amt' || chr(9) || 'Balance' END AS header_line
FROM li"""))
def stmt_skip_rows(spark, d):
    """The header is the line right after the skipped preamble."""
    lines, man = _stmt(spark, d)
    return (lines.join(man.select("file_id", "skip_rows"), "file_id")
            .where(F.col("pos") == F.col("skip_rows"))
            .select("file_id", F.col("pos").alias("header_pos"), F.col("line").alias("header_line")))


@query("stmt_delimiter", _stmt_sql("""
SELECT fmt_delim AS delimiter, count(*) AS n_files FROM (
  SELECT DISTINCT file_id, CASE fmt WHEN 'us' THEN ',' WHEN 'eu' THEN ';' ELSE chr(9) END AS fmt_delim FROM li)
GROUP BY fmt_delim"""))
def stmt_delimiter(spark, d):
    """Files per detected delimiter."""
    lines, man = _stmt(spark, d)
    return statements.headers(lines, man).groupBy("delimiter").agg(F.count(F.lit(1)).alias("n_files"))
