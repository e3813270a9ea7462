"""Provider payload ingest.

Landed payloads are rows ``(payload_id, json)`` - from files with
``read_payload_files`` (``wholetext``: one document per file) or derived from
the driver tables (``fixture_payloads_a/b``). They are parsed with ``from_json``
against a fixed schema and flattened with ``explode``: one distributed pass, no
per-document Python.

Payload A: {accounts: [{id, name, currency, balance, available-balance,
balance-date, org{name,url,domain}, transactions: [{id, posted, amount,
description, transacted_at, pending, extra{category}}]}], errors: [..]}.
Payload B: {accounts: [{id, name, institution_name, institution_logo, provider,
currency, status}], balance: {amount, currency}, transactions: [{id, accountId,
amount, currency, date, merchant, description, isPending}]}; ids and amounts may
be JSON numbers or strings, so they are read as strings and cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import first_non_blank
from .tables import table

SCHEMA_A = """
accounts array<struct<
  id: string, name: string, currency: string, balance: string,
  `available-balance`: string, `balance-date`: bigint,
  org: struct<name: string, url: string, domain: string>,
  transactions: array<struct<id: string, posted: bigint, amount: string, description: string,
                             transacted_at: bigint, pending: boolean,
                             extra: struct<category: string>>>>>,
errors array<string>
"""

SCHEMA_B = """
accounts array<struct<id: string, name: string, institution_name: string,
                      institution_logo: string, provider: string, currency: string,
                      status: string>>,
balance struct<amount: string, currency: string>,
transactions array<struct<id: string, accountId: string, amount: string, currency: string,
                          date: string, merchant: string, description: string,
                          isPending: boolean>>
"""

DEFAULT_CURRENCY = "USD"


def read_payload_files(spark: SparkSession, paths) -> DataFrame:
    """Payload documents landed as files: one row per file."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("payload_id"), F.col("value").alias("json"))


def parse(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select("payload_id", F.from_json("json", schema).alias("p"))


# --- payload A ----------------------------------------------------------------

def a_accounts_raw(parsed: DataFrame) -> DataFrame:
    """One row per account per payload."""
    return parsed.select("payload_id", F.explode("p.accounts").alias("a"))


def a_accounts(parsed: DataFrame) -> DataFrame:
    """Account columns; the newest payload's view of each account wins
    (a map-side partial max_by, so repeated accounts cost one row per task)."""
    a = a_accounts_raw(parsed)
    # carry only the account's own fields through the aggregate, not its
    # transaction list
    fields = F.struct("a.name", "a.currency", "a.org", "a.balance", "a.`available-balance`",
                      "a.`balance-date`")
    latest = a.groupBy(F.col("a.id").alias("sf_id")).agg(
        F.max_by(fields, F.col("payload_id")).alias("a"))
    return latest.select(
        "sf_id",
        F.col("a.name").alias("name"),
        F.coalesce(F.col("a.currency"), F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.col("a.org.name").alias("institution_name"),
        F.col("a.org.url").alias("institution_url"),
        F.col("a.org.domain").alias("institution_domain"),
        F.col("a.balance").alias("sf_balance"),
        F.col("a.`available-balance`").alias("sf_available_balance"),
        F.col("a.`balance-date`").alias("sf_balance_date"),
    )


def a_snapshots(parsed: DataFrame, as_of_ts: str) -> DataFrame:
    """A snapshot per payload account whose balance parses; time is the
    balance date, else the sync time; source 'sync'."""
    a = a_accounts_raw(parsed)
    bal = F.col("a.balance").try_cast("decimal(15,2)")
    t = F.coalesce(F.timestamp_seconds(F.col("a.`balance-date`")).cast("timestamp_ntz"),
                   F.expr(f"TIMESTAMP_NTZ '{as_of_ts}'"))
    return a.where(bal.isNotNull()).select(
        "payload_id", F.col("a.id").alias("sf_account_id"), bal.alias("balance"),
        t.alias("snapshot_time"), F.lit("sync").alias("source"))


def a_transactions(parsed: DataFrame) -> DataFrame:
    """Amount parsed (0 when it does not parse), posted epoch -> date,
    category -> one-element tag list, raw fields kept."""
    a = a_accounts_raw(parsed)
    t = a.select("payload_id", F.col("a.id").alias("sf_account_id"),
                 F.posexplode("a.transactions").alias("tx_pos", "t"))
    cat = F.col("t.extra.category")
    return t.select(
        "payload_id", "tx_pos", "sf_account_id",
        F.col("t.id").alias("sf_id"),
        F.coalesce(F.col("t.amount").try_cast("decimal(15,2)"), F.lit(0).cast("decimal(15,2)"))
         .alias("amount"),
        F.col("t.description").alias("description"),
        F.to_date(F.timestamp_seconds(F.col("t.posted"))).alias("transaction_date"),
        F.when(cat.isNotNull(), F.array(cat)).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("t.amount").alias("sf_amount"),
        F.col("t.posted").alias("sf_posted"),
        F.col("t.transacted_at").alias("sf_transacted_at"),
        F.col("t.pending").alias("sf_pending"),
    )


# --- payload B ----------------------------------------------------------------

def b_accounts(parsed: DataFrame) -> DataFrame:
    """Active (or status-less) accounts; the balance's currency replaces a
    USD core currency; lf_currency filled from it when missing."""
    a = parsed.select("payload_id", F.col("p.balance").alias("bal"),
                      F.explode("p.accounts").alias("a"))
    a = a.where(F.col("a.status").isNull() | (F.col("a.status") == "ACTIVE"))
    latest = a.groupBy(F.col("a.id").alias("lf_id")).agg(
        F.max_by(F.struct("a", "bal"), F.col("payload_id")).alias("x"))
    core = F.coalesce(F.col("x.a.currency"), F.lit(DEFAULT_CURRENCY))
    bal_ccy = F.col("x.bal.currency")
    has_bal_ccy = bal_ccy.isNotNull() & (bal_ccy != "")
    return latest.select(
        "lf_id",
        F.col("x.a.name").alias("name"),
        F.when(has_bal_ccy & (core == "USD"), bal_ccy).otherwise(core).alias("currency"),
        F.col("x.a.institution_name").alias("institution_name"),
        F.col("x.a.provider").alias("lf_provider"),
        F.when(has_bal_ccy, F.coalesce(F.col("x.a.currency"), bal_ccy))
         .otherwise(F.col("x.a.currency")).alias("lf_currency"),
        F.col("x.a.status").alias("lf_status"),
        F.col("x.bal.amount").try_cast("decimal(15,2)").alias("balance"),
    )


def b_transactions(parsed: DataFrame) -> DataFrame:
    """I16: description = first non-blank of description, merchant (N12);
    ISO date parsed (null on failure, not today)."""
    t = parsed.select("payload_id", F.posexplode("p.transactions").alias("tx_pos", "t"))
    return t.select(
        "payload_id", "tx_pos",
        F.col("t.id").alias("lf_id"),
        F.col("t.accountId").alias("lf_account_id"),
        F.col("t.amount").try_cast("decimal(15,2)").alias("amount"),
        first_non_blank(F.col("t.description"), F.col("t.merchant")).alias("description"),
        parse_date(F.col("t.date"), ["yyyy-M-d"]).alias("transaction_date"),
        F.col("t.currency").alias("lf_currency"),
        F.col("t.merchant").alias("lf_merchant"),
        F.col("t.description").alias("lf_description"),
        F.col("t.isPending").alias("lf_is_pending"),
    )


# --- what a user should know of a payload ---------------------------------------------

def a_warnings(parsed: DataFrame) -> DataFrame:
    """(payload_id, message): the provider's own errors, and documents that could not be read."""
    unread = parsed.where(F.col("p.accounts").isNull() & F.col("p.errors").isNull())
    errors = parsed.select("payload_id", F.explode("p.errors").alias("message"))
    return errors.unionByName(unread.select("payload_id", F.lit("the document could not be read").alias("message")))


def b_warnings(parsed: DataFrame) -> DataFrame:
    """(payload_id, message): accounts that are not active, and documents that could not be read."""
    unread = parsed.where(F.col("p.accounts").isNull() & F.col("p.transactions").isNull())
    off = (parsed.select("payload_id", F.explode("p.accounts").alias("a")).where(F.col("a.status") != "ACTIVE")
           .select("payload_id", F.format_string("account %s is %s", F.coalesce("a.name", "a.id"), F.col("a.status")).alias("message")))
    return off.unionByName(unread.select("payload_id", F.lit("the document could not be read").alias("message")))


# --- settings -----------------------------------------------------------------

def balances_only_ids(settings: DataFrame) -> DataFrame:
    """External ids whose settings say balancesOnly (default false)."""
    flag = F.coalesce(F.get_json_object("settings", "$.balancesOnly").cast("boolean"), F.lit(False))
    return settings.where(flag).select("ext_id")


# --- fixtures: payloads derived from orders / customer / nation -------------------

def _order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = F.broadcast(table(spark, sf_dir, "nation"))  # fixed 25 rows
    cn = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return o.join(cn, o.o_custkey == cn.c_custkey)


def _epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def fixture_payloads_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload A per order that is not open: the customer as the account,
    the order plus a monthly fee as its transactions."""
    j = _order_customer(spark, sf_dir).where(F.col("o_orderstatus") != "O")
    prio, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    amount = (F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
              .otherwise(-F.col("o_totalprice"))).cast("decimal(15,2)").cast("string")
    category = (F.when(prio == "1-URGENT", F.lit("urgent")).when(prio == "2-HIGH", F.lit("high")))
    order_tx = F.struct(
        F.concat(F.lit("sf-"), key).alias("id"),
        (_epoch(F.col("o_orderdate")) + 86400).alias("posted"),
        F.when(prio == "4-NOT SPECIFIED", F.lit("n/a")).otherwise(amount).alias("amount"),
        F.concat(F.lit("ORDER "), prio).alias("description"),
        _epoch(F.col("o_orderdate")).alias("transacted_at"),
        (F.col("o_orderstatus") == "P").alias("pending"),
        F.struct(category.alias("category")).alias("extra"))
    fee_tx = F.struct(
        F.concat(F.lit("fee-"), F.col("c_custkey").cast("string"), F.lit("-"),
                 F.date_format("o_orderdate", "yyyyMM")).alias("id"),
        _epoch(F.col("o_orderdate")).alias("posted"),
        F.lit("-1.50").alias("amount"),
        F.lit("MONTHLY FEE").alias("description"),
        F.lit(None).cast("bigint").alias("transacted_at"),
        F.lit(False).alias("pending"),
        F.struct(F.lit(None).cast("string").alias("category")).alias("extra"))
    nname = F.lower(F.col("n_name"))
    account = F.struct(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("n_regionkey") == 3, F.lit("EUR"))
         .when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string"))
         .otherwise(F.lit("USD")).alias("currency"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("n/a"))
         .otherwise(F.col("c_acctbal").cast("decimal(15,2)").cast("string")).alias("balance"),
        F.col("c_acctbal").cast("decimal(15,2)").cast("string").alias("available-balance"),
        F.when(prio == "5-LOW", F.lit(None).cast("bigint"))
         .otherwise(_epoch(F.col("o_orderdate"))).alias("balance-date"),
        F.struct(F.col("n_name").alias("name"),
                 F.concat(F.lit("https://"), nname, F.lit(".example")).alias("url"),
                 F.concat(nname, F.lit(".example")).alias("domain")).alias("org"),
        F.array(order_tx, fee_tx).alias("transactions"))
    doc = F.struct(F.array(account).alias("accounts"), F.array().cast("array<string>").alias("errors"))
    return j.select(F.col("o_orderkey").alias("payload_id"), F.to_json(doc).alias("json"))


def fixture_payloads_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload B per open order. Written as text so ids and amounts can be
    JSON numbers in some documents and strings in others."""
    j = _order_customer(spark, sf_dir).where(F.col("o_orderstatus") == "O")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))  # noqa: E731 - plain ASCII values
    nul = F.lit("null")
    prio = F.col("o_orderpriority")
    cust = F.col("c_custkey").cast("string")
    status = (F.when(F.col("c_mktsegment") == "FURNITURE", q(F.lit("DISCONNECTED")))
              .when(F.col("c_mktsegment") == "MACHINERY", nul).otherwise(q(F.lit("ACTIVE"))))
    ccy = F.when(F.col("n_regionkey") == 3, q(F.lit("EUR"))).otherwise(q(F.lit("USD")))
    bal_ccy = F.when(F.col("n_regionkey") == 1, q(F.lit("CAD"))) \
        .when(F.col("n_regionkey") == 2, q(F.lit(""))).otherwise(q(F.lit("USD")))
    amount = (-F.col("o_totalprice")).cast("decimal(15,2)").cast("string")
    amount_json = F.when(prio.isin("1-URGENT", "2-HIGH"), q(amount)).otherwise(amount)
    acct_id = F.when(prio == "3-MEDIUM", q(cust)).otherwise(cust)
    desc = (F.when(prio == "1-URGENT", nul).when(prio == "2-HIGH", q(F.lit("")))
            .when(prio == "3-MEDIUM", q(F.lit("   ")))
            .otherwise(q(F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string")))))
    date = F.when(F.col("o_orderpriority") == "5-LOW", q(F.lit("not-a-date"))) \
        .otherwise(q(F.date_format("o_orderdate", "yyyy-MM-dd")))
    json = F.concat(
        F.lit('{"accounts":[{"id":'), acct_id, F.lit(',"name":'), q(F.col("c_name")),
        F.lit(',"institution_name":'), q(F.col("n_name")),
        F.lit(',"institution_logo":null,"provider":"bank","currency":'), ccy,
        F.lit(',"status":'), status, F.lit('}],"total":1,"balance":{"amount":'),
        F.col("c_acctbal").cast("decimal(15,2)").cast("string"), F.lit(',"currency":'), bal_ccy,
        F.lit('},"transactions":[{"id":'), q(F.concat(F.lit("lf-"), F.col("o_orderkey").cast("string"))),
        F.lit(',"accountId":'), acct_id, F.lit(',"amount":'), amount_json,
        F.lit(',"currency":"USD","date":'), date,
        F.lit(',"merchant":'), q(F.concat(F.lit("MERCHANT "), cust)),
        F.lit(',"description":'), desc,
        F.lit(',"isPending":'), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("true"))
        .otherwise(F.lit("false")),
        F.lit('}],"total":1}'))
    return j.select(F.col("o_orderkey").alias("payload_id"), json.alias("json"))


def fixture_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-account provider settings: HOUSEHOLD accounts sync balances only."""
    c = table(spark, sf_dir, "customer")
    s = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit('{"balancesOnly":true}'))
         .when(F.col("c_mktsegment") == "BUILDING", F.lit('{"balancesOnly":false}'))
         .otherwise(F.lit("{}")))
    return c.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("ext_id"),
                    s.alias("settings"))
