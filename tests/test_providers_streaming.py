"""Provider payloads (literal examples, files), streaming jobs, driver contract."""

import json
import os
import re
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import sync
from tallyframe.sources import ledger, providers
from tallyframe.streaming import jobs


def _payloads(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "payload_id long, json string")


def test_payload_b_descriptions_and_mixed_types(spark):
    txs = [{"id": "t1", "accountId": 7, "amount": -12.5, "currency": "USD", "date": "2024-01-02",
            "merchant": "Coffee Shop", "description": "Card payment", "isPending": False},
           {"id": "t2", "accountId": "7", "amount": "100", "currency": "USD", "date": "2024-01-03",
            "merchant": "Employer Inc", "description": None, "isPending": False},
           {"id": "t3", "accountId": 7, "amount": 5, "currency": "USD", "date": "bad",
            "merchant": "Grocery Store", "description": "", "isPending": True},
           {"id": "t4", "accountId": 7, "amount": 1, "currency": "USD", "date": "2024-01-05",
            "merchant": "Gas Station", "description": "   ", "isPending": False}]
    doc = json.dumps({"accounts": [{"id": 7, "name": "Main", "institution_name": "Bank",
                                    "currency": "USD", "status": "ACTIVE"},
                                   {"id": 8, "name": "Old", "institution_name": "Bank",
                                    "currency": "USD", "status": "DISCONNECTED"}],
                      "balance": {"amount": 10.5, "currency": "EUR"}, "transactions": txs})
    parsed = providers.parse(_payloads(spark, [doc]), providers.SCHEMA_B)
    t = {r.lf_id: r for r in providers.b_transactions(parsed).collect()}
    assert [t[k].description for k in ["t1", "t2", "t3", "t4"]] == \
        ["Card payment", "Employer Inc", "Grocery Store", "Gas Station"]
    assert t["t1"].lf_account_id == "7" and t["t2"].lf_account_id == "7"
    assert t["t1"].amount == Decimal("-12.50") and t["t2"].amount == Decimal("100.00")
    assert t["t3"].transaction_date is None
    acc = providers.b_accounts(parsed).collect()
    assert [(a.lf_id, a.currency, a.lf_currency) for a in acc] == [("7", "EUR", "USD")]


def test_payload_a_files_and_defaults(spark):
    d = tempfile.mkdtemp(prefix="payload-")
    doc = {"accounts": [{"id": "acc1", "name": "Checking", "balance": "12.30",
                         "balance-date": 1704067200, "org": {"name": "Bank"},
                         "transactions": [{"id": "x1", "posted": 1704153600, "amount": "oops",
                                           "description": "A", "extra": {"category": "food"}},
                                          {"id": "x2", "posted": 1704153600, "amount": "-4.20",
                                           "description": "B"}]}],
           "errors": []}
    with open(os.path.join(d, "p1.json"), "w") as f:
        json.dump(doc, f, indent=2)
    parsed = providers.parse(providers.read_payload_files(spark, d), providers.SCHEMA_A)
    acc = providers.a_accounts(parsed).first()
    assert acc.currency == "USD" and acc.institution_name == "Bank"
    tx = {r.sf_id: r for r in providers.a_transactions(parsed).collect()}
    assert tx["x1"].amount == Decimal("0.00") and tx["x1"].tags == ["food"]
    assert tx["x2"].amount == Decimal("-4.20") and tx["x2"].tags == []
    assert str(tx["x2"].transaction_date) == "2024-01-02"
    snap = providers.a_snapshots(parsed, "2024-02-01 00:00:00").first()
    assert snap.balance == Decimal("12.30") and str(snap.snapshot_time) == "2024-01-01 00:00:00"


def test_provider_id_dedup_keeps_first_and_skips_known(spark):
    tx = spark.createDataFrame([(2, 0, "a", "id1"), (1, 0, "a", "id1"), (1, 1, "a", "id2"), (3, 0, "a", "id3")],
                               "payload_id long, tx_pos int, sf_account_id string, sf_id string")
    ledger_tx = spark.createDataFrame([("id3",)], "sf_id string")
    new = {r.sf_id: r.payload_id for r in sync.new_transactions(tx, ledger_tx).collect()}
    assert new == {"id1": 1, "id2": 1}


def test_sync_window_empty_ledger(spark):
    empty = spark.createDataFrame([], "transaction_date date, deleted_at timestamp_ntz")
    w = sync.sync_window(empty, "2024-03-31").first()
    assert str(w.start_date) == "2024-01-01" and w.end_epoch - w.start_epoch == 90 * 86400 + 86399


def test_streaming_dedup_matches_batch(spark, sf_small):
    got = {r.provider_id for r in jobs.stream_dedup(spark, sf_small, ledger.transactions(spark, sf_small)).collect()}
    ids = jobs.event_provider_ids(spark.read.parquet(f"{sf_small}/events.parquet"))
    known = ledger.transactions(spark, sf_small).select(F.col("transaction_id").alias("provider_id"))
    want = {r.provider_id for r in ids.select("provider_id").distinct().join(known, "provider_id", "left_anti").collect()}
    assert got == want and len(got) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # only training-data operators may have no SQL form
    assert all(k == "pipeline" or re.match(r"op\d+_", k) for k in set(q) - set(o))


def test_api_workflows_on_fixture(spark, sf_small):
    from tallyframe import api
    from tallyframe.sources import config
    tx, acc = ledger.transactions(spark, sf_small), ledger.accounts(spark, sf_small)
    snaps = ledger.balance_snapshots(spark, sf_small)
    checks, summary = api.doctor(tx, snaps, acc, ledger.AS_OF, config.categories(spark))
    s = summary.first()
    assert s.passed + s.warnings + s.errors == checks.count() == 6
    assert api.status(tx, snaps, acc).first().total_accounts == acc.count()
    pv = api.backfill(tx, snaps, ledger.anchors(spark, sf_small), start="2024-01-05")
    assert pv.count() > 0
    mapping = acc.select(F.concat(F.lit("cust-"), F.col("account_id")).alias("ext_id"), "account_id")
    payloads = providers.fixture_payloads_a(spark, sf_small)
    out = api.sync_provider_a(payloads, tx, acc.select("account_id", "name", "currency", "account_type"), snaps, mapping,
                              "2001-08-01 00:00:00", providers.fixture_settings(spark, sf_small), config.rules(spark))
    st = out.stats.first()
    assert st.discovered == st.new + st.skipped and out.new_transactions.count() == st.new
    assert out.accounts.count() == acc.count() + st.new_accounts and st.new_accounts > 0
    assert out.transactions.count() == tx.count() + st.new
    assert out.snapshots.count() == snaps.count() + providers.a_snapshots(
        providers.parse(payloads, providers.SCHEMA_A), "2001-08-01 00:00:00").count()
    only = api.sync_provider_a(payloads, tx, acc.select("account_id", "name", "currency", "account_type"), snaps, mapping,
                               "2001-08-01 00:00:00", balances_only=True)
    assert only.stats.first().new == 0 and only.snapshots.count() == out.snapshots.count()
    n = api.query(spark, sf_small, "SELECT count(*) AS n FROM transactions WHERE amount < ?", [0]).first().n
    assert n > 0


def test_streaming_log_counts_match_batch(spark, sf_small):
    got = {(str(r.day), r.event_type): r.n for r in jobs.stream_log_counts(spark, sf_small).collect()}
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    want = {(str(r.day), r.event_type): r.n for r in
            ev.groupBy(F.to_date("ts").alias("day"), "event_type").count()
              .withColumnRenamed("count", "n").collect()}
    assert got == want and len(got) > 0


def _late_folder(spark, sf_small):
    """The events table as a folder of 4 files, newest events in the first."""
    d = tempfile.mkdtemp(prefix="events-")
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    rows = ev.orderBy(F.desc("ts")).collect()
    os.makedirs(f"{d}/events.parquet")
    for i in range(4):
        part = f"{d}/part{i}"
        spark.createDataFrame(rows[i * len(rows) // 4:(i + 1) * len(rows) // 4], ev.schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{d}/events.parquet/{i}.parquet")
        os.utime(f"{d}/events.parquet/{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return d


def test_streams_keep_late_rows_of_a_folder(spark, sf_small):
    d = _late_folder(spark, sf_small)
    known = ledger.transactions(spark, sf_small)
    got = [r.provider_id for r in jobs.stream_dedup(spark, d, known).collect()]
    ids = jobs.event_provider_ids(spark.read.parquet(f"{sf_small}/events.parquet")).select("provider_id").distinct()
    want = ids.join(known.select(F.col("transaction_id").alias("provider_id")), "provider_id", "left_anti").count()
    assert len(got) == len(set(got)) == want > 0
    assert jobs.stream_log_counts(spark, d).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_small}/events.parquet").count()


def test_sync_keeps_rows_of_new_accounts_and_reports(spark):
    from tallyframe import api
    doc = {"accounts": [{"id": k, "name": k, "balance": "1.00", "balance-date": 1704067200, "transactions": [
        {"id": f"{k}-1", "posted": 1704153600, "amount": "-4.20", "description": "B"}]} for k in ("old", "fresh")],
        "errors": ["bank asks for a new login"]}
    known = spark.createDataFrame([("old", "acc-1")], "ext_id string, account_id string")
    accounts = spark.createDataFrame([("acc-1", "Old")], "account_id string, name string")
    ledger_tx = spark.createDataFrame([], "transaction_id string, account_id string, sf_id string, lf_id string")
    snaps = spark.createDataFrame([], "snapshot_id string, account_id string, balance decimal(15,2), snapshot_time timestamp_ntz, source string")
    out = api.sync_provider_a(_payloads(spark, [json.dumps(doc), "{broken"]), ledger_tx, accounts, snaps, known, "2024-02-01 00:00:00")
    assert sorted((r.transaction_id, r.account_id) for r in out.new_transactions.collect()) == [("tx-fresh-1", "acct-fresh"), ("tx-old-1", "acc-1")]
    assert sorted(r.account_id for r in out.accounts.collect()) == ["acc-1", "acct-fresh"]
    assert sorted(r.account_id for r in out.snapshots.collect()) == ["acc-1", "acct-fresh"]
    st = out.stats.first()
    assert (st.discovered, st.new, st.skipped, st.new_accounts) == (2, 2, 0, 1)
    assert sorted(r.message for r in out.warnings.collect()) == ["bank asks for a new login", "the document could not be read"]
    b = {"accounts": [{"id": "7", "name": "Main", "currency": "USD", "status": "ACTIVE"}, {"id": "8", "name": "Gone", "status": "ERROR"}],
         "balance": {"amount": "10.5", "currency": "USD"},
         "transactions": [{"id": "t1", "accountId": "7", "amount": 1, "date": "2024-01-02", "description": "x"},
                          {"id": "t2", "accountId": "8", "amount": 1, "date": "2024-01-02", "description": "x"}]}
    out = api.sync_provider_b(_payloads(spark, [json.dumps(b)]), ledger_tx, accounts, snaps, known.where("false"), "2024-02-01 00:00:00")
    assert [(r.transaction_id, r.account_id) for r in out.new_transactions.collect()] == [("tx-t1", "acct-7")]
    assert [r.message for r in out.warnings.collect()] == ["account Gone is ERROR"] and out.snapshots.count() == 1
