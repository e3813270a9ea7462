"""Balance windows against plain Python loops (the reference's algorithms)."""

from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import balances, views
from tallyframe.sources import ledger, statements


def test_backfill_matches_loop(spark, sf_small):
    tx = ledger.transactions(spark, sf_small)
    snaps = ledger.balance_snapshots(spark, sf_small)
    anchors = ledger.anchors(spark, sf_small)
    start = "2024-01-05"
    got = {(r.account_id, r.day): r for r in
           balances.backfill_preview(tx, snaps, anchors, start=start).collect()}

    anc = {r.account_id: (r.known_balance, r.known_date) for r in anchors.collect()}
    totals = defaultdict(Decimal)
    counts = defaultdict(int)
    for r in views.active(tx).select("account_id", "transaction_date", "amount").collect():
        totals[(r.account_id, r.transaction_date)] += r.amount
        counts[(r.account_id, r.transaction_date)] += 1
    first_snap = {}
    for r in snaps.orderBy("snapshot_time", "snapshot_id").collect():
        first_snap.setdefault((r.account_id, r.snapshot_time.date()), r)
    want = {}
    for acc, (kb, kd) in anc.items():
        days = {d for (a, d) in totals if a == acc and d <= kd}
        days |= {d for (a, d) in first_snap if a == acc and d <= kd}
        bal = kb
        for d in sorted(days, reverse=True):
            if str(d) >= start:
                s = first_snap.get((acc, d))
                want[(acc, d)] = (bal, totals.get((acc, d), Decimal(0)), counts.get((acc, d), 0),
                                  s is None, None if s is None else s.balance)
            bal -= totals.get((acc, d), Decimal(0))
    assert set(got) == set(want)
    for k, (b, chg, n, is_new, eb) in want.items():
        r = got[k]
        assert (r.balance, r.daily_change, r.n_transactions, r.is_new, r.existing_balance) == \
            (b, chg, n, is_new, eb), k


def test_backfill_at_known_date_returns_known_balance(spark, sf_small):
    tx = ledger.transactions(spark, sf_small)
    snaps = ledger.balance_snapshots(spark, sf_small)
    anchors = ledger.anchors(spark, sf_small)
    pv = balances.backfill_preview(tx, snaps, anchors, start=None)
    j = pv.join(anchors, "account_id").where(F.col("day") == F.col("known_date"))
    assert j.where(F.col("balance") != F.col("known_balance")).count() == 0


def test_latest_balance_example(spark):
    rows = [("s%d" % i, "a1", Decimal(f"{10 * (i + 1)}.00"), f"2024-01-01 10:0{i}:00") for i in range(5)]
    df = spark.createDataFrame(rows, "snapshot_id string, account_id string, balance decimal(15,2), t string") \
        .select("snapshot_id", "account_id", "balance",
                F.col("t").cast("timestamp_ntz").alias("snapshot_time"),
                F.col("t").cast("timestamp_ntz").alias("created_at"))
    assert views.latest_balances(df).first().balance == Decimal("50.00")


def test_statement_running_balance_matches_loop(spark, sf_small):
    lines, man = statements.fixture_lines(spark, sf_small)
    rows = statements.parse_rows(lines, man)
    got = {(r.file_id, r.pos): r.running_balance for r in statements.running_balance(rows).collect()}
    ok = [r for r in rows.where("status = 'ok'").collect()]
    by_file = defaultdict(list)
    for r in ok:
        by_file[r.file_id].append(r)
    want = {}
    for f, rs in by_file.items():
        if any(r.balance is not None for r in rs) or rs[0].anchor_balance is None:
            continue
        ab, ad = rs[0].anchor_balance, rs[0].anchor_date
        opening, closing = {}, ab
        for d in sorted({r.transaction_date for r in rs}, reverse=True):
            if d > ad:
                continue
            opening[d] = closing - sum(r.amount for r in rs if r.transaction_date == d)
            closing = opening[d]
        for d in sorted(opening):
            bal = opening[d]
            for r in sorted((r for r in rs if r.transaction_date == d), key=lambda r: r.pos):
                bal += r.amount
                want[(f, r.pos)] = bal
        for r in rs:
            want.setdefault((f, r.pos), None)
    assert set(got) == set(want)
    assert all(got[k] == want[k] for k in want)
