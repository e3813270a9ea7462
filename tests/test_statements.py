"""Statement ingest from real files, as the reference's integration tests do."""

import os
import tempfile
from decimal import Decimal

from tallyframe.sources import statements

MANIFEST_COLS = statements.MANIFEST_SCHEMA


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def _manifest(spark, path, **kw):
    row = dict(file_id="file:" + path, account_id="acc-1", skip_rows=0, number_format="us",
               date_col="date", amount_col="amount", description_col="description",
               debit_col=None, credit_col=None, balance_col=None, debit_negative=False,
               flip_signs=False, anchor_balance=None, anchor_date=None)
    row.update(kw)
    cols = [c.split(" ")[0] for c in MANIFEST_COLS.split(", ")]
    return spark.createDataFrame([tuple(row[c] for c in cols)], MANIFEST_COLS)


def test_simple_csv_import_and_reimport(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "a.csv", "date,amount,description\n2024-01-15,12.34,Coffee Shop\n"
                           "2024-01-16,-45.67,Restaurant\n2024-01-17,100.00,Refund\n")
    lines = statements.read_statement_files(spark, p)
    man = _manifest(spark, p)
    rows = statements.parse_rows(lines, man)
    got = sorted((str(r.transaction_date), r.amount, r.description, r.status) for r in rows.collect())
    assert got == [("2024-01-15", Decimal("12.34"), "Coffee Shop", "ok"),
                   ("2024-01-16", Decimal("-45.67"), "Restaurant", "ok"),
                   ("2024-01-17", Decimal("100.00"), "Refund", "ok")]
    empty_ledger = spark.createDataFrame([], "csv_fingerprint string")
    new = statements.new_rows(rows, empty_ledger)
    counts = statements.import_counts(rows, new).first()
    assert (counts.discovered, counts.imported, counts.skipped) == (3, 3, 0)
    # the same file again: every fingerprint is known now
    ledger = statements.to_transactions(new, "import_1").select("csv_fingerprint")
    again = statements.new_rows(rows, ledger)
    counts = statements.import_counts(rows, again).first()
    assert (counts.imported, counts.skipped) == (0, 3)


def test_skip_rows_semicolons_quotes_and_ragged(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "b.csv", "Bank export\nAccount 1\n#Datum ; Text;Betrag\n"
                           '15.01.2024;"Kaffee; gross";-1.234,50\n'
                           '2024-01-16;"He said ""hi""";12,00 EUR\n'
                           "2024-01-17;too;many;fields\n"
                           "2024-01-18;bad amount;abc\n")
    lines = statements.read_statement_files(spark, p)
    man = _manifest(spark, p, skip_rows=2, number_format="eu", date_col="Datum",
                    amount_col="Betrag", description_col="Text")
    hdr = statements.headers(lines, man).first()
    assert hdr.delimiter == ";" and hdr.header == ["Datum", "Text", "Betrag"]
    rows = {r.pos: r for r in statements.parse_rows(lines, man).collect()}
    assert sorted(rows) == [3, 4, 6]                      # pos 5 is ragged: dropped
    assert rows[3].status == "bad_date"                  # 15.01.2024 is not a known layout
    assert rows[4].amount == Decimal("12.00") and rows[4].description == 'He said "hi"'
    assert rows[6].status == "bad_amount"
    assert statements.ragged_counts(lines, man).first().ragged == 1


def test_debit_credit_balance_and_eod_snapshot(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "c.csv", "Date\tMemo\tDebit\tCredit\tBalance\n"
                           "2024-02-01\tRent\t500.00\t\t1500.00\n"
                           "2024-02-01\tSalary\t\t2000.00\t3500.00\n"
                           "2024-02-02\tShop\t20.00\t\t3480.00\n")
    lines = statements.read_statement_files(spark, p)
    man = _manifest(spark, p, date_col="Date", amount_col="Amount", description_col="Memo",
                    debit_col="Debit", credit_col="Credit", balance_col="Balance", debit_negative=True)
    rows = statements.parse_rows(lines, man)
    amts = [r.amount for r in rows.orderBy("pos").collect()]
    assert amts == [Decimal("-500.00"), Decimal("2000.00"), Decimal("-20.00")]
    existing = spark.createDataFrame([], "account_id string, snapshot_time timestamp_ntz, balance decimal(15,2)")
    eod = {str(r.day): r.balance for r in statements.end_of_day_snapshots(rows, existing).collect()}
    assert eod == {"2024-02-01": Decimal("3500.00"), "2024-02-02": Decimal("3480.00")}
    det = statements.detect_columns(statements.headers(lines, man)).first()
    assert (det.date, det.amount, det.debit, det.credit, det.description) == \
        ("Date", None, "Debit", "Credit", "Memo")


def test_quoted_newline_stays_one_record(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "m.csv", 'date,amount,description\r\n2024-03-01,1.00,"two\nlines"\r\n'
                           '2024-03-02,2.00,plain\n')
    lines = statements.read_statement_files(spark, p)
    rows = statements.parse_rows(lines, _manifest(spark, p)).orderBy("pos").collect()
    assert [(r.description, r.amount, r.status) for r in rows] == \
        [("two\nlines", Decimal("1.00"), "ok"), ("plain", Decimal("2.00"), "ok")]


def test_import_workflow_end_to_end(spark):
    from tallyframe import api
    from tallyframe.sources import config
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "w.csv", "date,amount,description,balance\n2024-01-15,-12.34,URGENT Coffee,100.00\n"
                           "2024-01-15,50.00,Refund,150.00\n2024-01-16,-5.00,Tea,145.00\n")
    man = _manifest(spark, p, balance_col="balance")
    accounts = spark.createDataFrame([("acc-1", "Main", "credit", "usd", "Bank")],
                                     "account_id string, name string, account_type string, currency string, institution_name string")
    ledger_tx = spark.createDataFrame([], "transaction_id string, account_id string, amount decimal(15,2), "
                                          "csv_fingerprint string")
    snaps = spark.createDataFrame([], "snapshot_id string, account_id string, balance decimal(15,2), "
                                      "snapshot_time timestamp_ntz, source string")
    res = api.import_statements(spark, p, man, ledger_tx, snaps, accounts, "import_1", config.rules(spark))
    c = res.counts.first()
    assert (c.discovered, c.imported, c.skipped, c.snapshots_created) == (3, 3, 0, 2)
    tags = {r.description: r.tags for r in res.new_rows.collect()}
    assert "priority" in tags["URGENT Coffee"] and "card" in tags["Tea"]
    again = api.import_statements(spark, p, man, res.transactions, res.snapshots, accounts, "import_2")
    c = again.counts.first()
    assert (c.imported, c.skipped, c.snapshots_created) == (0, 3, 0)
    assert again.transactions.count() == 3 and again.snapshots.count() == 2


def test_stray_quotes_are_text(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = _write(d, "q.csv", 'date,amount,description\n2024-01-01,5.00,12" pipe\n2024-01-02,6.00,8" pipe\n'
                           '2024-01-03,7.00,"a ""b"", c\nd"\n2024-01-04,99999999999999.00,big\n,1.00,"x"y\n')
    rows = statements.parse_rows(statements.read_statement_files(spark, p), _manifest(spark, p)).collect()
    got = sorted(((str(r.transaction_date), r.description, r.status) for r in rows))
    assert got == [("2024-01-01", '12" pipe', "ok"), ("2024-01-02", '8" pipe', "ok"), ("2024-01-03", 'a "b", c\nd', "ok"),
                   ("2024-01-04", "big", "bad_amount"), ("None", "xy", "bad_date")]


def test_overlapping_files_and_unusable_files(spark):
    from tallyframe import api
    d = tempfile.mkdtemp(prefix="stmt-")
    head = "date,amount,description,balance\n"
    a = _write(d, "a.csv", head + "2024-01-01,1.00,one,10.00\n2024-01-01,1.00,one,11.00\n2024-01-02,2.00,two,13.00\n")
    b = _write(d, "b.csv", head + "2024-01-01,1.00,one,99.00\n2024-01-02,2.00,two,13.00\n2024-01-03,3.00,three,16.00\n")
    c = _write(d, "c.csv", "date,description\n2024-01-01,one\n")
    e = _write(d, "e.csv", head)
    man = _manifest(spark, a, balance_col="balance")
    for path, extra in ((b, {"balance_col": "balance"}), (c, {}), (e, {"account_id": "nobody"})):
        man = man.unionByName(_manifest(spark, path, **extra))
    ledger_tx = spark.createDataFrame([], "transaction_id string, account_id string, csv_fingerprint string")
    snaps = spark.createDataFrame([], "snapshot_id string, account_id string, balance decimal(15,2), snapshot_time timestamp_ntz, source string")
    accounts = spark.createDataFrame([("acc-1", "A", "depository", "USD", "Bank")],
                                     "account_id string, name string, account_type string, currency string, institution_name string")
    out = api.import_statements(spark, [a, b, c, e], man, ledger_tx, snaps, accounts, "import_1")
    assert sorted(r.description for r in out.new_rows.collect()) == ["one", "one", "three", "two"]
    shots = sorted((str(r.snapshot_time)[:10], r.balance) for r in out.snapshots.collect())
    assert shots == [("2024-01-01", Decimal("99.00")), ("2024-01-02", Decimal("13.00")), ("2024-01-03", Decimal("16.00"))]
    assert out.snapshots.select("snapshot_id").distinct().count() == 3
    errors = {os.path.basename(r.file_id): r.error for r in out.errors.collect()}
    assert errors == {"c.csv": "amount column not found", "e.csv": "account not found"}


def test_line_ends_and_byte_order_mark(spark, tmp_path):
    rows = ["Date,amount,description", "2024-01-01,5.00,Tea", '2024-01-02,6.00,"two\rlines"', "2024-01-03,7.00,Milk"]
    for name, end, mark in [("cr", "\r", ""), ("crlf", "\r\n", "﻿"), ("lf", "\n", "﻿"), ("mixed", None, "")]:
        path = tmp_path / f"{name}.csv"
        text = end.join(rows) if end else rows[0] + "\r\n" + rows[1] + "\r" + rows[2] + "\n" + rows[3]
        path.write_bytes((mark + text).encode())
        lines = statements.read_statement_files(spark, str(path))
        man = _manifest(spark, str(path), date_col="Date")
        got = sorted((str(r.transaction_date), str(r.amount), r.description, r.status) for r in statements.parse_rows(lines, man).collect())
        assert got == [("2024-01-01", "5.00", "Tea", "ok"), ("2024-01-02", "6.00", "two\rlines", "ok"), ("2024-01-03", "7.00", "Milk", "ok")], name
        assert statements.ragged_counts(lines, man).count() == 0


def test_running_balance_orders_no_whole_file(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("date,amount,description\n" + "".join(f"2024-01-{1 + i % 9:02},{i}.50,d{i}\n" for i in range(60)))
    man = _manifest(spark, str(path), anchor_balance=Decimal("1000.00"), anchor_date=__import__("datetime").date(2024, 1, 7))
    rows = statements.parse_rows(statements.read_statement_files(spark, str(path)), man)
    got = {r.pos: (r.preview_rank, r.balance) for r in statements.preview(rows).collect()}
    order = sorted(range(60), key=lambda i: (1 + i % 9, i), reverse=True)
    left, want = Decimal("1000.00"), {}
    for rank, i in enumerate(order, 1):
        counted = 1 + i % 9 <= 7
        want[i + 1] = (rank, left if counted else None)
        left -= Decimal(f"{i}.50") if counted else 0
    assert got == want
    plan = statements.running_balance(rows)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) >= 2 and all("[file_id" not in w or "transaction_date" in w or "sum(n" in w or "day_amount" in w for w in windows)
