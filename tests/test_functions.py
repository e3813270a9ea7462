"""Scalar expressions against the reference's literal examples."""

from decimal import Decimal
from datetime import date

from pyspark.sql import functions as F

from tallyframe.functions import amounts, dates, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def many(spark, values, fn, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r.x for r in df.select(fn(F.col(df.columns[0])).alias("x")).collect()]


def test_parse_amount_us(spark):
    vals = ["100.50", "-50.25", "1,234.56", "$100.00", "-$50.00", "(100.00)", "(1,234.56)",
            "  100.50  ", "", "abc", "100.50 USD", "1-2", "--5", "-", "100-", ".", "1.2.3"]
    got = many(spark, vals, lambda c: amounts.parse_amount(c, "us").cast("decimal(15,2)"))
    exp = ["100.50", "-50.25", "1234.56", "100.00", "-50.00", "-100.00", "-1234.56", "100.50",
           None, None, "100.50", None, None, None, None, None, None]
    assert got == [Decimal(e) if e is not None else None for e in exp]


def test_parse_amount_eu(spark):
    got = many(spark, ["1.234,56", "100,50 EUR"], lambda c: amounts.parse_amount(c, "eu"))
    assert [g.quantize(Decimal("0.01")) for g in got] == [Decimal("1234.56"), Decimal("100.50")]
    got = many(spark, ["8 019,40 PLN"], lambda c: amounts.parse_amount(c, "eu_space"))
    assert got[0].quantize(Decimal("0.01")) == Decimal("8019.40")


def test_number_format_names(spark):
    got = many(spark, ["us", "eu", "eu_space", "unknown", "EU"], amounts.number_format)
    assert got == ["us", "eu", "eu_space", "us", "eu"]


def test_parse_date(spark):
    got = many(spark, ["2024-01-15", "12/03/2025", "not-a-date", "", "25/12/2024", "2024/1/5",
                       "02-30-2024", "1/5/2024"], dates.parse_date)
    assert got == [date(2024, 1, 15), date(2025, 12, 3), None, None, date(2024, 12, 25),
                   date(2024, 1, 5), None, date(2024, 1, 5)]


def test_fingerprint_properties(spark):
    rows = [("12345678-1234-1234-1234-123456789abc", date(2025, 1, 15), Decimal("-50.00"), "ACME STORE"),
            ("12345678-1234-1234-1234-123456789abc", date(2025, 1, 15), Decimal("-50.00"), "acme   store!"),
            ("12345678-1234-1234-1234-123456789abc", date(2025, 1, 15), Decimal("-51.00"), "ACME STORE"),
            ("12345678-1234-1234-1234-123456789abc", date(2025, 1, 16), Decimal("-50.00"), "ACME STORE"),
            ("other", date(2025, 1, 15), Decimal("-50.00"), "ACME STORE")]
    df = spark.createDataFrame(rows, "a string, d date, amt decimal(15,2), s string")
    fps = [r.fp for r in df.select(text.fingerprint("a", "d", "amt", "s").alias("fp")).collect()]
    assert all(len(f) == 16 for f in fps)
    assert fps[0] == fps[1]
    assert len({fps[0], fps[2], fps[3], fps[4]}) == 4


def test_fingerprint_matches_plain_python(spark):
    import hashlib
    df = spark.createDataFrame([("acc", date(2025, 1, 15), Decimal("-50.00"),
                                 "PURCHASE XXXXXXXXXXXX1234 STORE null")],
                               "a string, d date, amt decimal(15,2), s string")
    # the card mask goes entirely, so only 'purchase' + 'store' remain
    got = df.select(text.fingerprint("a", "d", "amt", "s").alias("fp")).first().fp
    assert got == hashlib.sha256(b"acc|2025-01-15|-50.00|purchasestore").hexdigest()[:16]


def test_norm_description(spark):
    got = many(spark, ["PURCHASE XXXXXXXXXXXX1234 STORE", "null PAYMENT null", "PAYMENT 7208987070",
                       None, "Ref 12345", "x1x2x3x4x5"], text.norm_description)
    assert "xxxx" not in got[0] and got[0] == "purchasestore"
    assert got[1] == "payment"
    assert got[2] == "payment7070"
    assert got[3] == ""
    assert got[4] == "ref12345"          # 5 digits: shorter than 7, kept
    assert got[5] == "2345"              # a 10-char run of x and digits -> last 4 digits


def test_norm_tags(spark):
    df = spark.createDataFrame([(["food", "  groceries ", "food", ""],)], "t array<string>")
    assert df.select(text.norm_tags("t").alias("x")).first().x == ["food", "groceries"]


def test_split_list(spark):
    got = many(spark, ["a, b,,c", "x\n y\n"], text.split_list)
    assert got == [["a", "b", "c"], ["x", "y"]]


def test_currency_and_first_non_blank(spark):
    assert many(spark, ["usd", " eur "], text.norm_currency) == ["USD", "EUR"]
    df = spark.createDataFrame([("Card payment", "Coffee Shop"), (None, "Employer Inc"),
                                ("", "Grocery Store"), ("   ", "Gas Station")], "d string, m string")
    got = [r.x for r in df.select(text.first_non_blank("d", "m").alias("x")).collect()]
    assert got == ["Card payment", "Employer Inc", "Grocery Store", "Gas Station"]


def test_debit_credit(spark):
    rows = [(Decimal("10"), None, False), (None, Decimal("5"), False), (Decimal("10"), Decimal("5"), False),
            (Decimal("5"), Decimal("10"), False), (Decimal("7"), Decimal("7"), True),
            (Decimal("10"), None, True), (None, None, True)]
    df = spark.createDataFrame(rows, "d decimal(10,2), c decimal(10,2), neg boolean")
    got = [r.x for r in df.select(amounts.resolve_debit_credit("d", "c", F.col("neg")).alias("x")).collect()]
    assert got == [Decimal("10"), Decimal("5"), Decimal("10"), Decimal("10"), Decimal("-7"),
                   Decimal("-10"), None]


def test_end_of_day(spark):
    v = one(spark, dates.end_of_day(F.lit("2024-03-01").cast("date")))
    assert (v.hour, v.minute, v.second, v.microsecond) == (23, 59, 59, 999999)


def test_parse_timestamp(spark):
    got = many(spark, ["2024-01-15T10:20:30Z", "2024-01-15 10:20:30.123456", "2024-01-15T10:20:30",
                       "garbage"], dates.parse_timestamp)
    assert got[0] is not None and got[1] is not None and got[2] is not None
    assert got[3] is None
