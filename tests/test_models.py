"""N1 and N5 against small Python models of the reference's rules, on a few
hundred generated inputs (one Spark job each)."""

import random
import re
from decimal import Decimal, InvalidOperation, localcontext

from pyspark.sql import functions as F

from tallyframe.functions import amounts, text

CURRENCIES = amounts.CURRENCY_SUFFIXES


def model_amount(s, fmt):
    s = s.strip()
    if not s:
        return None
    for c in CURRENCIES:
        if s.endswith(c):
            s = s[:-len(c)].strip()
            break
    neg = len(s) >= 2 and s.startswith("(") and s.endswith(")")
    if neg:
        s = s[1:-1]
    if fmt == "eu":
        s = s.replace(".", "").replace(",", ".")
    elif fmt == "eu_space":
        s = s.replace(" ", "").replace(",", ".")
    else:
        s = s.replace(",", "")
    s = "".join(ch for ch in s if ch.isdigit() and ch.isascii() or ch in ".-")
    if not s or not re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", s):
        return None
    try:
        v = Decimal(s)
    except InvalidOperation:
        return None
    if neg and v > 0:
        v = -v
    # the parse type keeps 18 decimals (rounded half up), 20 integer digits
    if abs(v) >= Decimal(10) ** 20:
        return None
    with localcontext() as ctx:
        ctx.prec = 60
        return v.quantize(Decimal(1).scaleb(-18), rounding="ROUND_HALF_UP")


def model_description(d):
    d = (d or "").lower()
    d = re.sub(r"\bnull\b", "", d)
    d = re.sub(r"x{10,}\d{4}", "", d)

    def short(m):
        digits = "".join(c for c in m.group(0) if c.isdigit())
        return digits[-4:] if len(digits) >= 4 else m.group(0)
    d = re.sub(r"[x0-9]{7,12}", short, d)
    return re.sub(r"[^a-z0-9]", "", d)


def _amount_texts(rng, n):
    parts = ["1", "23", "456", "7,890", "1.234", ",5", ".", "-", "(", ")", " ", "$", "12.50",
             "1 000", "EUR", " USD", "PLN", "abc", "--", "0", "99,99"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_parse_amount_matches_model(spark):
    rng = random.Random(7)
    vals = _amount_texts(rng, 400)
    for fmt in ["us", "eu", "eu_space"]:
        df = spark.createDataFrame([(v,) for v in vals], "s string")
        got = [r.x for r in df.select(amounts.parse_amount(F.col("s"), fmt).alias("x")).collect()]
        for v, g in zip(vals, got):
            want = model_amount(v, fmt)
            assert (g is None and want is None) or (g is not None and want is not None and g == want), \
                (fmt, v, g, want)


def test_norm_description_matches_model(spark):
    rng = random.Random(11)
    parts = ["PAYMENT", " ", "null", "NULL ", "xxxxxxxxxxxx1234", "X", "x", "0", "12", "345",
             "6789", "ref#", "-", "Nullable", "café", "\t", "1234567890123"]
    vals = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(text.norm_description(F.col("s")).alias("x")).collect()]
    for v, g in zip(vals, got):
        assert g == model_description(v), (v, g)


def test_split_fields_round_trips_csv_writer(spark):
    import csv
    import io
    from tallyframe.sources import statements
    rng = random.Random(3)
    alphabet = ['a', 'B', ' ', ',', ';', '"', '1', '.', '\t', 'é', '']
    lines, want = [], []
    for i in range(300):
        delim = [",", ";", "\t"][i % 3]
        fields = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
                  for _ in range(rng.randint(1, 5))]
        buf = io.StringIO()
        csv.writer(buf, delimiter=delim, lineterminator="", quoting=csv.QUOTE_MINIMAL).writerow(fields)
        lines.append((buf.getvalue(), delim))
        want.append(fields)
    df = spark.createDataFrame(lines, "line string, d string")
    got = [r.f for r in df.select(statements.split_fields(F.col("line"), F.col("d")).alias("f")).collect()]
    for (line, _), w, g in zip(lines, want, got):
        assert g == w, (line, w, g)


def model_date(s):
    import datetime as dt
    for fmt in ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d"]:
        try:
            return dt.datetime.strptime(s, fmt).date()
        except ValueError:
            continue
    return None


def test_parse_date_matches_model(spark):
    from tallyframe.functions import dates
    rng = random.Random(5)
    vals = []
    for _ in range(400):
        a, b, y = rng.randint(0, 35), rng.randint(0, 35), rng.choice([1999, 2024, 2025, 20])
        sep = rng.choice(["-", "/", "."])
        pad = rng.choice([True, False])
        fa, fb = (f"{a:02d}", f"{b:02d}") if pad else (str(a), str(b))
        vals.append(rng.choice([f"{y}{sep}{fa}{sep}{fb}", f"{fa}{sep}{fb}{sep}{y}"]))
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(dates.parse_date(F.col("s")).alias("x")).collect()]
    for v, g in zip(vals, got):
        want = model_date(v) if re.fullmatch(r"[\d/-]+", v) and len(re.findall(r"\d{4}", v)) == 1 else None
        if re.search(r"(^|\D)20(\D|$)", v) and not re.search(r"\d{4}", v):
            want = None   # two-digit years read as null here (kept out of the model)
        assert g == want, (v, g, want)


def model_detect(headers):
    def has(h, pats):
        h = h.lower()
        return any((re.search(rf"\b{p}\b", h) if len(p) <= 2 else p in h) for p in pats)
    from tallyframe.sources import statements as S
    date = next((h for h in headers if has(h, S.DATE_PATTERNS)), None)
    amount = next((h for h in headers if has(h, S.AMOUNT_PATTERNS)), None)
    debit = credit = None
    if amount is None:
        for h in headers:
            if has(h, S.DEBIT_PATTERNS):
                debit = h
            if has(h, S.CREDIT_PATTERNS):
                credit = h
    desc = next((h for h in headers if h != date and has(h, S.DESC_PATTERNS)), None)
    if desc is None:
        desc = next((h for h in headers if h != date and has(h, S.FALLBACK_DESC_PATTERNS)), None)
    return (date, amount, debit, credit, desc)


def test_detect_columns_matches_model(spark):
    from tallyframe.sources import statements as S
    rng = random.Random(9)
    words = ["Date", "Posted", "Txn Date", "Amount", "Amt", "Total", "Debit", "Dr", "Credit", "CR",
             "Deposit", "Withdrawal", "Description", "Memo", "Payee", "Name", "Type", "Ref",
             "Address", "Balance", "Category", "Notes", "dt"]
    files = [(f"f{i}", rng.sample(words, rng.randint(1, 6))) for i in range(200)]
    hdr = spark.createDataFrame(files, "file_id string, header array<string>")
    got = {r.file_id: (r.date, r.amount, r.debit, r.credit, r.description)
           for r in S.detect_columns(hdr).collect()}
    for fid, h in files:
        assert got[fid] == model_detect(h), (h, got[fid])
