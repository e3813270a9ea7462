"""Bank-statement CSV ingest (I1-I9, I7, A8, W4, O3) as one distributed job.

Input is a DataFrame of statement lines ``(file_id, pos, line)`` plus a
manifest ``(file_id -> account, mapping, options)``. Lines come either from
files (``read_statement_files``: one row per file with ``wholetext``, split with
``posexplode``; statement files are small, so a file is a sound unit of work)
or from any DataFrame with the same shape (``fixture_lines`` derives them from
``lineitem``).

Everything per row is a built-in expression: the delimiter is detected on the
header line, fields are cut at that delimiter (by a CSV field pattern where the line
has quotes), columns are found by name in the header, and N5/N8/N9 parse the
values. Header facts are one row per file, joined back to the data lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import flip_sign, parse_amount, resolve_debit_credit
from ..functions.dates import end_of_day, parse_date
from ..functions.text import fingerprint
from ..operators.known import may_be_in
from ..session import kept, materialize
from .tables import table

# Header patterns for column auto-detection (lower-case
# substrings; the two-letter ones must be whole words).
DATE_PATTERNS = ["date", "transaction date", "trans date", "txn date", "txndate", "posted",
                 "post date", "dt"]
DESC_PATTERNS = ["description", "desc", "memo", "payee", "merchant", "details", "narration"]
AMOUNT_PATTERNS = ["amount", "amt", "total", "transaction amount"]
DEBIT_PATTERNS = ["debit", "dr", "withdrawal", "debit amount"]
CREDIT_PATTERNS = ["credit", "cr", "deposit", "credit amount"]
FALLBACK_DESC_PATTERNS = ["name", "type", "ref", "reference", "category"]

MANIFEST_SCHEMA = ("file_id string, account_id string, skip_rows int, number_format string, "
                   "date_col string, amount_col string, description_col string, "
                   "debit_col string, credit_col string, balance_col string, "
                   "debit_negative boolean, flip_signs boolean, "
                   "anchor_balance decimal(15,2), anchor_date date")


def _field_pattern(d: str) -> str:
    """One CSV field starting at the line start or right after a delimiter: a quoted
    field with doubled quotes inside (and what follows it), or a run without the
    delimiter, in which a quote is ordinary text. The start is a lookbehind, not a
    consumed delimiter, so an empty first field cannot make the search resume inside a
    quoted field."""
    return f'(?:^|(?<={d}))("(?:[^"]++|"")*+"[^{d}]*+|[^{d}]*+)'


_PATTERNS = {",": _field_pattern(","), ";": _field_pattern(";"), "\t": _field_pattern("\t")}


def _count(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def detect_delimiter(header: Column) -> Column:
    """I3: ';' if it outnumbers both others, else tab if so, else ','."""
    semi, comma, tab = _count(header, ";"), _count(header, ","), _count(header, "\t")
    return (F.when((semi > comma) & (semi > tab), F.lit(";"))
            .when((tab > comma) & (tab > semi), F.lit("\t"))
            .otherwise(F.lit(",")))


def split_fields(line: Column, delim: Column) -> Column:
    """Cut a CSV record into fields; quoted fields are unquoted. Records without a quote,
    nearly all of them, are split at the delimiter."""
    plain = F.when(delim == ";", F.split(line, ";", -1)).when(delim == "\t", F.split(line, "\t", -1)).otherwise(F.split(line, ",", -1))
    quoted = (F.when(delim == ";", F.regexp_extract_all(line, F.lit(_PATTERNS[";"]), 1))
              .when(delim == "\t", F.regexp_extract_all(line, F.lit(_PATTERNS["\t"]), 1))
              .otherwise(F.regexp_extract_all(line, F.lit(_PATTERNS[","]), 1)))
    return F.when(F.instr(line, '"') > 0, F.transform(quoted, _unquote)).otherwise(plain)


def _unquote(f: Column) -> Column:
    """The text of a field; the pattern is only for one with quotes inside or text after them."""
    parts = '(?s)^"((?:[^"]++|"")*+)"(.*)$'
    inner = F.replace(F.regexp_extract(f, parts, 1), F.lit('""'), F.lit('"'))
    closed = (F.length(f) > 1) & (F.locate('"', f, 2) == F.length(f))
    return (F.when(~f.startswith('"'), f)
            .when(closed, F.substring(f, F.lit(2), F.length(f) - 2))
            .when(f.rlike(parts), F.concat(inner, F.regexp_extract(f, parts, 2))).otherwise(f))


def clean_header(fields: Column) -> Column:
    """I4: trim each header, then drop leading '#'."""
    return F.transform(fields, lambda h: F.regexp_replace(F.trim(h), "^#+", ""))


# One CSV record: fields up to a line break (CR LF, CR or LF) or the end of the file. A quote opens a quoted
# field (which may span lines) only where a field starts; elsewhere it is ordinary text.
_FILE_FIELD = r'(?:"(?:[^"]++|"")*+"[^,;\t\r\n]*+|[^,;\t\r\n]*+)'
RECORD = rf'({_FILE_FIELD}(?:[,;\t]{_FILE_FIELD})*+)(?:\r\n|\r|\n|$)'


def read_statement_files(spark: SparkSession, paths, file_id: str = "_metadata.file_path") -> DataFrame:
    """I1 source: statement files -> (file_id, pos, line); ``file_id`` may be a column that the
    folders name. A byte order mark at the start of a file is no text.

    Records are cut with a CSV record pattern rather than at every line break,
    so a quoted field with an embedded newline stays one record.
    """
    raw = spark.read.text(paths, wholetext=True).select(
        F.col(file_id).alias("file_id"), F.regexp_replace("value", "^\\x{feff}", "").alias("value"))
    return raw.select("file_id", F.posexplode(
        F.regexp_extract_all("value", F.lit(RECORD), 1)).alias("pos", "line"))


def headers(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """The header line of each file (after skip_rows lines), its
    delimiter, cleaned names and width. One row per file. Readers that ask something of a
    header keep the headers first: it would else be asked of every line, below the join."""
    skip = F.coalesce(F.col("skip_rows"), F.lit(0))
    # lines below all headers are left out before the join, where they need not be made or shuffled
    first = lines.where(F.col("pos") <= manifest.agg(F.max(skip)).scalar())
    h = (first.join(manifest.select("file_id", "skip_rows"), "file_id")
         .where(F.col("pos") == skip)
         .select("file_id", F.col("line").alias("header_line")))
    delim = detect_delimiter(F.col("header_line"))
    return (h.withColumn("delimiter", delim)
            .withColumn("header", clean_header(split_fields(F.col("header_line"), F.col("delimiter"))))
            .withColumn("width", F.size("header"))
            .drop("header_line"))


def _idx(header: Column, name_col: str) -> Column:
    return F.when(F.col(name_col).isNotNull(),
                  F.array_position(header, F.col(name_col)).cast("int")).otherwise(F.lit(0))


def _field(fields: Column, idx: Column) -> Column:
    # try_: the optimizer may evaluate this before the ragged-row filter
    return F.when(idx > 0, F.try_element_at(fields, F.greatest(idx, F.lit(1))))


def _width(line: Column, fields: Column) -> Column:
    """Fields of a line, null for a blank one. A test of the line alone would go below the join with the
    headers, where every line would be made once more for it."""
    return F.when(F.trim(line) != "", F.size(fields))


def parse_rows(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Typed statement rows, one per data line.

    ``status`` is ok / bad_date / bad_amount; ragged rows (field count differs
    from the header's) are dropped without being counted, as in the reference.
    """
    hdr = materialize(headers(lines, manifest))
    man = manifest.join(hdr, "file_id")
    h = F.col("header")
    man = man.select(
        "file_id", "account_id", "skip_rows", "number_format", "delimiter", "width",
        "debit_negative", "flip_signs", "anchor_balance", "anchor_date",
        _idx(h, "date_col").alias("i_date"),
        _idx(h, "debit_col").alias("i_debit"),
        _idx(h, "credit_col").alias("i_credit"),
        _idx(h, "amount_col").alias("i_amount"),
        _idx(h, "description_col").alias("i_desc"),
        _idx(h, "balance_col").alias("i_balance"),
    )
    data = (lines.join(man.hint("shuffle_hash"), "file_id")  # the lines, far more, are not sorted
            .where(F.col("pos") > F.coalesce(F.col("skip_rows"), F.lit(0)))
            .withColumn("fields", split_fields(F.col("line"), F.col("delimiter")))
            .where(_width(F.col("line"), F.col("fields")) == F.col("width")))
    fields, fmt = F.col("fields"), F.col("number_format")
    # Stage 1: raw field texts (cheap lookups into the field array).
    raw = data.select(
        "file_id", "pos", "account_id", "anchor_balance", "anchor_date", "number_format",
        "debit_negative", "flip_signs",
        ((F.col("i_debit") > 0) | (F.col("i_credit") > 0)).alias("use_dc"),
        _field(fields, F.col("i_date")).alias("s_date"),
        _field(fields, F.col("i_amount")).alias("s_amount"),
        F.nullif(_field(fields, F.col("i_debit")), F.lit("")).alias("s_debit"),
        F.nullif(_field(fields, F.col("i_credit")), F.lit("")).alias("s_credit"),
        _field(fields, F.col("i_balance")).alias("s_balance"),
        _field(fields, F.col("i_desc")).alias("description"))
    # Stage 2: each text parsed once.
    parsed = raw.select(
        "file_id", "pos", "account_id", "anchor_balance", "anchor_date", "description",
        "use_dc", "debit_negative", "flip_signs",
        parse_date(F.coalesce(F.col("s_date"), F.lit(""))).alias("transaction_date"),
        parse_amount(F.coalesce(F.col("s_amount"), F.lit("")), fmt).alias("p_amount"),
        parse_amount(F.col("s_debit"), fmt).alias("p_debit"),
        parse_amount(F.col("s_credit"), fmt).alias("p_credit"),
        parse_amount(F.col("s_balance"), fmt).try_cast("decimal(15,2)").alias("balance"))
    # Stage 3: debit / credit resolution (N9) and sign flip.
    amount = F.when(F.col("use_dc"),
                    resolve_debit_credit("p_debit", "p_credit",
                                         F.coalesce(F.col("debit_negative"), F.lit(False))))\
        .otherwise(F.col("p_amount"))
    typed = parsed.select(
        "file_id", "pos", "account_id", "anchor_balance", "anchor_date", "transaction_date",
        flip_sign(amount, F.coalesce(F.col("flip_signs"), F.lit(False)))
        .try_cast("decimal(15,2)").alias("amount"),
        "description", "balance")
    status = (F.when(F.col("transaction_date").isNull(), F.lit("bad_date"))
              .when(F.col("amount").isNull(), F.lit("bad_amount"))
              .otherwise(F.lit("ok")))
    return typed.withColumn("status", status).withColumn(
        "fingerprint",
        F.when(F.col("status") == "ok",
               fingerprint("account_id", "transaction_date", "amount", "description")))


def ragged_counts(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Data lines whose field count differs from the header width."""
    hdr = materialize(headers(lines, manifest))
    man = manifest.select("file_id", "skip_rows").join(hdr, "file_id")
    return (lines.join(man.hint("shuffle_hash"), "file_id")
            .where(F.col("pos") > F.coalesce(F.col("skip_rows"), F.lit(0)))
            .where(_width(F.col("line"), split_fields(F.col("line"), F.col("delimiter"))) != F.col("width"))
            .groupBy("file_id").agg(F.count(F.lit(1)).alias("ragged")))


def file_errors(lines: DataFrame, manifest: DataFrame, accounts: DataFrame) -> DataFrame:
    """Files that cannot be imported: (file_id, account_id, error)."""
    h = F.col("header")
    has = lambda c: F.coalesce(F.array_contains(h, F.col(c)), F.lit(False))
    known = accounts.select("account_id", F.lit(True).alias("_known"))
    error = (F.when(F.col("_known").isNull(), F.lit("account not found"))
             .when(h.isNull(), F.lit("no header line"))
             .when(~has("date_col"), F.lit("date column not found"))
             .when(~has("amount_col") & ~has("debit_col") & ~has("credit_col"), F.lit("amount column not found")))
    return (manifest.join(known, "account_id", "left").join(headers(lines, manifest), "file_id", "left")
            .select("file_id", "account_id", error.alias("error")).where("error is not null"))


def known_fingerprints(rows: DataFrame, ledger_transactions: DataFrame) -> DataFrame:
    """The ledger's fingerprints that may be among those of the rows; only these are shuffled."""
    known = ledger_transactions.where(F.col("csv_fingerprint").isNotNull()).select(F.col("csv_fingerprint").alias("fingerprint"))
    return may_be_in(known, "fingerprint", rows.where(F.col("status") == "ok")).distinct()


def new_rows(rows: DataFrame, ledger_transactions: DataFrame) -> DataFrame:
    """Ok rows whose fingerprint is not yet in the ledger (any batch,
    deleted rows included) nor in an earlier file of this import, in file order.
    Duplicates inside the same file are all kept."""
    ok = kept(rows).where(F.col("status") == "ok")  # read three times
    existing = known_fingerprints(ok, ledger_transactions)
    first = ok.groupBy("fingerprint").agg(F.min("file_id").alias("first_file"))
    return (ok.join(first, "fingerprint").where(F.col("file_id") == F.col("first_file")).drop("first_file")
            .join(existing, "fingerprint", "left_anti"))


def to_transactions(new: DataFrame, batch_id: str) -> DataFrame:
    """Ledger rows for the new statement rows (ids derived, not random)."""
    tid = F.substring(F.sha2(F.concat_ws("|", F.col("file_id"), F.col("pos").cast("string"),
                                         F.lit(batch_id)), 256), 1, 32)
    return new.select(
        tid.alias("transaction_id"), "account_id", "amount", "description", "transaction_date",
        F.col("transaction_date").alias("posted_date"),
        F.col("fingerprint").alias("csv_fingerprint"),
        F.lit(batch_id).alias("csv_batch_id"),
    )


def import_counts(rows: DataFrame, new: DataFrame, snapshots_created: DataFrame | None = None) -> DataFrame:
    """I8: per file discovered / imported / skipped / fingerprints_checked."""
    per = rows.groupBy("file_id").agg(
        F.count_if(F.col("status") == "ok").alias("discovered"),
        F.count_if(F.col("status") != "ok").alias("bad_rows"))
    imp = new.groupBy("file_id").agg(F.count(F.lit(1)).alias("imported"))
    out = per.join(imp, "file_id", "left").select(
        "file_id", "discovered",
        F.coalesce(F.col("imported"), F.lit(0)).alias("imported"),
        (F.col("bad_rows") + F.col("discovered") - F.coalesce(F.col("imported"), F.lit(0)))
        .alias("skipped"),
        F.col("discovered").alias("fingerprints_checked"))
    if snapshots_created is not None:
        out = out.join(snapshots_created, "file_id", "left").withColumn(
            "snapshots_created", F.coalesce(F.col("snapshots_created"), F.lit(0)))
    return out


def end_of_day_snapshots(rows: DataFrame, existing_snapshots: DataFrame) -> DataFrame:
    """A8 + N14 + J9: per (account, date) the last balance in the order of files and rows,
    stamped 23:59:59.999999, unless the account already has a snapshot that day within
    0.01 of it. `file_id` is the file it comes from."""
    eod = (rows.where((F.col("status") == "ok") & F.col("balance").isNotNull())
           .groupBy("account_id", "transaction_date")
           .agg(F.max_by("balance", F.struct("file_id", "pos")).alias("balance"), F.max("file_id").alias("file_id"))
           .select("file_id", "account_id", F.col("transaction_date").alias("day"), "balance",
                   end_of_day(F.col("transaction_date")).alias("snapshot_time"),
                   F.lit("csv_import").alias("source")))
    ex = existing_snapshots.select(
        "account_id", F.to_date("snapshot_time").alias("day"),
        F.col("balance").alias("existing_balance"))
    cond = ((eod["account_id"] == ex["account_id"]) & (eod["day"] == ex["day"])
            & (F.abs(eod["balance"] - ex["existing_balance"]) < F.lit(0.01).cast("decimal(3,2)")))
    return eod.join(ex, cond, "left_anti")


def _with_running(rows: DataFrame) -> DataFrame:
    """ok rows in preview order (newest day first, file order reversed within a day) with
    preview_rank, n_bal (balances in the file) and running_balance: the anchor less all
    that came after the row, up to the anchor's date.

    Two levels: counts and sums per (file, day) give each day's offsets by a window over the
    days of a file; rows are ordered inside one day alone."""
    ok = kept(rows).where(F.col("status") == "ok")
    counted = F.col("transaction_date") <= F.col("anchor_date")
    amount = F.when(counted, F.col("amount"))
    days = ok.groupBy("file_id", "transaction_date").agg(
        F.count("*").alias("n"), F.count("balance").alias("n_day_bal"), F.sum(amount).alias("day_amount"))
    newer = Window.partitionBy("file_id").orderBy(F.col("transaction_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("file_id", "transaction_date", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("rank_before"),
                       F.coalesce(F.sum("day_amount").over(newer), F.lit(0)).alias("amount_after"),
                       F.sum("n_day_bal").over(Window.partitionBy("file_id")).alias("n_bal"))
    day = Window.partitionBy("file_id", "transaction_date").orderBy(F.col("pos").desc())
    after = F.coalesce(F.sum(amount).over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (ok.withColumn("day_rank", F.row_number().over(day)).withColumn("day_after", after)
            .join(days, ["file_id", "transaction_date"])
            .withColumn("preview_rank", (F.col("rank_before") + F.col("day_rank")).cast("bigint"))
            .withColumn("running_balance", F.when((F.col("n_bal") == 0) & counted, (
                F.col("anchor_balance") - F.col("amount_after") - F.col("day_after")).cast("decimal(18,2)")))
            .select(*rows.columns, "preview_rank", "n_bal", "running_balance"))


def running_balance(rows: DataFrame) -> DataFrame:
    """Per-row balance from the file's anchor, for files with an anchor
    and no balance column values. Rows after the anchor date get null."""
    return (_with_running(rows)
            .where((F.col("n_bal") == 0) & F.col("anchor_balance").isNotNull() & F.col("anchor_date").isNotNull())
            .select("file_id", "pos", "transaction_date", "amount", "running_balance"))


def preview_order(rows: DataFrame) -> DataFrame:
    """O3: newest day first, file order reversed within a day (as a rank)."""
    return _with_running(rows).drop("n_bal", "running_balance")


def preview(rows: DataFrame) -> DataFrame:
    """I1 preview: every ok row in preview order with the balance shown for it,
    the row's own balance, or - for files without any - the running balance
    from the anchor (W4)."""
    return (_with_running(rows)
            .withColumn("balance", F.coalesce(F.col("balance").cast("decimal(18,2)"), F.col("running_balance")))
            .drop("running_balance", "n_bal"))


def _any_contains(h: Column, patterns) -> Column:
    out = None
    for p in patterns:
        c = (h.rlike(rf"\b{p}\b") if len(p) <= 2 else F.instr(h, p) > 0)
        out = c if out is None else (out | c)
    return out


def detect_columns(hdr: DataFrame) -> DataFrame:
    """Guess date / amount / description / debit / credit from headers.

    First matching header wins for date, amount and description (description
    skips the date column, then falls back to a second pattern list); debit and
    credit take the last match and only when no amount column was found.
    Two-letter patterns ('dt', 'dr', 'cr') match whole words only.
    """
    ex = materialize(hdr).select("file_id", F.posexplode("header").alias("hpos", "h")) \
        .withColumn("hl", F.lower("h"))
    w = Window.partitionBy("file_id")
    date_m = _any_contains(F.col("hl"), DATE_PATTERNS)
    ex = ex.withColumn("date_m", date_m)
    ex = ex.withColumn("date_h", F.min_by(F.when(F.col("date_m"), F.col("h")),
                                          F.when(F.col("date_m"), F.col("hpos"))).over(w))
    not_date = F.col("date_h").isNull() | (F.col("h") != F.col("date_h"))

    def first(cond):
        return F.min_by(F.col("h"), F.when(cond, F.col("hpos")))

    def last(cond):
        return F.max_by(F.col("h"), F.when(cond, F.col("hpos")))

    g = ex.groupBy("file_id").agg(
        first(F.col("date_m")).alias("date"),
        first(_any_contains(F.col("hl"), AMOUNT_PATTERNS)).alias("amount"),
        last(_any_contains(F.col("hl"), DEBIT_PATTERNS)).alias("debit_any"),
        last(_any_contains(F.col("hl"), CREDIT_PATTERNS)).alias("credit_any"),
        first(_any_contains(F.col("hl"), DESC_PATTERNS) & not_date).alias("desc1"),
        first(_any_contains(F.col("hl"), FALLBACK_DESC_PATTERNS) & not_date).alias("desc2"),
    )
    return g.select(
        "file_id", "date", "amount",
        F.when(F.col("amount").isNull(), F.col("debit_any")).alias("debit"),
        F.when(F.col("amount").isNull(), F.col("credit_any")).alias("credit"),
        F.coalesce("desc1", "desc2").alias("description"))


# --------------------------------------------------------------------------
# Fixture: statement files derived from lineitem (one file per supplier-year).
# --------------------------------------------------------------------------

FIXTURE_FORMATS = {
    # fmt: (skip, delimiter, header, preamble)
    "us": (0, ",", ["Date", "Description", "Amount"], []),
    "eu": (1, ";", ["Buchungstag", "Verwendungszweck", "Debit", "Credit"], ["Kontoauszug"]),
    "eu_space": (2, "\t", ["#Posted Date", "Memo", "Amt", "Balance"], ["Wyciag", "Rachunek"]),
}


def _fixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    fmt = (F.when(F.col("s_nationkey") < 9, F.lit("us"))
           .when(F.col("s_nationkey") < 17, F.lit("eu")).otherwise(F.lit("eu_space")))
    return s.select("s_suppkey", "s_acctbal", fmt.alias("fmt"),
                    (F.col("s_nationkey") == 3).alias("flip"))


def fixture_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, manifest) of the lineitem statement fixture."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    files = _fixture_files(spark, sf_dir)
    fmt, ln, shown, money, us_amt = (F.col(c) for c in ("fmt", "l_linenumber", "shown", "money", "us_amt"))
    fid = F.concat(F.lit("stmt-"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("year").cast("string"))
    skip = F.when(fmt == "us", 0).when(fmt == "eu", 1).otherwise(2)
    # Line positions only need to order the lines of a file (header at
    # skip_rows, data after it), so they come from the row itself - day, order
    # key, line number - instead of a sort of every file.
    order_key = (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
                 .cast("long") * F.lit(10 ** 13) + F.col("l_orderkey") * 8 + ln)
    base = (F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
            .otherwise(-F.col("l_extendedprice"))).cast("decimal(15,2)")
    # The sign stands apart from the digits in a debit or credit column and in some amounts of "us".
    apart = (fmt == "eu") | ((fmt == "us") & ((ln == 1) | (ln == 3)))
    grouped = F.format_number(F.when(apart, F.abs(shown)).otherwise(shown), 2)
    amounts = F.when(ln == 1, F.when(shown < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money)) \
        .when(ln == 2, F.concat(money, F.lit(" USD"))) \
        .when(ln == 3, F.concat(F.when(shown < 0, "-$").otherwise("$"), money)).otherwise(money)
    # A text that the next step reads more than once is a column of its own, made once: nested, the
    # expression grows past what the JVM compiles.
    rows = (li.join(files, li.l_suppkey == files.s_suppkey)
            .withColumn("shown", F.when(F.col("flip"), -base).otherwise(base))
            .withColumn("money", F.when((fmt != "us") | ln.isin(1, 2, 3), grouped).otherwise(shown.cast("string")))
            .withColumn("us_amt", amounts))
    us_line = F.concat_ws(",",
                          F.when(ln == 7, F.lit("n/a")).otherwise(F.date_format("l_shipdate", "M/d/yyyy")),
                          F.concat(F.lit('"SHIP '), F.col("l_returnflag"), F.col("l_linestatus"),
                                   F.lit(", ORDER "), F.col("l_orderkey").cast("string"), F.lit('"')),
                          F.when(F.instr(us_amt, ",") > 0, F.concat(F.lit('"'), us_amt, F.lit('"')))
                          .otherwise(us_amt))
    eu_money = F.translate(money, ",.", ".,")
    eu_line = F.concat_ws(";",
                          F.date_format("l_shipdate", "yyyy-MM-dd"),
                          F.concat(F.lit("Lieferung "), F.col("l_orderkey").cast("string"), F.lit("/"),
                                   ln.cast("string")),
                          F.when((ln != 7) & (shown < 0), eu_money).otherwise(F.lit("")),
                          F.when((ln != 7) & (shown >= 0), eu_money).otherwise(F.lit("")))
    saldo = F.col("l_quantity").cast("decimal(15,2)") * 100 + F.col("l_extendedprice").cast("decimal(15,2)")
    eus_line = F.concat_ws("\t",
                           F.date_format("l_shipdate", "yyyy/M/d"),
                           F.concat(F.lit("Faktura "), F.col("l_partkey").cast("string"), F.lit(" nr "),
                                    F.col("l_orderkey").cast("string")),
                           F.when(ln == 7, F.lit("abc PLN"))
                           .otherwise(F.concat(F.translate(money, ",.", " ,"), F.lit(" PLN"))),
                           F.translate(F.format_number(saldo.cast("decimal(15,2)"), 2), ",.", " ,"))
    delim = F.when(fmt == "us", F.lit(",")).when(fmt == "eu", F.lit(";")).otherwise(F.lit("\t"))
    ragged = F.when((ln == 6) & (F.col("l_returnflag") == "N"), F.concat(delim, F.lit("extra"))).otherwise(F.lit(""))
    line = F.concat(F.when(fmt == "us", us_line).when(fmt == "eu", eu_line).otherwise(eus_line), ragged)
    data = rows.withColumn("year", F.year("l_shipdate")).select(
        fid.alias("file_id"), (order_key + skip + 1).alias("pos"), line.alias("line"))

    # The files: years of a supplier, told from two columns before the join, and kept for all who read them.
    per_file = materialize(
        li.select("l_suppkey", F.year("l_shipdate").alias("year")).distinct()
        .join(files.distinct(), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(fid.alias("file_id"), "fmt", "s_suppkey", "s_acctbal", "flip", "year"))
    texts = {f: F.array(*[F.lit(t) for t in [*pre, d.join(hdr)]]) for f, (_, d, hdr, pre) in FIXTURE_FORMATS.items()}
    header_lines = per_file.select("file_id", F.posexplode(
        F.when(fmt == "us", texts["us"]).when(fmt == "eu", texts["eu"]).otherwise(texts["eu_space"])).alias("pos", "line"))
    lines = data.unionByName(header_lines.withColumn("pos", F.col("pos").cast("long")))

    manifest = per_file.select(
        "file_id",
        F.col("s_suppkey").cast("string").alias("account_id"),
        F.when(fmt == "us", 0).when(fmt == "eu", 1).otherwise(2).cast("int").alias("skip_rows"),
        fmt.alias("number_format"),
        F.when(fmt == "us", "Date").when(fmt == "eu", "Buchungstag").otherwise("Posted Date")
         .alias("date_col"),
        F.when(fmt == "us", "Amount").when(fmt == "eu", "Betrag").otherwise("Amt").alias("amount_col"),
        F.when(fmt == "us", "Description").when(fmt == "eu", "Verwendungszweck").otherwise("Memo")
         .alias("description_col"),
        F.when(fmt == "eu", F.lit("Debit")).alias("debit_col"),
        F.when(fmt == "eu", F.lit("Credit")).alias("credit_col"),
        F.when(fmt == "eu_space", F.lit("Balance")).alias("balance_col"),
        (fmt == "eu").alias("debit_negative"),
        (F.col("flip") & (fmt == "us")).alias("flip_signs"),
        F.col("s_acctbal").cast("decimal(15,2)").alias("anchor_balance"),
        F.make_date(F.col("year"), F.lit(6), F.lit(30)).alias("anchor_date"),
    )
    return lines, manifest
