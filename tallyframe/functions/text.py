"""Text normalisers as Column expressions (built-ins only, stay in codegen).

N1 description normaliser, N2 fingerprint, N4 tag normaliser, N11 currency code,
N12 first non-blank, T6 list splitting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical fingerprints.
# Account / phone number runs: 7 to 12 characters of 'x' and ASCII digits.
ACCOUNT_RUN = "[x0-9]{7,12}"
# A card mask: ten or more 'x' followed by four digits.
CARD_MASK = r"(?U)x{10,}\d{4}"
# The literal word null, on word boundaries.
NULL_WORD = r"(?U)\bnull\b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_description(desc) -> Column:
    """Lower-case, drop 'null' words and card masks, shorten number runs
    to their last four digits, keep only [a-z0-9].

    The run replacement is done without a UDF: the text is split on the run
    pattern and zipped with the runs themselves; each run becomes its last four
    digits when it has at least four, else stays as it is.
    """
    a = F.lower(F.coalesce(_col(desc), F.lit("")))
    a = F.regexp_replace(a, NULL_WORD, "")
    a = F.regexp_replace(a, CARD_MASK, "")
    gaps = F.split(a, ACCOUNT_RUN, -1)
    runs = F.regexp_extract_all(a, F.lit(f"({ACCOUNT_RUN})"), 1)

    def glue(gap, run):
        digits = F.regexp_replace(run, "[^0-9]", "")
        repl = (F.when(run.isNull(), F.lit(""))
                .when(F.length(digits) >= 4, F.substring(digits, -4, 4))
                .otherwise(run))
        return F.concat(gap, repl)

    joined = F.array_join(F.zip_with(gaps, runs, glue), "")
    # the lambda runs interpreted per element: only take that path when the
    # text has a run at all
    shortened = F.when(a.rlike(ACCOUNT_RUN), joined).otherwise(a)
    return F.regexp_replace(shortened, "[^a-z0-9]", "")


def amount_text(amount) -> Column:
    """Amount as the fingerprint renders it: two decimals, plain notation."""
    return _col(amount).cast("decimal(15,2)").cast("string")


def fingerprint(account_id, tx_date, amount, description) -> Column:
    """First 16 hex chars of SHA-256 over 'account|YYYY-MM-DD|amount|N1'."""
    payload = F.concat_ws(
        "|",
        F.coalesce(_col(account_id).cast("string"), F.lit("")),
        F.coalesce(F.date_format(_col(tx_date), "yyyy-MM-dd"), F.lit("")),
        F.coalesce(amount_text(amount), F.lit("")),
        norm_description(description),
    )
    return F.substring(F.sha2(payload, 256), 1, 16)


def norm_tags(tags) -> Column:
    """Trim each tag, drop empties, keep the first occurrence of each."""
    trimmed = F.transform(F.coalesce(_col(tags), F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def split_list(text) -> Column:
    """A tag or id list typed as text; newline-separated if it has a
    newline, else comma-separated; items trimmed, empties dropped."""
    t = _col(text)
    parts = F.when(F.instr(t, "\n") > 0, F.split(t, "\r?\n")).otherwise(F.split(t, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def norm_currency(code) -> Column:
    """Trim and upper-case a currency code."""
    return F.upper(F.trim(_col(code)))


def first_non_blank(*cols) -> Column:
    """The first value that is not null and not only whitespace; the value
    returned is the original, untrimmed one."""
    expr = None
    for c in cols:
        c = _col(c)
        cond = F.trim(F.coalesce(c, F.lit(""))) != ""
        expr = F.when(cond, c) if expr is None else expr.when(cond, c)
    return expr
