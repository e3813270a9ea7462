"""Date and time expressions: N8 statement dates, N13 tolerant timestamps,
N14 end-of-day, N15 epoch window bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement date layouts, tried in this order; the first that
# parses wins (so 03/04/2025 reads month-first).
DATE_LAYOUTS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d"]

# Timestamp layouts accepted on read (RFC 3339 with 'T' or space, optional fraction).
TIMESTAMP_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _shape(layout: str) -> str:
    """A regex that every text the layout can parse must match."""
    out = []
    for ch in layout:
        if ch == "y":
            if not out or out[-1] != r"\d{4}":
                out.append(r"\d{4}")
        elif ch in "Md":
            out.append(r"\d{1,2}")
        else:
            out.append("\\" + ch if ch in "/-." else ch)
    return "^" + "".join(out) + "$"


def parse_date(s, layouts=None) -> Column:
    """First layout that parses, else null (never 'today').

    A layout is only tried on text of its shape: a failed parse is costly (the
    formatter signals it by an exception), a regex test is not.
    """
    c = _col(s)
    return F.coalesce(*[F.when(c.rlike(_shape(fmt)), F.try_to_date(c, fmt))
                        for fmt in (layouts or DATE_LAYOUTS)])


def parse_timestamp(s) -> Column:
    """Tolerant timestamp parse; null on failure."""
    c = F.trim(_col(s))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_LAYOUTS])


def end_of_day(d) -> Column:
    """The last microsecond of a date, as timestamp_ntz."""
    return _col(d).cast("timestamp_ntz") + F.expr("INTERVAL '86399.999999' SECOND")


def epoch_day_start(d) -> Column:
    """Epoch seconds of 00:00:00 UTC of a date."""
    return F.unix_timestamp(_col(d).cast("timestamp"))


def epoch_day_end(d) -> Column:
    """Epoch seconds of 23:59:59 UTC of a date."""
    return F.unix_timestamp(_col(d).cast("timestamp")) + F.lit(86399)
