"""Small user-configuration tables: budget categories, rollovers, account
overrides, auto-tag rules, provider settings.

They are parameters of the jobs (a few rows each, bounded by what a user
configures), written once here as Python rows; ``values_sql`` renders the same
rows for the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators.budget import CATEGORY_SCHEMA, OVERRIDE_SCHEMA, ROLLOVER_SCHEMA

BUDGET_MONTHS = [f"1996-{m:02d}" for m in range(1, 13)]

# (name, type, tags, require_all, amount_sign, expected)
CATEGORY_TEMPLATES = [
    ("urgent-spend", "expense", ["urgent"], False, "negative", Decimal("900000.00")),
    ("high-pending", "expense", ["high", "pending"], True, "negative", Decimal("400000.00")),
    ("income", "income", ["urgent", "high"], False, "positive", Decimal("1500000.00")),
    ("open-orders", "expense", ["open"], False, None, Decimal("2000000.00")),
]


def category_rows():
    rows = []
    for month in BUDGET_MONTHS:
        for i, (name, typ, tags, req, sign, exp) in enumerate(CATEGORY_TEMPLATES):
            rows.append((f"{name}", month, typ, name, exp, tags, req, sign, i))
    return rows


def rollover_rows():
    rows = []
    for i, (a, b) in enumerate(zip(BUDGET_MONTHS, BUDGET_MONTHS[1:])):
        rows.append((f"r{i}", a, "urgent-spend", "urgent-spend", b, Decimal("1000.00") * (i + 1)))
        rows.append((f"s{i}", a, "open-orders", "high-pending", b, Decimal("250.50")))
    return rows


OVERRIDE_ROWS = [("3", "liability", False), ("5", None, True), ("7", "asset", False),
                 ("11", None, True)]

# Auto-tag rules: (rule_id, name, sql_condition, tags, enabled, sort_order).
# Conditions are SQL over the enriched transaction view, valid in both dialects.
RULE_ROWS = [
    ("r1", "urgent", "description ILIKE '%URGENT%'", ["priority"], True, 1),
    ("r2", "large", "amount < -300000", ["large-expense"], True, 2),
    ("r3", "synced income", "source = 'simplefin' AND amount > 0", ["income", "synced"], True, 3),
    ("r4", "review priority", "array_contains(tags, 'priority') AND amount < 0", ["review"], True, 4),
    ("r5", "cards", "account_type = 'credit'", ["card", "priority"], True, 5),
    ("r6", "disabled", "amount > 0", ["never"], False, 6),
    ("r7", "no tags", "amount > 0", [], True, 7),
    ("r8", "broken", "no_such_column > 1", ["broken"], True, 8),
    ("r10", "bad cast", "CAST(description AS INT) > 5", ["broken"], True, 10),
    ("r11", "aggregate", "count(*) > 0", ["broken"], True, 11),
    ("r12", "other aggregate", "max(amount) > 0", ["broken"], True, 12),
    ("r13", "own error", "amount > 0 AND raise_error('no') IS NULL", ["broken"], True, 13),
    ("r14", "other code", "java_method('java.lang.Math', 'abs', 1) = '1'", ["broken"], True, 14),
    ("r9", "cash", "description LIKE 'SIGNUP%' OR description LIKE 'PURCHASE%'", ["cash"], True, 9),
]
# those that are skipped whole (known for the oracle's sake)
BROKEN_RULES = {"r8", "r10", "r11", "r12", "r13", "r14"}
RULE_SCHEMA = ("rule_id string, name string, sql_condition string, tags array<string>, "
               "enabled boolean, sort_order int")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(category_rows(), CATEGORY_SCHEMA)


def rollovers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rollover_rows(), ROLLOVER_SCHEMA)


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDE_ROWS, OVERRIDE_SCHEMA)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_ROWS, RULE_SCHEMA)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, Decimal)):
        return str(v)
    if isinstance(v, list):
        return "CAST([" + ", ".join(_lit(x) for x in v) + "] AS VARCHAR[])"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, schema: str) -> str:
    """rows -> 'SELECT * FROM (VALUES ...) t(cols)' with casts from the schema."""
    cols = [c.strip().split(" ", 1) for c in schema.split(", ")]
    names = [c[0] for c in cols]
    duck_types = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER",
                  "array<string>": "VARCHAR[]"}
    body = ",\n".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(
        f"CAST({n} AS {duck_types.get(t, t.upper())}) AS {n}" for n, t in cols)
    return f"SELECT {casts} FROM (VALUES {body}) t({', '.join(names)})"
