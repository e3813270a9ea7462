"""SQL over the ledger (Q1-Q8): views, a read-only guard, parameters,
result encodings and sinks, and extension sessions limited to chosen views."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import trees
from ..functions.trees import items as _seq
from ..operators import views
from ..sources import config, ledger

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
# kinds of parsed nodes that do more than read: commands, writes, scripts
_NOT_READING = ["Command", "ParsedStatement", "InsertIntoDir", "ScriptTransformation"]
# leaves of an analysed plan that read no table
_NO_TABLE = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation"}


class ReadOnlyViolation(ValueError):
    pass


def _parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ReadOnlyViolation(f"not one valid statement: {e}") from e


def check_readonly(spark: SparkSession, sql: str) -> None:
    """Q1: one statement that Spark's parser reads as a query, with no command, write
    or script anywhere in it (so ``select ' UPDATE '`` is accepted, and
    ``WITH x AS (...) INSERT ...`` is not)."""
    _check_reading(spark, _parsed(spark, sql))


def _check_reading(spark: SparkSession, plan) -> None:
    kinds = [(name, spark._jvm.java.lang.Class.forName(_LOGICAL + name)) for name in _NOT_READING]
    todo = [plan]
    while todo:
        node = todo.pop()
        for name, kind in kinds:
            if kind.isInstance(node):
                raise ReadOnlyViolation(f"only queries are allowed, got {node.nodeName()} ({name})")
        todo += _seq(node.children()) + [x for x in _seq(node.innerChildren()) if hasattr(x, "innerChildren")]
        todo += _seq(node.subqueries())


def check_relations(df: DataFrame, allowed: list[str]) -> None:
    """Q7: every relation that the analysed query reads is one of the allowed views."""
    allowed = {a.lower() for a in allowed}
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "View" and node.isTempView():
            name = node.desc().identifier().table()
            if name.lower() not in allowed:
                raise ReadOnlyViolation(f"the view {name} is not allowed")
            continue  # what an allowed view reads is its own matter
        children = _seq(node.children())
        if not children and node.nodeName() not in _NO_TABLE:
            raise ReadOnlyViolation(f"only {', '.join(sorted(allowed))} can be read")
        todo += children + _seq(node.subqueries())


def check_expressions(df: DataFrame) -> None:
    """Q1/Q7: the analysed query computes with Spark's built-in functions alone: no reflection, no user
    functions in Python or on the JVM, no functions that read files named in the text. What stands
    in a registered view is its own matter."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "View" and node.isTempView():
            continue
        for expression in _seq(node.expressions()):
            if name := trees.refused_name(expression):
                raise ReadOnlyViolation(f"the function {name} is not allowed")
        todo += _seq(node.children()) + _seq(node.subqueries())


def register_views(spark: SparkSession, sf_dir: str, names=None) -> list[str]:
    """V1-V5 as temp views: transactions (enriched), accounts, balance_snapshots,
    budget_categories. ``names`` limits which are registered."""
    acc = ledger.accounts(spark, sf_dir)
    frames = {
        "transactions": lambda: views.transactions_view(ledger.transactions(spark, sf_dir), acc),
        "accounts": lambda: acc,
        "balance_snapshots": lambda: views.snapshots_view(ledger.balance_snapshots(spark, sf_dir), acc),
        "budget_categories": lambda: config.categories(spark),
    }
    chosen = list(frames) if names is None else [n for n in names if n in frames]
    for n in chosen:
        frames[n]().createOrReplaceTempView(n)
    return chosen


def parameter(value):
    """Q3: a JSON value as a bound parameter: arrays joined by commas, objects as JSON text."""
    if isinstance(value, (list, tuple)):
        return ",".join(v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for v in value)
    return json.dumps(value, separators=(",", ":")) if isinstance(value, dict) else value


def run_readonly(spark: SparkSession, sql: str, args=None) -> DataFrame:
    """Q1/Q3: guarded read-only SQL; ``args`` binds positional ``?`` markers (see ``parameter``).
    Nothing runs before the analysed query has passed the guard."""
    check_readonly(spark, sql)
    df = spark.sql(sql, args=[parameter(a) for a in args]) if args is not None else spark.sql(sql)
    check_expressions(df)
    return df


@dataclass(frozen=True)
class Written:
    """Q2: what a write makes of a table: its next version, and one row with ``affected_rows``."""
    table: str
    rows: DataFrame
    affected: DataFrame


def run_readwrite(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame | Written:
    """Q2: a query's result, or for one UPDATE, DELETE or INSERT the next version of one of ``tables``.

    Spark parses the statement; its conditions and values become columns over the table, which may
    read other tables and views in subqueries. Nothing is written in place: the caller stores
    ``rows`` (as a new version, or by the partitions it touched). Values are cast as Spark
    stores them (an amount that doesn't fit is an error); rows for which a condition is null stay.
    INSERT OVERWRITE, MERGE, commands and tables not in ``tables`` are refused.
    """
    plan = _parsed(spark, sql)
    kind = trees.class_name(plan).rsplit(".", 1)[-1]
    if kind not in ("UpdateTable", "DeleteFromTable", "InsertIntoStatement"):
        return run_readonly(spark, sql)
    target, alias = plan.table(), None
    if target.nodeName() == "SubqueryAlias":
        target, alias = target.child(), target.alias()
    name = ".".join(_seq(target.multipartIdentifier()))
    known = {n.lower(): n for n in tables}
    if name.lower() not in known:
        raise ReadOnlyViolation(f"{name} cannot be written")
    name = known[name.lower()]
    df = tables[name]
    if kind == "InsertIntoStatement":
        return _inserted(spark, plan, name, df)
    for part in _seq(plan.subqueries()):
        _check_reading(spark, part)
    named = df.alias(alias or name.rsplit(".", 1)[-1])
    condition = plan.condition()
    if kind == "UpdateTable" and condition.isEmpty():
        hit = F.lit(True)
    else:
        condition = condition.get() if kind == "UpdateTable" and condition.isDefined() else condition
        hit = F.coalesce(_column(spark, condition), F.lit(False))
    affected = named.where(hit).agg(F.count("*").alias("affected_rows"))
    if kind == "DeleteFromTable":
        rows = named.where(~hit)
    else:
        new = {}
        types = {f.name.lower(): f for f in df.schema.fields}
        for a in _seq(plan.assignments()):
            column = _seq(a.key().nameParts())[-1].lower()
            if column not in types:
                raise ReadOnlyViolation(f"{name} has no column {column}")
            new[column] = _column(spark, a.value()).cast(types[column].dataType)
        if plan.subqueries().isEmpty():
            rows = named.select(*[F.when(hit, new[c.lower()]).otherwise(F.col(c)).alias(c) if c.lower() in new else F.col(c) for c in df.columns])
        else:
            # Spark joins subqueries of filters: the rows that change and the others are read each for itself
            changed = named.where(hit).select(*[new.get(c.lower(), F.col(c)).alias(c) for c in df.columns])
            rows = changed.union(named.where(~hit).select(*df.columns))
    for result in (rows, affected):
        check_expressions(result)
    return Written(name, rows, affected)


def _column(spark: SparkSession, expression) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _inserted(spark: SparkSession, plan, name: str, df: DataFrame) -> Written:
    if plan.overwrite() or plan.ifPartitionNotExists() or not plan.partitionSpec().isEmpty():
        raise ReadOnlyViolation("INSERT OVERWRITE and INSERT INTO a partition are not supported")
    _check_reading(spark, plan.query())
    new = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query()), spark)
    columns = _seq(plan.userSpecifiedCols()) or (new.columns if plan.byName() else df.columns)
    if len(columns) != len(new.columns) or len({c.lower() for c in columns}) != len(columns):
        raise ReadOnlyViolation(f"{len(new.columns)} values for {len(columns)} columns")
    place = {c.lower(): i for i, c in enumerate(columns)}
    if missing := set(place) - {c.lower() for c in df.columns}:
        raise ReadOnlyViolation(f"{name} has no column {', '.join(sorted(missing))}")
    new = new.toDF(*[f"_{i}" for i in range(len(columns))])
    check_expressions(new)
    aligned = new.select(*[(F.col(f"_{place[f.name.lower()]}") if f.name.lower() in place else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in df.schema.fields])
    return Written(name, df.unionByName(aligned), new.agg(F.count("*").alias("affected_rows")))


class Extension:
    """Q7: queries of one extension, over the views it was allowed and nothing else."""

    def __init__(self, spark: SparkSession, sf_dir: str, allowed: list[str]):
        self._session = spark.newSession()
        self.allowed = register_views(self._session, sf_dir, allowed)

    def query(self, sql: str, args=None) -> DataFrame:
        df = run_readonly(self._session, sql, args)
        check_relations(df, self.allowed)
        return df


def extension_session(spark: SparkSession, sf_dir: str, allowed: list[str]) -> Extension:
    """Q7: an isolated session (same cluster, own temp views) that reads only the
    allowed views; any other view, table or path is refused."""
    return Extension(spark, sf_dir, allowed)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Q8: catalog lookup."""
    return spark.catalog.tableExists(name)


def encoded(column: Column, kind: T.DataType) -> Column:
    """Q4: a value of any type as one that JSON can hold.

    Decimals are numbers, whole ones beyond 18 digits text; NaN and infinities are null; binary
    is told by its size; dates are ISO text, timestamps RFC 3339 with the offset and as many digits
    as needed; an interval has months, days and nanos; arrays, structs and maps (keys as text) hold
    encoded values."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)
    if isinstance(kind, T.DecimalType):
        return column.cast("string" if kind.scale == 0 and kind.precision > 18 else "double")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("<blob "), F.octet_length(column).cast("string"), F.lit(" bytes>"))
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        digits = F.when(F.endswith(text, F.lit(".000000")), 19).when(F.endswith(text, F.lit("000")), 23).otherwise(26)
        offset = F.lit("+00:00") if isinstance(kind, T.TimestampNTZType) else F.date_format(column, "xxx")
        return F.concat(F.substr(text, F.lit(1), digits), offset)
    if isinstance(kind, T.YearMonthIntervalType):
        months = F.extract(F.lit("YEAR"), column) * 12 + F.extract(F.lit("MONTH"), column)
        return F.when(column.isNotNull(), _interval(months, F.lit(0), F.lit(0)))
    if isinstance(kind, T.DayTimeIntervalType):
        column = column.cast("interval day to second")
        seconds = (F.extract(F.lit("HOUR"), column) * 3600 + F.extract(F.lit("MINUTE"), column) * 60 + F.extract(F.lit("SECOND"), column))
        return F.when(column.isNotNull(), _interval(F.lit(0), F.extract(F.lit("DAY"), column), seconds * 1_000_000_000))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: encoded(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[encoded(column.getField(f.name), f.dataType).alias(f.name)
                                                     for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(column, lambda k, _: encoded(k, kind.keyType).cast("string")),
                                  lambda _, v: encoded(v, kind.valueType))
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.NullType, T.VariantType)):
        return column
    return column.cast("string")


def _interval(months: Column, days: Column, nanos: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), nanos.cast("long").alias("nanos"))


def json_column(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Q4: the row as one JSON object; nulls kept as null fields."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[encoded(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns or df.columns]), {"ignoreNullFields": "false"})


def to_json_rows(df: DataFrame) -> DataFrame:
    """Q4 for a whole result."""
    return df.select(json_column(df).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """Q5: CSV with a header; values with a comma, quote or newline quoted,
    quotes doubled; nulls empty."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """Q5: JSON lines, each value as in Q4."""
    df = df.select(*[encoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
