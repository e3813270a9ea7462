"""Work that queries would do more than once, told from their plans and calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import merge
from tallyframe.plans import ingest_queries, sync_queries
from tallyframe.session import apply_conf, kept
from tallyframe.sources import providers, statements


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_statement_line_is_rendered_once_and_not_in_a_filter(spark, sf_small):
    text = optimized(ingest_queries._rows(spark, sf_small))
    steps = [x for x in text.split("\n") if "format_number" in x]
    assert text.count("format_number") < 10  # an amount and a balance, for the headers and for the rows
    assert not any("Join" in x or "Filter" in x for x in steps)
    assert max(len(x) for x in text.split("\n")) < 8000


def test_headers_leave_lines_out_before_the_join(spark):
    lines = spark.createDataFrame([("f", p, "a,b" if p == 1 else "x,y") for p in range(50)] + [("g", 0, "c;d"), ("none", 0, "e")],
                                  "file_id string, pos long, line string")
    man = spark.createDataFrame([("f", 1), ("g", None), ("empty", 9)], "file_id string, skip_rows int")
    hdr = statements.headers(lines, man)
    assert "scalar-subquery" in optimized(hdr)
    assert sorted((r.file_id, r.delimiter, r.header, r.width) for r in hdr.collect()) == [
        ("f", ",", ["a", "b"], 2), ("g", ";", ["c", "d"], 2)]
    assert statements.headers(lines, man.limit(0)).count() == 0


def test_methods_stay_small_enough_for_the_jvm(spark):
    apply_conf(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


@pytest.mark.parametrize("query", ["sync_stats", "sync_end_to_end", "merge_stored"])
def test_payloads_are_parsed_once(spark, sf_small, monkeypatch, query):
    made, parsed = [], providers.parse
    monkeypatch.setattr(providers, "parse", lambda *a: made.append(a) or parsed(*a))
    df = getattr(sync_queries, query)(spark, sf_small)
    assert len(made) == 1 and "from_json" not in optimized(df)


def test_a_stored_merge_makes_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    old = spark.createDataFrame([("a", 1), ("b", 2)], "transaction_id string, amount int")
    path = str(tmp_path / "t")
    merge.store(old, path, "transaction_id", 4)
    batch = spark.createDataFrame([("b", 5), ("c", 6), (None, 7)], old.schema).mapInArrow(passed, old.schema)
    merge.merge_stored(spark, path, 4, old.schema, batch, "transaction_id", merge.TRANSACTION_PRECEDENCE)
    assert seen.value == 3
    assert {r.transaction_id: r.amount for r in merge.stored(spark, path, old.schema).collect()} == {"a": 1, "b": 5, "c": 6, None: 7}


def test_columns_are_detected_without_rendering_lines(spark, sf_small):
    df = ingest_queries.stmt_detect_columns(spark, sf_small)
    assert "format_number" not in optimized(df)
    assert {(r.date, r.amount, r.debit) for r in df.collect()} == {("Date", "Amount", None), ("Posted Date", "Amt", None), (None, None, "Debit")}


def test_lines_are_not_sorted_for_their_headers(spark):
    lines = spark.createDataFrame([("f", 0, "Date,Amount"), ("f", 1, "2020-01-02,1"), ("f", 2, "x,y,z")], "file_id string, pos long, line string")
    man = spark.createDataFrame([("f", 0)], "file_id string, skip_rows int")
    df = statements.ragged_counts(lines, man)
    assert "shuffle_hash" in optimized(df)
    assert [(r.file_id, r.ragged) for r in df.collect()] == [("f", 1)]


def test_quoted_fields_with_and_without_quotes_inside(spark):
    lines = ['"a,b",c', '"",x', '"a""b",c', '"a"b,c', 'a"b,"c"', '"', '"open,x']
    got = (spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string").orderBy("i")
           .select(statements.split_fields(F.col("line"), F.lit(",")).alias("f")).collect())
    assert [r.f for r in got] == [["a,b", "c"], ["", "x"], ['a"b', "c"], ["ab", "c"], ['a"b', "c"], ['"'], ['"open', "x"]]


def test_kept_rows_keep_types_and_are_read_by_column(spark):
    rows = spark.createDataFrame([(1, "x", None), (None, None, [])], "a long, b string, c array<string>")
    once = kept(rows)
    assert once.schema == rows.schema and kept(once) is once
    assert sorted(once.collect(), key=str) == sorted(rows.collect(), key=str)
    assert "ReadSchema: struct<a:bigint>" in once.select("a")._jdf.queryExecution().executedPlan().toString()


def test_distinct_words_by_a_hash_table():
    from tallyframe.llm import wordids
    hashes = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64) << np.uint64(58)
    distinct, first, word = wordids._distinct(hashes)
    assert len(set(distinct.tolist())) == len(distinct)
    assert (distinct[word] == hashes).all()
    assert first.tolist() == [hashes.tolist().index(h) for h in distinct.tolist()]
