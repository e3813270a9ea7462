"""Tag rules against a plain loop; merges; SQL guard and extension sessions."""

from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import functions as F

from tallyframe.operators import merge, tagging, views
from tallyframe.plans import sql
from tallyframe.sources import config, ledger


def _eval(cond, r):
    # the fixture's rule conditions, evaluated in Python for the brute force
    if cond == "description ILIKE '%URGENT%'":
        return "urgent" in (r["description"] or "").lower()
    if cond == "amount < -300000":
        return r["amount"] < -300000
    if cond == "source = 'simplefin' AND amount > 0":
        return r["source"] == "simplefin" and r["amount"] > 0
    if cond == "array_contains(tags, 'priority') AND amount < 0":
        return "priority" in r["tags"] and r["amount"] < 0
    if cond == "account_type = 'credit'":
        return r["account_type"] == "credit"
    if cond == "amount > 0":
        return r["amount"] > 0
    if cond.startswith("description LIKE 'SIGNUP%'"):
        d = r["description"] or ""
        return d.startswith("SIGNUP") or d.startswith("PURCHASE")
    raise KeyError(cond)


def test_auto_tag_and_stats_match_loop(spark, sf_small):
    view = views.transactions_view(ledger.transactions(spark, sf_small), ledger.accounts(spark, sf_small))
    rules = tagging.load_rules(config.rules(spark))
    tagged = {r.transaction_id: (r.tags, r.tags_auto_applied)
              for r in tagging.apply_rules(view, rules).collect()}
    stats = {r.rule_id: r for r in tagging.rule_stats(view, rules).collect()}
    matched = {r.rule_id: 0 for r in rules}
    changed = {r.rule_id: 0 for r in rules}
    for row in view.collect():
        r = row.asDict()
        tags = list(r["tags"] or [])
        start = len(tags)
        for rule in rules:
            if rule.rule_id in config.BROKEN_RULES:
                continue
            r["tags"] = tags
            if _eval(rule.sql_condition, r):
                matched[rule.rule_id] += 1
                add = [t for t in rule.tags if t not in tags]
                if add:
                    changed[rule.rule_id] += 1
                tags = tags + add
        assert tagged[r["transaction_id"]] == (tags, len(tags) > start)
    assert not any(stats[b].valid for b in config.BROKEN_RULES)
    for rid in matched:
        if rid in config.BROKEN_RULES:
            continue
        assert (stats[rid].matched, stats[rid].tagged) == (matched[rid], changed[rid]), rid


def test_tags_are_only_added(spark, sf_small):
    """A rule never removes a tag; a second pass keeps the first pass's
    tags as a prefix (later rules can enable earlier ones, so it may add)."""
    view = views.transactions_view(ledger.transactions(spark, sf_small), ledger.accounts(spark, sf_small))
    rules = tagging.load_rules(config.rules(spark))
    orig = {r.transaction_id: list(r.tags or []) for r in view.collect()}
    once = tagging.apply_rules(view, rules)
    twice = {r.transaction_id: r.tags for r in tagging.apply_rules(once, rules).collect()}
    for r in once.collect():
        assert r.tags[:len(orig[r.transaction_id])] == orig[r.transaction_id]
        assert twice[r.transaction_id][:len(r.tags)] == r.tags


def test_tag_apply_append_replace_and_status(spark):
    tx = spark.createDataFrame([("t1", ["existing"]), ("t2", ["old_tag"])], "transaction_id string, tags array<string>")
    req = spark.createDataFrame([("t1",), ("missing",), ("",)], "transaction_id string")
    upd, status = tagging.tag_apply(tx, req, ["new_tag"])
    assert {r.transaction_id: r.tags for r in upd.collect()}["t1"] == ["existing", "new_tag"]
    assert {r.transaction_id: r.status for r in status.collect()} == \
        {"t1": "ok", "missing": "not_found", "": "invalid"}
    upd, _ = tagging.tag_apply(tx, spark.createDataFrame([("t2",)], "transaction_id string"),
                               ["replacement"], replace=True)
    assert {r.transaction_id: r.tags for r in upd.collect()}["t2"] == ["replacement"]


def test_upsert_precedence(spark):
    existing = spark.createDataFrame(
        [("a1", "Old", "nick", "credit", "USD", "Bank A")],
        "account_id string, name string, nickname string, account_type string, currency string, institution_name string")
    incoming = spark.createDataFrame(
        [("a1", "New", None, "loan", "EUR", None), ("a2", "Fresh", None, None, "USD", "Bank B")],
        "account_id string, name string, nickname string, account_type string, currency string, institution_name string")
    out = {r.account_id: r for r in merge.merge_accounts(existing, incoming).collect()}
    a1 = out["a1"]
    assert (a1.name, a1.nickname, a1.account_type, a1.currency, a1.institution_name) == \
        ("New", "nick", "credit", "EUR", "Bank A")
    assert out["a2"].name == "Fresh"
    again = merge.merge_accounts(merge.merge_accounts(existing, incoming), incoming)
    assert {r.account_id: tuple(r) for r in again.collect()} == {k: tuple(v) for k, v in out.items()}


def test_cascade_delete(spark):
    acc = spark.createDataFrame([("a1",), ("a2",)], "account_id string")
    tx = spark.createDataFrame([("t%d" % i, "a1") for i in range(5)] + [("t9", "a2")],
                               "transaction_id string, account_id string")
    sn = spark.createDataFrame([("s1", "a1"), ("s2", "a2")], "snapshot_id string, account_id string")
    a, t, s = merge.delete_accounts_cascade(acc, tx, sn, spark.createDataFrame([("a1",)], "account_id string"))
    assert [r.account_id for r in a.collect()] == ["a2"]
    assert [r.transaction_id for r in t.collect()] == ["t9"]
    assert [r.snapshot_id for r in s.collect()] == ["s2"]
    a, t, s = merge.delete_accounts_cascade(acc, tx, sn, spark.createDataFrame([("zz",)], "account_id string"))
    assert (a.count(), t.count(), s.count()) == (2, 6, 2)


@pytest.mark.parametrize("text", [
    "SELECT * FROM transactions", "with x as (select 1) select * from x",
    "select ' UPDATE ' as word", "SELECT 1 -- DROP TABLE x\n", "SELECT update FROM t", "SELECT '--' AS c, 1 AS `drop`",
    "VALUES (1)", "SELECT * FROM t WHERE a IN (SELECT delete FROM u);",
])
def test_readonly_accepts(spark, text):
    sql.check_readonly(spark, text)


@pytest.mark.parametrize("text", [
    "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DROP TABLE t", "CREATE TABLE t (a int)",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT 1; DROP TABLE t", "",
    "ALTER TABLE t ADD COLUMN b int", "TRUNCATE TABLE t",
    "WITH x AS (SELECT '--' AS c) INSERT INTO t SELECT c FROM x", "FROM x INSERT INTO t SELECT * INSERT INTO u SELECT *",
    "CREATE TABLE t AS SELECT 1", "SET a = 1", "CACHE TABLE t", "SELECT TRANSFORM(a) USING 'cat' AS b FROM t",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1",
])
def test_readonly_rejects(spark, text):
    with pytest.raises(sql.ReadOnlyViolation):
        sql.check_readonly(spark, text)


def test_extension_session_sees_only_allowed_views(spark, sf_small):
    ext = sql.extension_session(spark, sf_small, ["accounts"])
    assert ext.query("SELECT count(*) AS n FROM accounts").first().n > 0
    assert ext.query("WITH a AS (SELECT account_id FROM accounts) SELECT count(*) AS n FROM a, (SELECT 1) x "
                     "WHERE account_id IN (SELECT account_id FROM accounts)").first().n > 0
    spark.range(3).write.mode("overwrite").saveAsTable("other_table")
    for text in ["SELECT * FROM balance_snapshots", f"SELECT count(*) FROM parquet.`{sf_small}/customer.parquet`",
                 "SELECT * FROM other_table", "SELECT 1 WHERE 1 IN (SELECT id FROM other_table)",
                 "SELECT (SELECT max(id) FROM other_table) FROM accounts", "WITH accounts AS (SELECT * FROM other_table) SELECT * FROM accounts",
                 "INSERT INTO other_table SELECT 1"]:
        with pytest.raises((sql.ReadOnlyViolation, AnalysisException)):
            ext.query(text)
    spark.sql("DROP TABLE other_table")


def test_params_bind_values(spark, sf_small):
    sql.register_views(spark, sf_small)
    df = sql.run_readonly(spark, "SELECT count(*) AS n FROM transactions WHERE amount > ? AND source = ?",
                          [0, "manual"])
    n = df.first().n
    want = views.transactions_view(ledger.transactions(spark, sf_small), ledger.accounts(spark, sf_small)) \
        .where((F.col("amount") > 0) & (F.col("source") == "manual")).count()
    assert n == want
    assert sql.table_exists(spark, "transactions")


def test_update_snapshots(spark):
    sn = spark.createDataFrame([("s1", Decimal("1.00"), "sync"), ("s2", Decimal("2.00"), "manual")],
                               "snapshot_id string, balance decimal(15,2), source string")
    ch = spark.createDataFrame([("s1", Decimal("5.00"), None)], "snapshot_id string, balance decimal(15,2), source string")
    out = {r.snapshot_id: (r.balance, r.source) for r in merge.update_snapshots(sn, ch).collect()}
    assert out == {"s1": (Decimal("5.00"), "sync"), "s2": (Decimal("2.00"), "manual")}


def test_rule_with_failing_cast_is_skipped(spark):
    view = spark.createDataFrame([("t1", "abc", ["x"]), ("t2", "12", [])],
                                 "transaction_id string, description string, tags array<string>")
    rules = [tagging.Rule("a", "bad cast", "CAST(description AS INT) > 5", ("n",), True, 1),
             tagging.Rule("b", "safe", "try_cast(description AS INT) > 5", ("big",), True, 2)]
    ok, bad = tagging.valid_rules(view, rules)
    assert [r.rule_id for r in ok] == ["b"] and [r.rule_id for r in bad] == ["a"]
    out = {r.transaction_id: r.tags for r in tagging.apply_rules(view, rules).collect()}
    assert out == {"t1": ["x"], "t2": ["big"]}


def test_rules_with_bad_values_are_skipped_whole(spark):
    view = spark.createDataFrame([("t1", "abc", 0, ["x"]), ("t2", "12", 3, None)],
                                 "transaction_id string, description string, n int, tags array<string>")
    conditions = {"implicit": "description > 5", "division": "10 / n > 1", "element": "tags[3] = 'x'", "missing": "nothing = 1",
                  "syntax": "n >", "safe": "n > 1", "after": "array_contains(tags, 'safe')"}
    rules = [tagging.Rule(k, k, c, (k,), True, i) for i, (k, c) in enumerate(conditions.items())]
    ok, bad = tagging.valid_rules(view, rules)
    assert [r.rule_id for r in ok] == ["safe", "after"] and len(bad) == 5
    out = {r.transaction_id: r.tags for r in tagging.apply_rules(view, rules).collect()}
    assert out == {"t1": ["x"], "t2": ["safe", "after"]}
    stats = {r.rule_id: (r.valid, r.matched, r.tagged) for r in tagging.rule_stats(view, rules).collect()}
    assert stats["safe"] == (True, 1, 1) and stats["after"] == (True, 1, 1) and stats["division"] == (False, 0, 0)


def test_long_rule_lists(spark):
    view = spark.createDataFrame([("t1", 7, ["x", "x"]), ("t2", 120, [])], "transaction_id string, n int, tags array<string>")
    rules = [tagging.Rule(f"r{i:03}", "", f"n >= {i}" if i % 40 else f"array_contains(tags, 'g{i - 1}')", (f"g{i}", "x"), True, i)
             for i in range(1, 121)]
    out = {r.transaction_id: r.tags for r in tagging.apply_rules(view, rules).collect()}
    assert out["t1"] == ["x", "x", *[f"g{i}" for i in range(1, 8)]]
    assert sorted(out["t2"]) == sorted(["x", *[f"g{i}" for i in range(1, 121)]])


def test_errors_of_the_session_stay_readable(spark):
    tagging.valid_rules(spark.range(1).selectExpr("id", "array('a') AS tags"), [tagging.Rule("a", "a", "nope = 1", ("n",), True, 1)])
    with pytest.raises(ArithmeticException):
        spark.sql("SELECT 1 / id FROM range(2)").collect()


def test_rules_that_would_kill_the_job_are_skipped(spark):
    view = spark.createDataFrame([("t1", "abc", 1, ["x"]), ("t2", "12", 3, None)],
                                 "transaction_id string, description string, n int, tags array<string>")
    conditions = {"count": "count(*) > 0", "max": "max(n) > 0", "window": "row_number() OVER (ORDER BY n) > 1", "explode": "explode(tags) = 'x'",
                  "own": "raise_error('x')", "own where": "n > 2 AND raise_error('x') IS NULL", "assert": "assert_true(n > 1) IS NULL",
                  "reflection": "java_method('java.lang.Math', 'abs', 1) = '1'", "shared 1": "CAST(description AS INT) > 5",
                  "shared 2": "CAST(description AS INT) < 5", "late": "array_contains(tags, 'shared 1')", "safe": "n > 1",
                  "index": "tags[9] = 'x' AND array_contains(tags, 'shared 1')", "tags": "element_at(tags, 2) = 'safe'"}
    rules = [tagging.Rule(k, k, c, (k,), True, i) for i, (k, c) in enumerate(conditions.items())]
    good, _ = tagging.valid_rules(view, rules)
    assert [r.rule_id for r in good] == ["late", "safe"]
    out = {r.transaction_id: r.tags for r in tagging.apply_rules(view, rules).collect()}
    assert out == {"t1": ["x"], "t2": ["safe"]}
    some = spark.createDataFrame([("t2",)], "transaction_id string")
    # only the rows asked for count
    found = {r.rule_id for r in tagging.rules_match(view, some, rules).collect()}
    assert found == {"assert", "shared 1", "safe"}


def test_rules_that_cannot_fail_need_no_scan(spark, monkeypatch):
    view = spark.createDataFrame([("t1", "abc", Decimal("1.00"), ["x"])], "transaction_id string, description string, amount decimal(15,2), tags array<string>")
    rules = [tagging.Rule(str(i), "", c, ("y",), True, i) for i, c in enumerate(
        ["description ILIKE '%X%'", "amount < -300000", "description = 'a' AND amount > 0", "array_contains(tags, 'x') OR size(tags) > 3"])]
    monkeypatch.setattr(tagging, "_attempt", None)
    assert tagging.valid_rules(view, rules) == (rules, [])


REFLECTING = ["SELECT java_method('java.lang.System','setProperty','tally.x','hit')", "SELECT try_reflect('java.lang.System','getProperty','user.dir')",
              "SELECT 1 WHERE reflect('java.lang.System','getProperty','user.dir') = 'x'",
              "SELECT a FROM (SELECT transform(array(1), x -> java_method('java.lang.Math','abs',x)) AS a)",
              "SELECT (SELECT first(a) FROM (SELECT reflect('java.lang.System','getProperty','user.dir') AS a))",
              "SELECT 1 ORDER BY java_method('java.lang.System','setProperty','tally.x','hit')", "SELECT judge_udf('x')"]


@pytest.mark.parametrize("text", REFLECTING)
def test_guard_refuses_other_code(spark, sf_small, text):
    session = spark.newSession()
    session.udf.register("judge_udf", lambda x: x)
    with pytest.raises(sql.ReadOnlyViolation):
        sql.run_readonly(session, text)
    ext = sql.extension_session(spark, sf_small, ["transactions"])
    with pytest.raises((sql.ReadOnlyViolation, AnalysisException)):
        ext.query(text)
    assert spark._jvm.java.lang.System.getProperty("tally.x") is None


def test_guard_accepts_built_in_functions(spark):
    text = ("SELECT to_json(named_struct('a', 1)) AS j, date_format(DATE '2024-01-02', 'yyyy') AS y, explode(array(1, 2)) AS e, "
            "percentile_approx(1, 0.5) OVER () AS p, aggregate(array(1, 2), 0, (a, x) -> a + x) AS s, (SELECT max(id) FROM range(3)) AS m")
    assert [tuple(r) for r in sql.run_readonly(spark, text).collect()] == [('{"a":1}', "2024", e, 1, 3, 2) for e in (1, 2)]


@pytest.fixture()
def small_table(spark):
    spark.createDataFrame([("a",), ("c",)], "k string").createOrReplaceTempView("ks")
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (3, "c", 5.0)], "id int, k string, v double")


@pytest.mark.parametrize("text, affected, rows", [
    ("UPDATE t SET v = v * 2, k = 'z' WHERE k IN (SELECT k FROM ks)", 2, [(1, "z", 20.0), (2, "b", None), (3, "z", 10.0)]),
    ("UPDATE t x SET x.v = id WHERE x.v IS NULL", 1, [(1, "a", 10.0), (2, "b", 2.0), (3, "c", 5.0)]),
    ("UPDATE t SET v = 0", 3, [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)]),
    ("UPDATE T SET V = (SELECT count(*) FROM ks) WHERE id = 1", 1, [(1, "a", 2.0), (2, "b", None), (3, "c", 5.0)]),
    ("DELETE FROM t WHERE v > 6", 1, [(2, "b", None), (3, "c", 5.0)]),
    ("DELETE FROM t WHERE NOT EXISTS (SELECT 1 FROM ks WHERE ks.k = t.k)", 1, [(1, "a", 10.0), (3, "c", 5.0)]),
    ("DELETE FROM t", 3, []),
    ("INSERT INTO t VALUES (4, 'd', 1.5)", 1, [(1, "a", 10.0), (2, "b", None), (3, "c", 5.0), (4, "d", 1.5)]),
    ("INSERT INTO t (k, id) SELECT k, 9 FROM ks WHERE k = 'a'", 1, [(1, "a", 10.0), (2, "b", None), (3, "c", 5.0), (9, "a", None)]),
    ("INSERT INTO t BY NAME SELECT 7 AS id", 1, [(1, "a", 10.0), (2, "b", None), (3, "c", 5.0), (7, None, None)]),
])
def test_writes(spark, small_table, text, affected, rows):
    out = sql.run_readwrite(spark, text, {"t": small_table})
    assert out.table == "t" and out.affected.collect()[0].affected_rows == affected
    assert out.rows.schema == small_table.schema or [f.dataType for f in out.rows.schema] == [f.dataType for f in small_table.schema]
    assert sorted((tuple(r) for r in out.rows.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("text", [
    "UPDATE u SET v = 1", "UPDATE t SET q = 1", "DELETE FROM ks", "INSERT OVERWRITE t SELECT 1, 'a', 1.0", "INSERT INTO t SELECT 1",
    "INSERT INTO t (id, nope) SELECT 1, 2", "MERGE INTO t USING ks ON t.k = ks.k WHEN MATCHED THEN DELETE", "DROP TABLE t", "CREATE TABLE x (a int)",
    "UPDATE t SET k = java_method('java.lang.System','setProperty','tally.x','hit')", "DELETE FROM t WHERE reflect('java.lang.Math','abs',1) = '1'",
    "UPDATE t SET v = 1; DROP TABLE t",
])
def test_writes_refused(spark, small_table, text):
    with pytest.raises(sql.ReadOnlyViolation):
        sql.run_readwrite(spark, text, {"t": small_table})


def test_reads_pass_through_readwrite(spark, small_table):
    assert sql.run_readwrite(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a", {"t": small_table}).first().x == 1


def test_every_type_has_json(spark):
    df = spark.sql("""SELECT timestamp'2024-01-01 00:00:00' t, timestamp'2024-01-01 00:00:00.5' t2, timestamp_ntz'2024-01-01 00:00:00.000001' n,
      interval '1-2' year to month y, interval '-1 02:03:04.5' day to second z, interval '5' hour h, map(1, x'01') m, x'0102' b,
      cast(1 as decimal(38,0)) w, cast(1.25 as decimal(10,2)) d, double('NaN') nan, float('Infinity') inf, named_struct('a', array(date'2024-01-01'), 'b.c', null) s,
      null nn, true bo, cast(null as struct<a:int>) ns, cast(null as interval day) ni, cast(null as binary) nb, array(array(x'', null)) aa""")
    assert sql.to_json_rows(df).first().json == (
        '{"t":"2024-01-01T00:00:00+00:00","t2":"2024-01-01T00:00:00.500+00:00","n":"2024-01-01T00:00:00.000001+00:00",'
        '"y":{"months":14,"days":0,"nanos":0},"z":{"months":0,"days":-1,"nanos":-7384500000000},"h":{"months":0,"days":0,"nanos":18000000000000},'
        '"m":{"1":"<blob 1 bytes>"},"b":"<blob 2 bytes>","w":"1","d":1.25,"nan":null,"inf":null,"s":{"a":["2024-01-01"],"b.c":null},'
        '"nn":null,"bo":true,"ns":null,"ni":null,"nb":null,"aa":[["<blob 0 bytes>",null]]}')


def test_parameters_as_values():
    assert [sql.parameter(v) for v in (["a", 1, None, True], {"a": [1]}, "x", 2.5, None)] == ["a,1,null,true", '{"a":[1]}', "x", 2.5, None]



@pytest.mark.parametrize("text", ["SELECT account_id, count(*) AS n FROM transactions GROUP BY account_id HAVING count(*) > 12",
                                  "SELECT account_id, sum(amount) AS n FROM transactions GROUP BY account_id"])
def test_a_hot_account_is_split_under_an_aggregate(spark, sf_small, text):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    acc = ledger.accounts(session, sf_small)
    views.transactions_view(ledger.transactions(session, sf_small), acc).createOrReplaceTempView("transactions")
    # the account's name is used, so the join stays
    text = text.replace("account_id,", "account_id, max(account_name) AS name,")
    plan = session.sql(text)._jdf.queryExecution().executedPlan().toString()
    kinds = [k for line in plan.split("\n") for k in ("HashAggregate", "SortAggregate", "Exchange hashpartitioning", "SortMergeJoin") if k in line]
    # from the top: the final aggregate, an exchange, the partial one, and only then the join
    assert kinds[:4] == ["SortAggregate", "Exchange hashpartitioning", "SortAggregate", "SortMergeJoin"] or \
        kinds[:4] == ["HashAggregate", "Exchange hashpartitioning", "HashAggregate", "SortMergeJoin"], plan
    assert "_salt" in plan


def test_salted_join_equals_a_plain_one(spark, sf_small):
    tx, acc = ledger.transactions(spark, sf_small), ledger.accounts(spark, sf_small)
    named = acc.select("account_id", F.col("name").alias("account_name"))
    got = views.transactions_view(tx, acc).select("transaction_id", "account_id", "account_name")
    want = views.active(tx).join(named, "account_id", "left").select("transaction_id", "account_id", "account_name")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
