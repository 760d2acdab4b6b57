"""Rules, quality, readiness, hierarchies, charts, cubes and whole runs."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pytest

from tablelens.errors import ProfileError
from tablelens.operators import charts, cubes, hierarchy, quality, rules
from tablelens.plans.run import run
from tablelens.sources.results import list_suggestions, read_result, record_status, run_states, write_result
from tablelens.sources.tables import check_domain, check_file_sizes, check_table, read_csv, read_table


def results(df, *specs, **roles):
    found = rules.evaluate_rules(df, [{"rule_key": str(i), **s} for i, s in enumerate(specs)], roles).orderBy("ord").collect()
    return [(r.records_checked, r.pass_count, r.fail_count, r.score) for r in found]


def test_rules(spark):
    df = spark.createDataFrame(
        [("1", "5", "2024-01-02", "2024-01-01", "on"), ("2", "x", "2024-01-02", "2024-01-03", None),
         ("2", None, "2024-01-03", "2024-01-03", "off"), (None, "0", None, "2024-01-03", "on"), ("3", "7", "bad", None, None)],
        "id string, n string, a string, b string, s string")
    got = results(
        df,
        dict(type="non_null", target_column="n"),
        dict(type="expected_unique", target_column="id"),
        dict(type="regex_match", target_column="s", pattern="o"),
        dict(type="allowed_values", target_column="s", values=["on"]),
        dict(type="numeric_range", target_column="n", min_value=0, inclusive_min=False, max_value=7),
        dict(type="column_comparison", left_column="a", right_column="b", operator=">="),
        dict(type="conditional_required", condition_column="id", condition_value=2, required_column="n"),
        dict(type="date_range", target_column="a", min_date="2024-01-03"),
        dict(type="cross_field_equality", left_column="a", right_column="b"),
        dict(type="cross_field_inequality", left_column="a", right_column="b"),
        dict(type="regex_match", target_role="kind", pattern="on"),
        dict(type="allowed_values", target_column="s", values=[], active=False),
        kind="s",
    )
    assert got == [
        (5, 4, 1, 0.8), (5, 4, 1, 0.8), (3, 3, 0, 1.0), (3, 2, 1, pytest.approx(2 / 3)), (3, 2, 1, pytest.approx(2 / 3)),
        (3, 2, 1, pytest.approx(2 / 3)), (2, 1, 1, 0.5), (3, 1, 2, pytest.approx(1 / 3)), (3, 1, 2, pytest.approx(1 / 3)),
        (3, 2, 1, pytest.approx(2 / 3)), (3, 2, 1, pytest.approx(2 / 3)),
    ]


def test_value_lists(spark):
    """Tables as lists: long values by their whole text, nulls, repeats, numbers, an empty list, a column twice."""
    long = "x" * 300
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, None), (long + "1", 2.0), (long + "2", float("nan"))], "s string, n double")
    texts = spark.createDataFrame([("a", 2), ("a", None), (None, 2), (long + "2", 1), (long, 3)], "t string, k int")
    specs = [
        {"target_column": "s", "values_from": "texts"}, {"target_column": "n", "values_from": "doubles"},
        {"target_column": "s", "values_from": "none"}, {"target_column": "s", "values": [str(i) for i in range(2000)] + ["b"]},
        {"target_column": "s", "values_from": "texts", "values_column": "k"}, {"target_column": "zz", "values_from": "texts"},
        {"target_column": "s", "values_from": "absent"},
    ]
    lists = {"texts": texts, "none": texts.where("false"), "doubles": texts.selectExpr("double(k)")}
    found = rules.evaluate_rules(df, [{"rule_key": str(i), "type": "allowed_values", **s} for i, s in enumerate(specs)]
                                 + [{"rule_key": "once", "type": "expected_unique", "target_column": "s"}], value_lists=lists)
    got = [(r.records_checked, r.pass_count, r.error is None) for r in found.orderBy("ord").collect()]
    assert got == [(4, 2, True), (3, 3, True), (4, 0, True), (4, 1, True), (4, 0, True), (0, 0, False), (0, 0, False), (5, 5, True)]
    empty = rules.evaluate_rules(df.where("false"), [{"rule_key": "e", "type": "allowed_values", **specs[0]}], value_lists=lists).first()
    assert (empty.records_checked, empty.score) == (0, 1.0)


def test_value_list_of_a_table_stays_out_of_the_plan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    wanted = spark.range(0, 300_000, 3)
    found = rules.evaluate_rules(orders, [
        {"rule_key": "listed", "type": "allowed_values", "target_column": "o_orderkey", "values_from": "keys"},
        {"rule_key": "given", "type": "allowed_values", "target_column": "o_orderkey", "values": list(range(0, 300_000, 3))},
        {"rule_key": "once", "type": "expected_unique", "target_column": "o_orderkey"}], value_lists={"keys": wanted})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # lists and uniqueness read one shuffle of one scan
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 1 and "29997" not in plan
    rows = {r.rule_key: (r.records_checked, r.pass_count) for r in found.collect()}
    expected = orders.selectExpr("count(*)", "count_if(o_orderkey % 3 = 0 AND o_orderkey < 300000)").first()
    assert rows["listed"] == rows["given"] == tuple(expected)


def test_rule_errors_and_nothing_to_check(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    found = rules.evaluate_rules(df, [
        {"rule_key": "a", "type": "non_null", "target_column": "zz"},
        {"rule_key": "b", "type": "regex_match", "target_column": "s", "pattern": "x"},
        {"rule_key": "c", "type": "regex_match", "target_column": "s"},
    ]).orderBy("ord").collect()
    assert [(r.score, r.error is None) for r in found] == [(0.0, False), (1.0, True), (0.0, False)]


def test_rule_loading():
    assert [r["rule_key"] for r in rules.domain_rules("Payments")] == ["settlement_after_authorization", "amount_positive"]
    kept = rules.request_rules([{"type": "non_null"}, {"type": "nonsense"}, {"type": "regex_match"}])
    assert [r["rule_key"] for r in kept] == ["request_rule_0", "request_rule_1"]


def test_review(spark):
    suggestions = spark.createDataFrame([(1, "proposed"), (2, "proposed"), (3, "approved")], "suggestion_id int, status string")
    reviews = spark.createDataFrame([(1, "approve", "fine"), (3, "reject", "no"), (9, "approve", "?")],
                                    "suggestion_id int, action string, comment string")
    reviewed, refused = rules.review_suggestions(suggestions, reviews)
    assert {r.suggestion_id: r.status for r in reviewed.collect()} == {1: "approved", 2: "proposed", 3: "approved"}
    assert {(r.suggestion_id, r.code) for r in refused.collect()} == {
        (3, "INVALID_RULE_TRANSITION"), (9, "RULE_SUGGESTION_NOT_FOUND")}
    assert list_suggestions(reviewed, status="approved").count() == 2


def test_first_review_decides(spark):
    suggestions = spark.createDataFrame([(1, "proposed"), (2, "proposed")], "suggestion_id int, status string")
    reviews = spark.createDataFrame(
        [(1, "approve", "late", 5), (1, "reject", "early", 3), (2, "undo", "no such", 1), (2, "approve", "yes", 2),
         (2, "approve", "yes", 2)], "suggestion_id int, action string, comment string, at int")
    reviewed, refused = rules.review_suggestions(suggestions, reviews, "at")
    assert {(r.suggestion_id, r.status, r.comment, r.rejection_reason) for r in reviewed.collect()} == {
        (1, "rejected", None, "early"), (2, "approved", "yes", None)}
    assert sorted((r.suggestion_id, r.status, r.action) for r in refused.collect()) == [
        (1, "rejected", "approve"), (2, "approved", "approve"), (2, "approved", "undo")]


def test_two_digit_years(spark):
    from tablelens.functions.parsing import timestamp

    df = spark.createDataFrame([("12/31/99",), ("1/2/69",), ("1/2/68",)], "t string")
    assert [str(r.d) for r in df.select(timestamp("t").cast("date").alias("d")).collect()] == ["1999-12-31", "1969-01-02", "2068-01-02"]


def test_a_digest_is_no_copy_of_its_text(spark):
    from tablelens.operators.dataset import duplicate_rows

    text = "x" * 100
    df = spark.createDataFrame([(text,), (hashlib.sha256(text.encode()).hexdigest(),)], "t string")
    assert duplicate_rows(df).first().duplicate_row_count == 0


def test_newest_state_and_rewritten_rows(spark):
    root = tempfile.mkdtemp(prefix="tablelens-test-")
    for status in ("processing", "failed", "processing", "completed"):
        record_status(spark, root, "r1", status, "Payments", error_message="e" * 3000 if status == "failed" else None)
    assert run_states(spark, root, "r1").first().status == "completed"
    failed = read_result(spark, root, "runs").where("status = 'failed'").first()
    assert len(failed.error_message) == 3000
    record_status(spark, root, "r2", "completed", "Payments")
    for _ in range(2):
        write_result(spark.range(3), root, "column_profiles", "r1")
        write_result(spark.range(2), root, "column_profiles", "r2")
    assert read_result(spark, root, "column_profiles").groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 3), ("r2", 2)]


def test_csv_is_split(spark):
    path = f"{tempfile.mkdtemp(prefix='tablelens-test-')}/long.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,note\n" + "".join(f"{i},some text of a line\n" for i in range(20000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_overall_score_skips_what_is_unknown(spark):
    dims = spark.createDataFrame(
        [("d", 1, "completeness", 1.0, "assessed"), ("d", 3, "validity", 0.5, "assessed"), ("d", 9, "accuracy", None, "not_assessable")],
        "dataset string, ord int, dimension string, score double, status string")
    row = quality.overall_quality(dims).first()
    assert row.overall_score == pytest.approx(round((0.2 + 0.075) / 0.35, 4)) and row.display_score == 78.57
    assert (row.assessed_dimensions, row.excluded_dimensions) == (["completeness", "validity"], ["accuracy"])


def edge(df, parent="p", child="c"):
    return hierarchy.validate_edges(df, [(parent, child)]).first()


def test_functional_dependency(spark):
    clean = [(f"p{i % 3}", f"c{i}") for i in range(90)]
    shared = [(p, f"s{i}") for i in range(5) for p in ("p0", "p1")]
    row = edge(spark.createDataFrame(clean + shared, "p string, c string"))
    assert (row.distinct_child_count, row.violating_child_count, row.status) == (95, 5, "retained_with_warning")
    holes = [("p", f"c{i}") for i in range(8)] + [(None, "c8"), (None, "c9"), ("p", None)]
    row = edge(spark.createDataFrame(holes, "p string, c string"))
    assert (row.mapping_coverage, row.fd_consistency, row.status) == (0.8, 1.0, "rejected")
    row = edge(spark.createDataFrame([("p", None)], "p string, c string"))
    assert (row.distinct_child_count, row.fd_consistency, row.edge_confidence, row.status) == (0, 1.0, 0.0, "rejected")


def test_conflicts_are_bounded(spark):
    df = spark.range(2000).selectExpr("string(id % 50) AS p", "string(id % 8) AS c")
    found = hierarchy.edge_conflicts(df, [("p", "c")]).orderBy("rn").collect()
    assert [r.child_value for r in found] == ["0", "1", "2", "3", "4"]
    assert all(len(r.parent_values) == 5 for r in found) and found[0].parent_count == 25


def test_longest_segment(spark):
    rows = [(f"a{i % 2}", f"b{i % 7}", f"c{i % 5}", f"d{i}", f"e{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    row = hierarchy.select_chain(df, [("five", list("abcde")), ("two", ["d", "e"])]).first()
    assert (row.template_key, row.level_columns, row.edge_count, row.rejected_edge_count) == ("five", ["c", "d", "e"], 2, 2)
    assert hierarchy.select_chain(df, [("bad", ["a", "b"])]).first()["status"] == "unresolved"
    assert hierarchy.select_chain(df, [("one", ["a"])]).first()["level_columns"] == []


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0] * 30, [5.0, 5.0], list(np.linspace(-3, 7, 333))])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    counts, edges = np.histogram(values, bins=min(20, max(5, len(values) // 10)))
    got = charts.histogram(df, "x").orderBy("position").collect()
    assert [r.value for r in got] == list(counts)
    assert [r.label for r in got] == [f"{a:.1f}-{b:.1f}" for a, b in zip(edges, edges[1:])]
    assert charts.histogram(df.where("x IS NULL"), "x").count() == 0


def test_charts(spark):
    df = spark.createDataFrame(
        [("a", "1", "2024-01-05"), ("a", "x", "2024-03-05"), ("b", None, "bad"), (None, "9", "2024-01-09"), ("c", "5", None)],
        "k string, n string, t string")
    def pairs(d):
        return [(r.label, r.value) for r in d.orderBy("position").collect()]
    assert pairs(charts.category_values(df, "k", "n", "sum")) == [("c", 5.0), ("a", 1.0), ("b", 0.0)]
    assert pairs(charts.category_values(df, "k", "n", "mean")) == [("c", 5.0), ("a", 1.0), ("b", 0.0)]
    assert pairs(charts.category_values(df, "k")) == [("a", 2.0), ("b", 1.0), ("c", 1.0)]
    assert pairs(charts.month_values(df, "t", "n", "sum")) == [("2024-01", 10.0), ("2024-03", 0.0)]
    assert pairs(charts.kpi_value(df, "n")) == [("n", 15.0)]
    assert charts.chart_data(df, {"chart_key": "x", "chart_type": "scatter", "dimension": "k"}) is None


def test_cubes_suppress_and_drill(spark):
    rows = [("r1", "a", 1.0)] * 6 + [("r1", "b", 2.0)] * 4 + [("r2", "c", 3.0)] * 3 + [(None, "d", 1.0)] * 9 + [("r1", None, 1.0)] * 7
    df = spark.createDataFrame(rows, "region string, city string, m double")
    cells = {(r.level_depth, tuple(r.path.values()), r.label): (r.value, r["count"], r.record_count)
             for r in cubes.cube_cells(df, ["region", "city"], "m").collect()}
    assert cells == {(0, (), "r1"): (21.0, 17, 29), (1, ("r1",), "a"): (6.0, 6, 17)}
    built = cubes.cubes(df, ["region", "city"], "m")
    down = cubes.drill_down(built, ["region", "city"], {"region": "r1"}).collect()
    assert [(r.current_level, r.label, r["count"]) for r in down] == [("city", "a", 6)]
    with pytest.raises(ProfileError, match="INVALID_DRILL_DOWN_PATH"):
        cubes.drill_down(built, ["region", "city"], {"m": "1"})
    with pytest.raises(ProfileError, match="DRILL_DOWN_LEAF_REACHED"):
        cubes.drill_down(built, ["region"], {"region": "r1"})


def test_csv_and_guards(spark):
    folder = tempfile.mkdtemp(prefix="tablelens-test-")
    path = f"{folder}/in.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('id;note\n1;"a;b"\n2;N/A\n3;""\nNULL;"two\nlines"\n')
    df = read_csv(spark, path, sep=";", multiLine=True)
    assert {(r.id, r.note) for r in df.collect()} == {("1", "a;b"), ("2", None), ("3", None), (None, "two\nlines")}
    with pytest.raises(ProfileError, match="QUOTED_LINE_BREAK"):
        read_csv(spark, path, sep=";")
    assert read_csv(spark, path, sep=";", check_breaks=False).count() == 5
    with open(f"{folder}/whole.csv", "w", encoding="utf-8") as f:
        f.write('id;note\n1;"say ""yes"""\n')
    assert read_csv(spark, f"{folder}/whole.csv", sep=";").first().note == 'say "yes"'
    check_file_sizes(spark, path)
    with pytest.raises(ProfileError, match="FILE_SIZE_EXCEEDED"):
        check_file_sizes(spark, path, max_mb=1e-6)
    with pytest.raises(ProfileError, match="FILE_SIZE_EXCEEDED"):
        read_table(spark, path, max_mb=1e-6, sep=";")
    with pytest.raises(ProfileError, match="UNSUPPORTED_FILE_TYPE"):
        read_table(spark, "x.xlsx")
    with pytest.raises(ProfileError, match="NO_DATA_ROWS"):
        check_table(df.limit(0))
    with pytest.raises(ProfileError, match="DATASET_ROW_LIMIT_EXCEEDED"):
        check_table(df, max_rows=3)
    with pytest.raises(ProfileError, match="DATASET_COLUMN_LIMIT_EXCEEDED"):
        check_table(df, max_columns=1)
    with pytest.raises(ProfileError, match="UNSUPPORTED_DOMAIN"):
        check_domain("Sports")


def test_whole_run(spark):
    rows = [(f"T{i:04d}", ["EU", "AP", "AM"][i % 3], ["DE", "JP", "US", "FR", "IN", "CA"][i % 6], str(i % 40 + 0.5),
             f"2024-{i % 6 + 1:02d}-15", "approved" if i % 4 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "txn_id string, region string, country string, amount string, auth_date string, auth_status string")
    done = run(df, "Payments", "pay",
               [{"column_name": "auth_status", "mandatory": True, "description": "outcome"}, {"column_name": "txn_id", "expected_unique": True}],
               [{"rule_key": "codes", "type": "regex_match", "target_column": "country", "pattern": "[A-Z]{2}$"}])
    assert done.levels == ["region", "country"]
    chain = done.hierarchy_chains.first()
    assert (chain.status, chain.average_confidence) == ("accepted", 1.0)
    scores = {r.dimension: r.score for r in done.quality_assessments.collect()}
    assert scores["completeness"] == 0.75 and scores["uniqueness"] == 1.0 and scores["conformity"] == 1.0
    assert scores["accuracy"] is None
    charted = {r.chart_key for r in done.chart_data.collect()}
    assert {"amount_over_time", "missing_values_by_column"} <= charted
    top = done.drill_down_cubes.where("level_depth = 0").first()
    assert (top.record_count, [c.label for c in top.cells]) == (240, ["AM", "AP", "EU"])

    root = tempfile.mkdtemp(prefix="tablelens-test-")
    done.write(root)
    state = run_states(spark, root, done.run_id).first()
    assert (state.status, state.row_count, state.column_count) == ("completed", 240, 6)
    assert read_result(spark, root, "column_profiles", done.run_id).count() == 6
    assert read_result(spark, root, "quality_assessments", done.run_id).where("display_score = 75.0").count() == 1
