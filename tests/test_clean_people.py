import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanworks.functions import text
from spanworks.functions.dates import date_prefix
from spanworks.operators import clean, joins, people
from spanworks.plans import chain

D = dt.date


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_lower_case_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, bC int")
    assert clean.lower_case_names(df).columns == ["a", "bc"]
    with pytest.raises(ValueError, match="differ only in case"):
        clean.lower_case_names(spark.createDataFrame([(1, 2)], "A int, a int"))


def test_filters_drop_nulls(spark):
    rows = [(1, "x", "live", True), (2, None, "live", True), (3, "x", None, True),
            (4, "x", "live", None), (5, "x", "live", False), (6, "y", "left", True)]
    df = spark.createDataFrame(rows, "id int, source string, status string, primary boolean")
    assert {r.id for r in clean.filter_sources(df, ["x"]).collect()} == {1, 3, 4, 5}
    assert {r.id for r in clean.filter_live_primary(df).collect()} == {1, 2}
    assert clean.filter_sources(df, []).isEmpty()


def test_dates(spark):
    df = spark.sql("SELECT timestamp'2020-01-31 23:59:59' AS timestamp, timestamp_ntz'2021-05-01 10:00:00' AS b")
    assert clean.timestamp_to_dates(df).first()["date"] == D(2020, 1, 31)
    every = clean.timestamp_to_dates(df, {})
    assert every.select("timestamp_date", "b_date").first() == (D(2020, 1, 31), D(2021, 5, 1))
    ends = spark.createDataFrame([(D(2020, 1, 1),), (None,)], "end_date date")
    got = [r.clean_end_date for r in clean.with_clean_end_dates(ends).collect()]
    assert got == [D(2020, 1, 1), D(9999, 12, 31)]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2020-02-30",), ("2020-02-03",), ("04/05/2020",), ("",), (None,)], "s string")
    rows = clean.parse_dates(df, "s", ["yyyy-MM-dd", "dd/MM/yyyy"], "t").collect()
    assert [(r.t.date() if r.t else None, r.t_failed) for r in rows] == [
        (None, True), (D(2020, 2, 3), False), (D(2020, 5, 4), False), (None, True), (None, False)
    ]


def test_text(spark):
    assert column(spark, ["  a \t\n b ", "   ", "", None], text.clean_text) == ["a b", None, None, None]
    assert column(spark, ["x" * 40, "y" * 41, "", None], text.truncate_cell) == [
        "x" * 40, "y" * 40 + "...", "", ""]
    assert column(spark, [1234567, 0, -1000, None], text.with_thousands, "long") == [
        "1,234,567", "0", "-1,000", "-"]
    assert column(spark, ["007", "0", " 12 ", "000", "", None], text.strip_id) == [
        "7", "0", "12", "0", None, None]
    assert column(spark, ["2024-01-05 10:00", "2024-01-05", "x", "", None], date_prefix) == [
        "2024-01-05", "2024-01-05", "x", "-", "-"]
    names = ["c.s.t", "s.t", "t"]
    assert column(spark, names, lambda c: text.name_part(c, "schema")) == ["c", "s", "unknown"]
    assert column(spark, names, lambda c: text.name_part(c, "table")) == ["t", "t", "t"]
    assert column(spark, ["a.b_c"], lambda c: text.anchor_link(c, F.lit(True))) == ["[a.b_c](#a-b-c)"]
    assert column(spark, ["a.b_c"], lambda c: text.anchor_link(c, F.lit(False))) == ["a.b_c"]


def test_clean_terminations(spark):
    rows = [
        (1, D(2020, 1, 1), D(2020, 6, 1), "RES", 1), (1, D(2020, 1, 1), D(2020, 6, 1), "LAY", 2),
        (2, D(2020, 1, 1), D(2019, 1, 1), "RES", 1), (3, D(2020, 1, 1), None, "RES", 1),
        (4, D(2020, 1, 1), D(2020, 1, 1), None, 1),
    ]
    df = spark.createDataFrame(rows, "id int, s date, e date, t string, rec int")
    out = people.clean_terminations(df, ["id"], "s", "e", "t", ["rec"]).orderBy("id").collect()
    assert [(r.id, r.e, r.t) for r in out] == [
        (1, D(2020, 6, 1), "LAY"), (2, None, None), (3, None, None), (4, D(2020, 1, 1), None)]


def test_ongoing_start(spark):
    rows = [(D(2018, 1, 1), None), (D(2018, 1, 1), D(2021, 1, 1)), (D(2021, 1, 1), None)]
    df = spark.createDataFrame(rows, "s date, e date")
    out = people.ongoing_start_fix(df, "s", "e", "2020-01-01")
    assert [r.effective_start for r in out.collect()] == [D(2020, 1, 1), D(2018, 1, 1), D(2021, 1, 1)]


def test_codes_and_ids(spark):
    df = spark.createDataFrame(
        [("F", "RES", D(2020, 1, 1), "007", "9"), ("Z", "??", D(2020, 1, 1), "000", "09"),
         (None, None, None, None, "0"), ("P", "RES", None, " ", None)],
        "code string, term string, e date, m string, s string",
    )
    classed = people.employment_class(df, "code", {"F": "Full", "P": "Part"}, {"F": "Regular"})
    assert [(r.working_time, r.permanence) for r in classed.collect()] == [
        ("Full", "Regular"), ("Unknown", "Unknown"), ("Unknown", "Unknown"), ("Part", "Unknown")]
    typed = people.termination_type(df, "term", "e", {"RES": "Vol"})
    assert [r.term_type for r in typed.collect()] == ["Vol", "Unk", None, None]
    ids = people.mgr_sup_id(df, "m", "s", ["0"])
    assert [r.mgr_sup_id for r in ids.collect()] == ["7", "9", None, None]
    assert [r.is_missing_m for r in people.missing_flags(df, ["m"]).collect()] == [False, False, True, False]
    assert people.null_default_ids(df, ["m"], ["000"]).filter("m IS NULL").count() == 2


def test_left_join_keeps_left_count(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "x", 1)], "k int, v string, r int")
    out = joins.dedup_left_join(left, right, ["k"], [F.desc("r")])
    assert sorted(((r.k, r.v) for r in out.collect()), key=str) == [
        (1, "new"), (1, "new"), (2, None), (None, None)]


def test_optout_filter(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    out = clean.optout_filter(df, spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"])
    assert sorted((r.k for r in out.collect()), key=str) == [2, None]


def test_union_datasets(spark):
    a, b = spark.createDataFrame([(1, "t")], "id int, y string"), spark.createDataFrame([(2,)], "id int")
    out = chain.union_datasets({"train": a, "predict": b})
    assert sorted(map(tuple, out.select("id", "y", "dataset").collect())) == [
        (1, "t", "train"), (2, None, "predict")]
