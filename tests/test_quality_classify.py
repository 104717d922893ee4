from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.operators import classify, quality
from spanworks.operators.classify import Rule


def test_nullity_and_profile(spark):
    df = spark.createDataFrame(
        [(1, " ", None), (2, None, 5.0), (2, "b", None)], "x int, s string, d double"
    ).toDF("a.b", "s", "d")
    stats = {r.column_name: (r.n_rows, r.nulls) for r in quality.nullity_stats(df).collect()}
    assert stats == {"a.b": (3, 0), "s": (3, 1), "d": (3, 2)}
    for exact in (False, True):
        rows = {r.column_name: r for r in quality.quality_profile(df, exact).collect()}
        assert (rows["s"].blanks, rows["s"].n_distinct, rows["d"].n_distinct) == (1, 2, 1)
        assert (rows["a.b"].min_value, rows["a.b"].max_value) == ("1", "2")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, m map<string,int>")
    assert [r.null_share for r in quality.nullity_stats(df).collect()] == [None, None]
    assert {r.n_distinct for r in quality.quality_profile(df, True).collect()} == {0}


def test_duplicates_and_uniqueness(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "k int, u int")
    assert sorted(((r.k, r.n_rows) for r in quality.duplicate_keys(df, ["k"]).collect()), key=str) == [
        (1, 2), (None, 2)]
    unique = {r.column_name: r.is_unique for r in quality.uniqueness(df, ["k", "u"]).collect()}
    assert unique == {"k": False, "u": True}


def test_types_and_rules(spark):
    df = spark.createDataFrame([("1", 1), ("x", None), (None, 3)], "s string, n int")
    expected = T.StructType(
        [T.StructField("s", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("z", T.DateType())]
    )
    rows = {r.column_name: (r.actual, r.ok, r.cast_failures) for r in quality.type_validation(df, expected).collect()}
    assert rows == {"s": ("string", False, 1), "n": ("int", True, 0), "z": (None, False, 0)}
    checks = {r.rule: (r.violations, r.undecided) for r in quality.rule_checks(
        df, {"small": "n < 3", "either": "n < 3 OR s IS NULL"}).collect()}
    assert checks == {"small": (1, 1), "either": (0, 1)}


def names(spark, rule, values):
    df = spark.createDataFrame([(v,) for v in values], "n string")
    return [r.n for r in df.filter(rule(F.col("n"))).collect()]


def test_name_rules(spark):
    keys = ["ID", "key", "order_id", "o_orderkey", "emp_id_old", "my_emp_id_old", "x_uuid", "idx", "a_pk"]
    assert names(spark, classify.is_key_name, keys) == [
        "ID", "key", "order_id", "emp_id_old", "x_uuid", "a_pk"]
    assert names(spark, classify.is_date_name, ["o_OrderDate", "l_extendedprice", "ts", "End"]) == [
        "o_OrderDate", "l_extendedprice", "End"]
    assert names(spark, classify.is_important_name, ["c_name", "l_discount", "price"]) == [
        "c_name", "l_discount"]


def test_first_match_wins(spark):
    rules = [Rule(("land_main",), {"pipeline_stage": "Main"}), Rule(("land",), {"pipeline_stage": "Any"})]
    df = spark.createDataFrame([("land_main", "dim_person"), ("land_x", "fact_sales"), ("z", "zz"), (None, None)],
                               "s string, t string")
    rows = classify.with_table_context(df, "s", "t", rules).collect()
    assert [(r.pipeline_stage, r.migration_priority, r.business_purpose) for r in rows] == [
        ("Main", "Low", "Employee/Person Data"), ("Any", "Low", "Fact Table"),
        ("Unknown", "Low", "Unknown"), ("Unknown", "Low", "Unknown")]


def test_error_classes(spark):
    cases = [
        ("TABLE_OR_VIEW_NOT_FOUND: x", "Table does not exist", False),
        ("x does not exist", "Table does not exist", False),
        ("SCHEMA_NOT_FOUND", "Schema does not exist", False),
        ("user lacks permission", "Permission denied", True),
        ("ACCESS_DENIED in schema x", "Permission denied", True),
        ("INVALID_CATALOG", "Invalid catalog", False),
        ("read timeout", "Query timeout", None),
        ("Connection refused", "Connection error", None),
        ("out of memory", "Memory error", None),
        ("boom", "Unknown error", None),
        ("[UNSUPPORTED_FEATURE.X] not for hr.employee_permission", "Analysis error", None),
        ("[UNRESOLVED_COLUMN.WITH_SUGGESTION] `memory_mb`", "Analysis error", None),
        ("cannot read hr.permission_memory", "Unknown error", None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(cases)], "i int, m string")
    rows = classify.with_error_class(df, "m").orderBy("i").collect()
    assert [(r.error_class, r.exists) for r in rows] == [(c, e) for _, c, e in cases]


def test_empty_table_and_lossy_casts(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert {(r.column_name, r.n_rows, r.n_distinct) for r in quality.uniqueness(empty, ["a", "b"]).collect()} == {("a", 0, 0), ("b", 0, 0)}
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1.5,), (2.0,), (None,)], "x double")
    row = quality.type_validation(df, T.StructType([T.StructField("x", T.IntegerType())])).first()
    assert row.cast_failures == 1
