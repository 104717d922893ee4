"""Data quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.operators import quality
from spanworks.sources.tables import load_table

_RULES = {
    "discount below a tenth": "l_discount < 0.1",
    "price positive": "l_extendedprice > 0",
    "returned lines are closed": "nullif(l_returnflag, 'N') <> 'R' OR l_linestatus = 'F'",
    "shipped before 2001": "l_shipdate < timestamp_ntz'2001-01-01 00:00:00'",
}
_RULES_SQL = {
    "discount below a tenth": "l_discount < 0.1",
    "price positive": "l_extendedprice > 0",
    "returned lines are closed": "nullif(l_returnflag, 'N') <> 'R' OR l_linestatus = 'F'",
    "shipped before 2001": "l_shipdate < TIMESTAMP '2001-01-01 00:00:00'",
}


def _with_gaps(spark, d):
    """Orders without the status of some and with a blank priority in others (no table has nulls)."""
    return load_table(spark, d, "orders").withColumns(
        {
            "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("P")),
            "o_orderpriority": F.when(F.col("o_orderpriority") == "5-LOW", " ")
            .otherwise(F.col("o_orderpriority")),
        }
    )


_GAPS_SQL = """gaps AS (
  SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus,
                    CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END
                      AS o_orderpriority) FROM orders)"""
_ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)
_TEXT_COLUMNS = ("o_orderstatus", "o_orderpriority")


def q_nullity_stats(spark, d):
    return quality.nullity_stats(_with_gaps(spark, d))


def q_quality_profile(spark, d):
    return quality.quality_profile(_with_gaps(spark, d), exact_distinct=True)


def q_quality_sketch(spark, d):
    """The exact distinct counts, and whether the one-pass ones come within a tenth of them."""
    gaps = _with_gaps(spark, d)
    exact = quality.distinct_counts(gaps).select("column_name", F.col("n_distinct").alias("exact"))
    joined = quality.quality_profile(gaps).join(exact, "column_name")
    off = F.abs(F.col("n_distinct") - F.col("exact"))
    return joined.select("column_name", F.col("exact"), (off <= F.col("exact") * 0.1).alias("close"))


def q_quick_view(spark, d):
    return quality.quick_view(load_table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")), ["c_custkey"], 3)


def q_duplicate_keys(spark, d):
    return quality.duplicate_keys(load_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_type_validation(spark, d):
    expected = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_quantity", T.IntegerType()),
            T.StructField("l_shipdate", T.DateType()),
            T.StructField("l_returnflag", T.IntegerType()),
            T.StructField("l_comment", T.StringType()),
        ]
    )
    return quality.type_validation(load_table(spark, d, "lineitem"), expected)


def q_rule_checks(spark, d):
    return quality.rule_checks(load_table(spark, d, "lineitem"), _RULES)


def q_uniqueness(spark, d):
    return quality.uniqueness(load_table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


QUERIES = {
    "nullity_stats": (
        q_nullity_stats,
        f"WITH {_GAPS_SQL} " + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls,
       round((count(*) - count({c})) / count(*), 6) AS null_share FROM gaps"""
            for c in _ORDER_COLUMNS
        ),
    ),
    "quality_profile": (
        q_quality_profile,
        f"WITH {_GAPS_SQL} " + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls,
       {f"count(*) FILTER (WHERE trim({c}) = '')" if c in _TEXT_COLUMNS else "0"} AS blanks,
       count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value,
       CAST(max({c}) AS VARCHAR) AS max_value FROM gaps"""
            for c in _ORDER_COLUMNS
        ),
    ),
    "quality_sketch": (
        q_quality_sketch,
        f"WITH {_GAPS_SQL} " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS close FROM gaps"
            for c in _ORDER_COLUMNS
        ),
    ),
    "quick_view": (
        q_quick_view,
        """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
       || ',"c_acctbal":' || CAST(c_acctbal AS DECIMAL(18, 2)) || ',"c_mktsegment":"' || c_mktsegment || '"}' AS row,
       (SELECT count(*) FROM customer) AS n_rows, 5 AS n_columns
FROM customer ORDER BY c_custkey LIMIT 3""",
    ),
    "duplicate_keys": (
        q_duplicate_keys,
        """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY ALL HAVING count(*) > 1""",
    ),
    "type_validation": (
        q_type_validation,
        """WITH failures AS (
  SELECT count(*) FILTER (WHERE l_quantity <> trunc(l_quantity)) AS quantity,
         count(*) FILTER (WHERE l_shipdate <> date_trunc('day', l_shipdate)) AS shipdate,
         count(*) FILTER (WHERE TRY_CAST(l_returnflag AS INTEGER) IS NULL) AS returnflag
  FROM lineitem)
SELECT 'l_orderkey' AS column_name, 'bigint' AS expected, 'bigint' AS actual, true AS ok, 0 AS cast_failures
UNION ALL SELECT 'l_quantity', 'int', 'double', false, quantity FROM failures
UNION ALL SELECT 'l_shipdate', 'date', 'timestamp_ntz', false, shipdate FROM failures
UNION ALL SELECT 'l_returnflag', 'int', 'string', false, returnflag FROM failures
UNION ALL SELECT 'l_comment', 'string', NULL, false, 0""",
    ),
    "rule_checks": (
        q_rule_checks,
        " UNION ALL ".join(
            f"""SELECT '{name}' AS rule, count(*) AS n_rows,
       count(*) FILTER (WHERE NOT ({p})) AS violations,
       count(*) FILTER (WHERE ({p}) IS NULL) AS undecided FROM lineitem"""
            for name, p in _RULES_SQL.items()
        ),
    ),
    "uniqueness": (
        q_uniqueness,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct,
       count(DISTINCT {c}) = count(*) AS is_unique FROM orders"""
            for c in ("o_orderkey", "o_custkey", "o_orderdate")
        ),
    ),
}
