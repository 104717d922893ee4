"""How the test tables stand for workforce data.

An order is an employment span of its customer: it runs from its date to the
customer's next order; the last one is open. Priority is the job code, price the
salary, nation the manager, region the supervisor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanworks.operators.weeks import spans_from_events
from spanworks.plans.workforce import Inputs, Settings
from spanworks.sources.tables import load_table

AS_OF = "2002-01-01"
TERMINATION_RULES = {"RES": "Vol", "RET": "Vol", "LAY": "Inv"}

SPANS_SQL = """
spans AS (
  SELECT o_custkey AS entity, o_orderkey AS span_id, CAST(o_orderdate AS DATE) AS start_date,
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE)
           AS end_date,
         o_orderpriority AS job_cd, o_totalprice AS salary, o_orderstatus AS status
  FROM orders)"""

# One row per span and week it touches, open spans up to the as-of date.
WEEKLY_SQL = f"""
clipped AS (
  SELECT *, least(coalesce(end_date, DATE '{AS_OF}'), DATE '{AS_OF}') AS stop FROM {{source}}),
weekly AS (
  SELECT *, CAST(unnest(generate_series(date_trunc('week', start_date),
                                        date_trunc('week', stop - INTERVAL 1 DAY),
                                        INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM clipped WHERE start_date < stop),
uniq AS (
  SELECT * FROM weekly
  QUALIFY row_number() OVER (PARTITION BY {{entity}}, week_start
                             ORDER BY start_date DESC, span_id DESC) = 1)"""


def order_events(spark: SparkSession, directory: str) -> DataFrame:
    return load_table(spark, directory, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("span_id"),
        F.to_date("o_orderdate").alias("start_date"), F.col("o_orderpriority").alias("job_cd"),
        F.col("o_totalprice").alias("salary"), F.col("o_orderstatus").alias("status"),
    )


def order_spans(spark: SparkSession, directory: str) -> DataFrame:
    return spans_from_events(order_events(spark, directory), ["entity"], "start_date", "span_id")


def workforce_spans(spark: SparkSession, directory: str) -> DataFrame:
    """Spans in which the last one of a person may end: 26 weeks on, unless its status is O."""
    spans = order_spans(spark, directory).withColumnRenamed("entity", "pers_id")
    last = F.col("end_date").isNull()
    gone = last & (F.col("status") != "O")
    code = F.when(F.col("status") == "F", "RES").when(F.col("status") == "P", "LAY")
    return spans.withColumns(
        {
            "term_cd": F.when(last, code),
            "end_date": F.when(gone, F.date_add("start_date", 182)).otherwise(F.col("end_date")),
        }
    )


WORKFORCE_SPANS_SQL = f"""{SPANS_SQL},
ended AS (
  SELECT entity AS pers_id, span_id, start_date, job_cd, salary, status,
         CASE WHEN end_date IS NULL AND status = 'F' THEN 'RES'
              WHEN end_date IS NULL AND status = 'P' THEN 'LAY' END AS term_cd,
         CASE WHEN end_date IS NULL AND status <> 'O' THEN start_date + 182 ELSE end_date END AS end_date
  FROM spans)"""


def workforce_people(spark: SparkSession, directory: str) -> DataFrame:
    return load_table(spark, directory, "customer").select(
        F.col("c_custkey").alias("pers_id"), (F.col("c_mktsegment") == "MACHINERY").alias("optout")
    )


def workforce_hierarchy(spark: SparkSession, directory: str) -> DataFrame:
    """Six-digit manager ids; manager 000000 is a placeholder, its people report to the region."""
    customer = load_table(spark, directory, "customer")
    nation = load_table(spark, directory, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("pers_id"),
        F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("mgr_id"),
        F.concat(F.lit(" R"), F.col("n_regionkey").cast("string")).alias("sup_id"),
    )


def workforce(spark: SparkSession, directory: str) -> tuple[Inputs, Settings]:
    inputs = Inputs(
        workforce_spans(spark, directory), workforce_people(spark, directory),
        workforce_hierarchy(spark, directory),
    )
    settings = Settings(AS_OF, TERMINATION_RULES, default_managers=["0"], team_size=(2, 5000))
    return inputs, settings
