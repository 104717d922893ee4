"""Loads and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanworks.operators import clean, joins
from spanworks.operators.ordered import latest_per_key
from spanworks.queries.mapping import SPANS_SQL, order_spans
from spanworks.sources.loads import load_dimension, load_fact, load_hierarchy
from spanworks.sources.tables import load_table

_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
_LINE_RANK = """row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1"""
# Events are of 2024; moved back by this many days they fall among the orders.
_SHIFT = 9000


def q_load_dimension(spark, d):
    """Orders as a customer profile: cleaned, the latest one per customer."""
    return load_dimension(
        load_table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")],
        ["o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"],
    )


def q_load_fact(spark, d):
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"]
    raw = load_table(spark, d, "orders").withColumn(
        "o_totalprice", F.nullif(F.col("o_orderstatus"), F.lit("P")).isNotNull().cast("int") * F.col("o_totalprice")
    )
    raw = raw.withColumn("o_totalprice", F.nullif(F.col("o_totalprice"), F.lit(0.0)))
    return load_fact(raw, ["o_orderdate"], ["o_totalprice"], columns)


def q_load_hierarchy(spark, d):
    """Customers under the customer whose key is their nation's; customer 3 is a placeholder."""
    return load_hierarchy(
        load_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("MGR")),
        "c_custkey", "manager", ["3"], {"mgr": "manager"},
    )


def q_calc_join(spark, d):
    customer = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
    )
    nation = load_table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = load_table(spark, d, "region")
    orders = load_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.calc_join(
        orders,
        [
            (customer, ["o_custkey"], [F.asc("c_mktsegment")]),
            (nation, ["n_nationkey"], [F.asc("n_name")]),
            (region, ["r_regionkey"], [F.asc("r_name")]),
        ],
    )


def q_dedup_latest(spark, d):
    return latest_per_key(
        load_table(spark, d, "lineitem"), _LINE_KEY, [F.desc(c) for c in _LINE_ORDER]
    )


def q_dedup_left_join(spark, d):
    """Orders with the latest of their lines."""
    lines = load_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), *_LINE_ORDER
    )
    orders = load_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.dedup_left_join(
        orders, lines, ["o_orderkey"], [F.desc(c) for c in _LINE_ORDER]
    )


def q_optout_filter(spark, d):
    opted_out = load_table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'")
    return clean.optout_filter(
        load_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")),
        opted_out, ["c_custkey"],
    )


def _shifted_events(spark, d):
    return load_table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("entity"),
        (F.col("ts") - F.expr(f"interval {_SHIFT} days")).alias("ts"),
    )


def _long_spans(spark, d):
    """Spans that overlap: every order is valid for two years, those of status O without end."""
    start = F.col("o_orderdate")
    return load_table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("span_id"),
        start.alias("start_ts"),
        F.when(F.col("o_orderstatus") != "O", start + F.expr("interval 730 days")).alias("end_ts"),
    )


def q_interval_join(spark, d):
    return joins.interval_join(
        _shifted_events(spark, d), _long_spans(spark, d), ["entity"], "ts", "start_ts", "end_ts",
        ["span_id"], as_of="2002-01-01 00:00:00",
    )


def q_interval_join_orders(spark, d):
    """Each order with the customer's spans it falls into (spans of two years, overlapping)."""
    facts = load_table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts")
    )
    return joins.interval_join(
        facts, _long_spans(spark, d), ["entity"], "ts", "start_ts", "end_ts", ["span_id"],
        as_of="2002-01-01 00:00:00", how="inner", bucket_hours=24 * 182,
    )


def q_covariate_at(spark, d):
    spans = order_spans(spark, d)
    return joins.covariate_at(
        _shifted_events(spark, d), spans, ["entity"], "ts", "start_date", "end_date",
        ["span_id", "job_cd"], "span_id",
    )


def q_asof_join(spark, d):
    """Each order with the customer's latest urgent order until then."""
    orders = load_table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts")
    )
    urgent = load_table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("urgent_ts"),
        F.col("o_orderkey").alias("urgent_key"),
    )
    return joins.asof_join(
        orders, urgent, ["entity"], "ts", "urgent_ts", ["urgent_key", "urgent_ts"],
        [F.desc("urgent_key")],
    )


def q_manager_lookup(spark, d):
    """The manager of a customer changes in 1999 from the nation's to the region's."""
    customer = load_table(spark, d, "customer")
    nation = load_table(spark, d, "nation")
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    change = F.to_date(F.lit("1999-01-01"))
    early = homes.select(
        F.col("c_custkey").alias("entity"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("manager"),
        F.to_date(F.lit("1996-01-01")).alias("valid_from"), change.alias("valid_to"),
    )
    late = homes.filter("n_regionkey > 0").select(
        F.col("c_custkey").alias("entity"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("manager"),
        change.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )
    orders = load_table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("start_date")
    )
    return joins.manager_lookup(
        orders, early.unionByName(late), "entity", "start_date", "valid_from", "valid_to",
        ["manager"], "manager",
    )


_EVENTS_SQL = f"""facts AS (
  SELECT event_id, user_id AS entity, ts - INTERVAL {_SHIFT} DAY AS ts FROM events)"""
_LONG_SQL = """long_spans AS (
  SELECT o_custkey AS entity, o_orderkey AS span_id, o_orderdate AS start_ts,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 730 DAY END AS end_ts
  FROM orders)"""

QUERIES = {
    "load_dimension": (
        q_load_dimension,
        """SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "load_fact": (
        q_load_fact,
        """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderstatus
FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <> 0""",
    ),
    "load_hierarchy": (
        q_load_hierarchy,
        """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS manager FROM customer
WHERE c_nationkey <> 3 AND c_nationkey <> c_custkey""",
    ),
    "calc_join": (
        q_calc_join,
        """SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""",
    ),
    "dedup_latest": (q_dedup_latest, f"SELECT * FROM lineitem QUALIFY {_LINE_RANK}"),
    "dedup_left_join": (
        q_dedup_left_join,
        f"""SELECT o_orderkey, o_custkey, l_shipdate, l_extendedprice, l_partkey, l_suppkey
FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY {_LINE_RANK.replace(", l_linenumber", "")})
  ON l_orderkey = o_orderkey""",
    ),
    "optout_filter": (
        q_optout_filter,
        """SELECT o_orderkey, o_custkey AS c_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
    ),
    "interval_join": (
        q_interval_join,
        f"""WITH {_EVENTS_SQL}, {_LONG_SQL}
SELECT event_id, f.entity, ts, span_id FROM facts f LEFT JOIN long_spans s
  ON f.entity = s.entity AND ts >= start_ts
 AND ts < coalesce(end_ts, TIMESTAMP '2002-01-01 00:00:00')""",
    ),
    "interval_join_orders": (
        q_interval_join_orders,
        f"""WITH {_LONG_SQL}
SELECT o_orderkey, entity, o_orderdate AS ts, span_id FROM orders JOIN long_spans
  ON o_custkey = entity AND o_orderdate >= start_ts
 AND o_orderdate < coalesce(end_ts, TIMESTAMP '2002-01-01 00:00:00')""",
    ),
    "covariate_at": (
        q_covariate_at,
        f"""WITH {_EVENTS_SQL}, {SPANS_SQL}
SELECT event_id, f.entity, ts, span_id, job_cd FROM facts f LEFT JOIN spans s
  ON f.entity = s.entity AND ts >= start_date AND (end_date IS NULL OR ts < end_date)""",
    ),
    "asof_join": (
        q_asof_join,
        """WITH urgent AS (
  SELECT o_custkey AS entity, o_orderdate AS urgent_ts, max(o_orderkey) AS urgent_key
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o_orderkey, o_custkey AS entity, o_orderdate AS ts, urgent_key, urgent_ts
FROM orders ASOF LEFT JOIN urgent ON o_custkey = entity AND o_orderdate >= urgent_ts""",
    ),
    "manager_lookup": (
        q_manager_lookup,
        """SELECT o_orderkey, o_custkey AS entity, CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderdate >= DATE '1999-01-01' THEN CASE WHEN n_regionkey > 0 THEN 'R' || n_regionkey END
       WHEN o_orderdate >= DATE '1996-01-01' THEN 'N' || n_nationkey END AS manager
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
}
