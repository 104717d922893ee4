"""Keys and inclusions, mergeable profiles, trailing team figures, corrections of a written table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.operators import keys, profiles, teams, weeks
from spanworks.queries.episodes import _LED_SQL, _EPISODE_COLUMNS, _islands, _led_weeks, _typed_spans
from spanworks.queries.mapping import AS_OF, SPANS_SQL, WEEKLY_SQL, order_events
from spanworks.sinks.corrections import correct, read_known, write_known
from spanworks.sources.tables import load_table
from spanworks.workdir import materialize, work_dir

#: The columns of the test tables that are not nested, and a key of each table that has one.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
}


def q_minimal_keys(spark, d):
    parts = [
        keys.minimal_keys(load_table(spark, d, t)).select(F.lit(t).alias("table_name"), "key_columns", "size") for t in COLUMNS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _minimal_sql() -> str:
    tests = []
    for table, names in COLUMNS.items():
        names = names.split()
        for size in (1, 2):
            for s in combinations(names, size):
                listed, filled = ", ".join(f'"{c}"' for c in s), " AND ".join(f'"{c}" IS NOT NULL' for c in s)
                tests.append(f"""SELECT '{table}' AS table_name, '{", ".join(s)}' AS key_columns, {size} AS size,
  (SELECT count(*) FROM {table}) AS n, (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {table} WHERE {filled})) AS k""")
    return f"""WITH tested AS ({" UNION ALL ".join(tests)}), found AS (SELECT table_name, key_columns, size FROM tested WHERE n = k AND n > 1)
SELECT f.* FROM found f WHERE NOT EXISTS (
  SELECT 1 FROM found g WHERE g.table_name = f.table_name AND g.size < f.size AND list_contains(string_split(f.key_columns, ', '), g.key_columns))"""


def q_inclusions(spark, d):
    tables = {t: load_table(spark, d, t) for t in COLUMNS}
    return keys.inclusions(spark, tables, KEYS, ["long"])


_WHOLE_NUMBERS = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey", "supplier": "s_suppkey s_nationkey",
    "part": "p_partkey p_size", "orders": "o_orderkey o_custkey", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber",
    "events": "event_id user_id", "documents": "doc_id n_chars", "embeddings": "vec_id label", "pages": "page_id",
    "benchmark": "item_id", "labels": "doc_id quality toxic", "conversations": "conv_id turn",
}
_INCLUSIONS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{kt}' AS key_table, '{kc}' AS key_column
WHERE NOT EXISTS (SELECT 1 FROM {t} ANTI JOIN (SELECT {kc} AS there FROM {kt}) ON {c} = there WHERE {c} IS NOT NULL) AND EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL)"""
    for t, names in _WHOLE_NUMBERS.items() for c in names.split() for kt, kc in KEYS.items() if (t, c) != (kt, kc))


def q_profile_merged(spark, d):
    """Orders profiled year by year, the states written and merged; how far the estimates are from the exact profile is checked here."""
    orders = load_table(spark, d, "orders")
    stored = materialize(profiles.states(orders, F.year("o_orderdate").cast("string")), "states")
    merged = profiles.merged(stored)
    parts = []
    for c in orders.columns:
        text, number = F.col(c).cast("string"), F.col(c).cast("double") if c in ("o_orderkey", "o_custkey", "o_totalprice") else F.lit(None).cast("double")
        parts.append(orders.select(F.lit(c).alias("column_name"), text.alias("text"), number.alias("number")))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionAll(part)
    both = cells.join(F.broadcast(merged.select("column_name", "q25", "q50", "q75", F.get("frequent", F.lit(0)).alias("first"))), "column_name")
    exact = both.groupBy("column_name").agg(
        F.count_distinct("text").alias("distinct_texts"), F.count_if(F.col("text") == F.col("first")["value"]).alias("first_n"),
        *[F.count_if(F.col("number") <= F.col(q)).alias(f"rank_{q}") for q in ("q25", "q50", "q75")])
    most = cells.filter("text is not null").groupBy("column_name", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("column_name").agg(F.max("n").alias("most"))
    n, said = F.col("n_rows"), F.coalesce(F.get("frequent", F.lit(0))["n"], F.lit(0))
    ranks = [F.col("q50").isNull() | (F.abs(F.col(f"rank_q{int(100 * q)}") - F.lit(q) * n) <= 0.01 * n + 1) for q in profiles.QUANTILES]
    return merged.join(exact, "column_name").join(most, "column_name").select(
        "column_name", "n_rows", "nulls", "blanks", "least", "largest",
        (F.abs(F.col("n_distinct") - F.col("distinct_texts")) <= 0.05 * F.col("distinct_texts")).alias("distinct_within"),
        (ranks[0] & ranks[1] & ranks[2]).alias("ranks_within"),
        ((F.abs(said - F.col("first_n")) <= n / profiles.KEPT) & (F.col("most") - F.col("first_n") <= n / profiles.KEPT)).alias("frequent_within"))


_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS blanks,
  {f"CAST(min({c}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"} AS least, {f"CAST(max({c}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"} AS largest,
  true AS distinct_within, true AS ranks_within, true AS frequent_within FROM orders"""
    for c, number in (("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 0), ("o_orderpriority", 0)))


def q_team_trailing(spark, d):
    ranges = weeks.week_ranges(_typed_spans(spark, d), ["pers_id"], "start_date", "end_date", "span_id", AS_OF)
    customer = load_table(spark, d, "customer").select(F.col("c_custkey").alias("pers_id"), F.col("c_nationkey").alias("manager"))
    weekly = teams.team_weekly(_led_weeks(spark, d), ["manager"], "salary", "tenure_weeks", "leaving")
    out = teams.team_trailing(ranges.join(customer, "pers_id"), weekly, ["manager"], "pers_id")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_headcount", "turnover")})


_TRAILING_SQL = f"""WITH {_LED_SQL},
weekly_teams AS (SELECT manager, week_start, count(*) AS headcount, count(*) FILTER (WHERE leaving) AS leavers FROM led GROUP BY ALL),
heads AS (
  SELECT t.manager, t.week_start, count(DISTINCT pers_id) AS heads FROM weekly_teams t
  JOIN led l ON l.manager = t.manager AND l.week_start BETWEEN t.week_start - 357 AND t.week_start GROUP BY ALL),
windows AS (
  SELECT t.manager, t.week_start, CAST(sum(w.leavers) AS BIGINT) AS leavers, avg(w.headcount) AS mean_headcount, median(w.headcount) AS median_headcount
  FROM weekly_teams t JOIN weekly_teams w ON w.manager = t.manager AND w.week_start BETWEEN t.week_start - 357 AND t.week_start GROUP BY ALL)
SELECT manager, week_start, heads, leavers, round(mean_headcount, 9) AS mean_headcount, median_headcount, round(leavers / mean_headcount, 9) AS turnover
FROM heads JOIN windows USING (manager, week_start)"""


def _job_spans(events: DataFrame) -> DataFrame:
    return weeks.spans_from_events(events, ["entity"], "start_date", "span_id")


def _job_episodes(spans: DataFrame) -> DataFrame:
    return weeks.start_stop_from_spans(spans, ["entity"], "start_date", "end_date", "span_id", AS_OF, ["job_cd"])


def q_start_stop_corrected(spark, d):
    """Every 37th customer turns out to have had other jobs, every 41st no even orders at all; their episodes alone are built again."""
    events = order_events(spark, d)
    path = work_dir(spark, "corrected")
    write_known(_job_episodes(_job_spans(events)), path, ["entity"], "2002-01-01")
    odd, gone = F.col("entity") % 37 == 0, (F.col("entity") % 41 == 0) & (F.col("span_id") % 2 == 0)
    now = events.withColumn("job_cd", F.when(odd, F.lit("6-CORRECTED")).otherwise(F.col("job_cd"))).filter(~gone)
    changed = events.filter("entity % 37 = 0 OR entity % 41 = 0").select("entity").distinct()
    correct(path, _job_spans(now), changed, _job_episodes, ["entity"], "2002-02-01")
    schema = _job_episodes(_job_spans(events.limit(0))).schema
    return read_known(spark, path, schema)


def _corrected_sql() -> str:
    def episodes(name: str, orders: str) -> str:
        spans = SPANS_SQL.replace("FROM orders)", f"FROM {orders})")
        weekly = WEEKLY_SQL.format(source="spans", entity="entity")
        return f"""{name} AS (WITH {spans},{weekly},{_islands("entity", ["job_cd"])} SELECT entity, {_EPISODE_COLUMNS}, job_cd FROM episodes)"""

    return f"""WITH now_orders AS (
  SELECT * REPLACE (CASE WHEN o_custkey % 37 = 0 THEN '6-CORRECTED' ELSE o_orderpriority END AS o_orderpriority) FROM orders
  WHERE NOT (o_custkey % 41 = 0 AND o_orderkey % 2 = 0)),
{episodes("before", "orders")},
{episodes("after", "now_orders")}
SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM before b WHERE b.entity = a.entity AND b.start_date = a.start_date AND b.end_week_date = a.end_week_date
  AND b.job_cd IS NOT DISTINCT FROM a.job_cd) THEN DATE '2002-01-01' ELSE DATE '2002-02-01' END AS known_at FROM after a"""


QUERIES = {
    "minimal_keys": (q_minimal_keys, _minimal_sql()),
    "inclusions": (q_inclusions, _INCLUSIONS_SQL),
    "profile_merged": (q_profile_merged, _PROFILE_SQL),
    "team_trailing": (q_team_trailing, _TRAILING_SQL),
    "start_stop_corrected": (q_start_stop_corrected, _corrected_sql()),
}
