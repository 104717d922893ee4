"""Histories of several tables, hierarchies over all levels, survival, rules across rows, differences of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanworks.operators import hierarchy, quality, survival, weeks
from spanworks.operators.sweep import Spans, episodes_from_many, overlay_sources
from spanworks.queries.episodes import _TYPED_SQL, _typed_spans
from spanworks.queries.mapping import AS_OF, WEEKLY_SQL, order_events, order_spans
from spanworks.sinks.differences import snapshot_diff, write_keyed
from spanworks.sources.tables import load_table
from spanworks.workdir import work_dir

_ENTITY = ["entity"]


def _lasting(rows, days):
    """Spans of ``days`` days from each order, so that they overlap and leave gaps."""
    return rows.withColumn("end_date", F.date_add("start_date", days))


def _banded(spark, d):
    return order_events(spark, d).withColumn("band", F.floor(F.col("salary") / 100_000).cast("int"))


def q_episodes_from_many(spark, d):
    """Job codes without a gap, states that overlap, and price bands that leave gaps."""
    orders, status = _banded(spark, d), F.col("status")
    end = F.when(status == "F", F.date_add("start_date", 60)).when(status == "P", F.date_add("start_date", 400))
    tables = {
        "jobs": Spans(order_spans(spark, d), "start_date", "end_date", "span_id", ["job_cd"]),
        "states": Spans(orders.withColumn("end_date", end), "start_date", "end_date", "span_id", ["status"]),
        "bands": Spans(_lasting(orders, 90), "start_date", "end_date", "span_id", ["band"]),
    }
    return episodes_from_many(tables, _ENTITY, AS_OF).withColumn("valid_in", F.concat_ws(",", "valid_in"))


def _day_sql(name: str, source: str, values: str) -> str:
    """The holder of each entity and day, by listing all days."""
    return f"""{name}_listed AS (
  SELECT *, CAST(unnest(generate_series(start_date, least(coalesce(end_date, DATE '{AS_OF}'), DATE '{AS_OF}') - 1, INTERVAL 1 DAY)) AS DATE) AS day
  FROM {source} WHERE start_date < least(coalesce(end_date, DATE '{AS_OF}'), DATE '{AS_OF}')),
{name} AS (SELECT entity, day, 1 AS in_{name}, {values} FROM {name}_listed
  QUALIFY row_number() OVER (PARTITION BY entity, day ORDER BY start_date DESC, span_id DESC) = 1)"""


def _day_runs_sql(source: str, values: list[str]) -> str:
    same = " AND ".join(f"lag({v}) OVER w IS NOT DISTINCT FROM {v}" for v in values)
    return f"""marked AS (
  SELECT *, CASE WHEN lag(day) OVER w = day - 1 AND {same} THEN 0 ELSE 1 END AS fresh FROM {source}
  WINDOW w AS (PARTITION BY entity ORDER BY day)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY day) AS run FROM marked)
SELECT entity, min(day) AS start_date, CAST(max(day) + 1 AS DATE) AS end_date, {", ".join(values)}
FROM numbered GROUP BY entity, run, {", ".join(values)}"""


_ORDERS_SQL = f"""orders_as_spans AS (
  SELECT o_custkey AS entity, o_orderkey AS span_id, CAST(o_orderdate AS DATE) AS start_date, o_orderstatus AS status,
    o_orderpriority AS job_cd, CAST(floor(o_totalprice / 100000) AS INTEGER) AS band,
    CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS next_date FROM orders)"""

_MANY_SQL = f"""WITH {_ORDERS_SQL},
job_spans AS (SELECT *, next_date AS end_date FROM orders_as_spans),
state_spans AS (SELECT *, CASE status WHEN 'F' THEN start_date + 60 WHEN 'P' THEN start_date + 400 END AS end_date FROM orders_as_spans),
band_spans AS (SELECT *, start_date + 90 AS end_date FROM orders_as_spans),
{_day_sql("jobs", "job_spans", "job_cd")},
{_day_sql("states", "state_spans", "status")},
{_day_sql("bands", "band_spans", "band")},
days AS (
  SELECT entity, day, job_cd, status, band, concat_ws(',', CASE WHEN in_jobs = 1 THEN 'jobs' END,
    CASE WHEN in_states = 1 THEN 'states' END, CASE WHEN in_bands = 1 THEN 'bands' END) AS valid_in
  FROM jobs FULL JOIN states USING (entity, day) FULL JOIN bands USING (entity, day)),
{_day_runs_sql("days", ["job_cd", "status", "band", "valid_in"])}"""


def q_overlay_sources(spark, d):
    """Orders by priority as three systems; the best does not know some states, the next some bands."""
    orders = _banded(spark, d)
    job = F.substring("job_cd", 1, 1)
    best = _lasting(orders.filter(job <= "2").withColumn("status", F.nullif("status", F.lit("P"))), 120)
    second = _lasting(orders.filter(job == "3").withColumn("band", F.nullif("band", F.lit(1))), 300)
    last = orders.filter(job >= "4").withColumn("end_date", F.lit(None).cast("date"))
    values = ["status", "band"]
    sources = {
        "payroll": Spans(best, "start_date", "end_date", "span_id", values),
        "directory": Spans(second, "start_date", "end_date", "span_id", values),
        "archive": Spans(last, "start_date", "end_date", "span_id", values),
    }
    return overlay_sources(sources, _ENTITY, AS_OF)


def _best_sql(value: str) -> str:
    return f"""coalesce(payroll_{value}, directory_{value}, archive_{value}) AS {value},
    CASE WHEN payroll_{value} IS NOT NULL THEN 'payroll' WHEN directory_{value} IS NOT NULL THEN 'directory'
         WHEN archive_{value} IS NOT NULL THEN 'archive' END AS {value}_source"""


def _source_values_sql(name: str) -> str:
    return f"status AS {name}_status, band AS {name}_band"


_OVERLAY_SQL = f"""WITH {_ORDERS_SQL},
best AS (SELECT * REPLACE (nullif(status, 'P') AS status), start_date + 120 AS end_date FROM orders_as_spans WHERE job_cd[1] <= '2'),
second AS (SELECT * REPLACE (nullif(band, 1) AS band), start_date + 300 AS end_date FROM orders_as_spans WHERE job_cd[1] = '3'),
third AS (SELECT *, CAST(NULL AS DATE) AS end_date FROM orders_as_spans WHERE job_cd[1] >= '4'),
{_day_sql("payroll", "best", _source_values_sql("payroll"))},
{_day_sql("directory", "second", _source_values_sql("directory"))},
{_day_sql("archive", "third", _source_values_sql("archive"))},
days AS (
  SELECT entity, day, {_best_sql("status")}, {_best_sql("band")}
  FROM payroll FULL JOIN directory USING (entity, day) FULL JOIN archive USING (entity, day)),
{_day_runs_sql("days", ["status", "status_source", "band", "band_source"])}"""

_MOMENTS = ["1997-01-01", "1999-01-01"]
_CHANGE = "1998-01-01"


def _relations(spark, d):
    """Every customer below the one with a third (from 1998 a fourth) of its number; some are above themselves."""
    customer = load_table(spark, d, "customer").select(F.col("c_custkey").alias("person"))
    key = F.col("person")
    odd = F.when(key == 5, 17).when(key == 40, 362).when(key == 7, 7)
    day = lambda x: F.to_date(F.lit(x))
    early = customer.select("person", F.coalesce(odd, F.floor(key / 3)).cast("long").alias("boss"), day("1995-01-01").alias("valid_from"), day(_CHANGE).alias("valid_to"))
    late = customer.select("person", F.coalesce(odd, F.floor(key / 4)).cast("long").alias("boss"), day(_CHANGE).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return hierarchy.edges_at(early.unionByName(late), _MOMENTS, "person", "boss", "valid_from", "valid_to")


def q_team_rollup(spark, d):
    """Orders and revenue of the year, of every customer with all those below."""
    orders = load_table(spark, d, "orders").select(
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("moment"), F.col("o_custkey").alias("person"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    amounts = orders.filter(F.col("moment").isin(*[F.to_date(F.lit(m)) for m in _MOMENTS])).groupBy("moment", "person").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("price").alias("revenue"))
    out = hierarchy.team_rollup(_relations(spark, d), "person", "boss", amounts, "person", ["n_orders", "revenue"], ["moment"])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


def q_hierarchy_cycles(spark, d):
    return hierarchy.cycles(_relations(spark, d), "person", "boss", ["moment"])


_RELATIONS_SQL = """relations AS (
  SELECT moment, c_custkey AS node, CAST(CASE c_custkey WHEN 5 THEN 17 WHEN 40 THEN 362 WHEN 7 THEN 7 ELSE c_custkey // share END AS BIGINT) AS up
  FROM customer, (VALUES (DATE '1997-01-01', 3), (DATE '1999-01-01', 4)) AS t(moment, share)),
above AS (
  SELECT moment, node, up FROM relations
  UNION SELECT a.moment, a.node, r.up FROM above a JOIN relations r ON r.moment = a.moment AND r.node = a.up),
on_cycle AS (SELECT moment, node FROM above WHERE node = up)"""

_ROLLUP_SQL = f"""WITH RECURSIVE {_RELATIONS_SQL},
straight AS (SELECT * FROM relations ANTI JOIN on_cycle USING (moment, node)),
below AS (
  SELECT moment, node, up, 1 AS depth FROM straight
  UNION ALL SELECT b.moment, b.node, s.up, depth + 1 FROM below b JOIN straight s ON s.moment = b.moment AND s.node = b.up),
amounts AS (
  SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS moment, o_custkey AS node, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue
  FROM orders WHERE year(o_orderdate) IN (1997, 1999) GROUP BY ALL),
people AS (SELECT moment, node FROM relations UNION SELECT moment, up FROM relations UNION SELECT moment, node FROM amounts),
pairs AS (SELECT moment, node, node AS up, 0 AS depth FROM people UNION ALL SELECT moment, node, up, depth FROM below)
SELECT moment, p.up AS person, count(*) AS members, CAST(max(depth) AS INTEGER) AS levels, CAST(sum(n_orders) AS BIGINT) AS n_orders,
  CAST(sum(revenue) AS DOUBLE) AS revenue
FROM pairs p LEFT JOIN amounts USING (moment, node) GROUP BY moment, p.up"""

_CYCLES_SQL = f"""WITH RECURSIVE {_RELATIONS_SQL}
SELECT c.moment, min(o.node) AS cycle, c.node, count(*) AS length
FROM on_cycle c JOIN above a ON a.moment = c.moment AND a.node = c.node JOIN on_cycle o ON o.moment = c.moment AND o.node = a.up
GROUP BY c.moment, c.node"""


def _risk(spark, d):
    episodes = weeks.start_stop_from_spans(
        _typed_spans(spark, d), ["pers_id"], "start_date", "end_date", "span_id", AS_OF, ["job_cd", "term_type"], "term_type")
    return survival.risk_sets(episodes, ["pers_id"], ["job_cd"])


def q_risk_sets(spark, d):
    return _risk(spark, d)


def q_cumulative_incidence(spark, d):
    curve = survival.cumulative_incidence(_risk(spark, d), ["job_cd"])
    return curve.withColumns({c: F.round(c, 9) for c in curve.columns[3:]})


_RISK_SQL = f"""{_TYPED_SQL},{WEEKLY_SQL.format(source="typed", entity="pers_id")},
tenure AS (
  SELECT job_cd, CAST(datediff('day', min(week_start) OVER (PARTITION BY pers_id), week_start) // 7 AS INTEGER) AS week,
    CASE WHEN week_start = max(week_start) OVER (PARTITION BY pers_id) THEN coalesce(term_type, 'none') END AS leaves FROM uniq),
risk AS (
  SELECT job_cd, week, count(*) AS at_risk, count(*) FILTER (leaves = 'Vol') AS left_vol, count(*) FILTER (leaves = 'Inv') AS left_inv,
    count(*) FILTER (leaves = 'Unk') AS left_unk, count(*) FILTER (leaves = 'none') AS censored FROM tenure GROUP BY job_cd, week)"""

_INCIDENCE_SQL = f"""WITH {_RISK_SQL},
curve AS (SELECT *, product(1 - (left_vol + left_inv + left_unk) / at_risk) OVER (PARTITION BY job_cd ORDER BY week) AS survival FROM risk),
steps AS (SELECT *, coalesce(lag(survival) OVER (PARTITION BY job_cd ORDER BY week), 1.0) AS before FROM curve)
SELECT job_cd, week, at_risk, round(survival, 9) AS survival,
  round(sum(before * left_vol / at_risk) OVER w, 9) AS incidence_vol, round(sum(before * left_inv / at_risk) OVER w, 9) AS incidence_inv,
  round(sum(before * left_unk / at_risk) OVER w, 9) AS incidence_unk
FROM steps WINDOW w AS (PARTITION BY job_cd ORDER BY week)"""


def _uneven(spark, d):
    """Spans of 60 or 400 days or without end, some of which end before they begin."""
    status, start = F.col("status"), F.col("start_date")
    end = F.when(F.col("span_id") % 50 == 0, F.date_sub(start, 3)).when(status == "F", F.date_add(start, 60)).when(status == "P", F.date_add(start, 400))
    return order_events(spark, d).withColumn("end_date", end)


def _rules(spark, d):
    return quality.span_rules(_uneven(spark, d), _ENTITY, "start_date", "end_date", "span_id", allowed_gap=30)


def q_overlap_rule(spark, d):
    return _rules(spark, d).filter("rule = 'overlap'")


def q_gap_rule(spark, d):
    return _rules(spark, d).filter("rule <> 'overlap'")


_RULES_SQL = """WITH spans AS (
  SELECT o_custkey AS entity, o_orderkey AS span_id, CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_orderdate AS DATE) - 3 WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 60
         WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 400 END AS end_date FROM orders),
proper AS (SELECT *, coalesce(end_date, DATE '9999-12-31') AS until FROM spans WHERE end_date IS NULL OR end_date >= start_date),
earlier AS (
  SELECT b.entity, b.span_id, b.start_date, b.until, a.span_id AS witness, a.until AS reach FROM proper b JOIN proper a
    ON a.entity = b.entity AND (a.start_date, a.span_id) < (b.start_date, b.span_id)
  QUALIFY row_number() OVER (PARTITION BY b.entity, b.span_id ORDER BY a.until DESC, a.span_id DESC) = 1),
broken AS (
  SELECT entity, span_id, 'overlap' AS rule, witness,
    CASE WHEN least(until, reach) < DATE '9999-12-31' THEN CAST(datediff('day', start_date, least(until, reach)) AS INTEGER) END AS days
  FROM earlier WHERE start_date < reach
  UNION ALL SELECT entity, span_id, 'gap', witness, CAST(datediff('day', reach, start_date) AS INTEGER) FROM earlier
  WHERE datediff('day', reach, start_date) > 30
  UNION ALL SELECT entity, span_id, 'order', span_id, CAST(datediff('day', end_date, start_date) AS INTEGER) FROM spans WHERE end_date < start_date)"""


def q_snapshot_diff(spark, d):
    """Orders against orders of which some are gone, some new and some changed in one or two cells."""
    orders = load_table(spark, d, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    changed = orders.filter(key % 50 != 0).withColumns({
        "o_totalprice": F.when(key % 97 == 0, price + 1).otherwise(price),
        "o_orderstatus": F.when(key % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))})
    added = orders.filter(key % 200 == 1).withColumn("o_orderkey", key + 100_000_000)
    path = work_dir(spark, "differences")
    write_keyed(orders, f"{path}/before", ["o_orderkey"])
    write_keyed(changed.unionByName(added), f"{path}/after", ["o_orderkey"])
    return snapshot_diff(spark, f"{path}/before", f"{path}/after", orders.schema, ["o_orderkey"])


_DIFF_SQL = """SELECT o_orderkey, CAST(1 AS INTEGER) AS copy, 'removed' AS change, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after
FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey + 100000000, 1, 'added', NULL, NULL, NULL FROM orders WHERE o_orderkey % 200 = 1
UNION ALL SELECT o_orderkey, 1, 'changed', 'o_totalprice', CAST(o_totalprice AS VARCHAR), CAST(o_totalprice + 1 AS VARCHAR)
FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 50 <> 0
UNION ALL SELECT o_orderkey, 1, 'changed', 'o_orderstatus', o_orderstatus, NULL
FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey % 50 <> 0"""

QUERIES = {
    "episodes_from_many": (q_episodes_from_many, _MANY_SQL),
    "overlay_sources": (q_overlay_sources, _OVERLAY_SQL),
    "team_rollup": (q_team_rollup, _ROLLUP_SQL),
    "hierarchy_cycles": (q_hierarchy_cycles, _CYCLES_SQL),
    "risk_sets": (q_risk_sets, f"WITH {_RISK_SQL} SELECT * FROM risk"),
    "cumulative_incidence": (q_cumulative_incidence, _INCIDENCE_SQL),
    "overlap_rule": (q_overlap_rule, f"{_RULES_SQL} SELECT * FROM broken WHERE rule = 'overlap'"),
    "gap_rule": (q_gap_rule, f"{_RULES_SQL} SELECT * FROM broken WHERE rule <> 'overlap'"),
    "snapshot_diff": (q_snapshot_diff, _DIFF_SQL),
}
