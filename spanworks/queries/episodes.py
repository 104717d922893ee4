"""Weeks, spans, episodes, fills and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanworks.functions.dates import iso_week
from spanworks.operators import teams, weeks
from spanworks.operators.ordered import forward_fill, next_value, previous_value
from spanworks.operators.people import termination_type
from spanworks.plans.workforce import main_run, rounded, start_stop_dataset
from spanworks.queries.mapping import (
    AS_OF,
    SPANS_SQL,
    TERMINATION_RULES,
    WEEKLY_SQL,
    WORKFORCE_SPANS_SQL,
    order_events,
    order_spans,
    workforce,
    workforce_spans,
)
from spanworks.sources.tables import load_table
from spanworks.workdir import work_dir

_ENTITY = ["entity"]
_ORDER_WEEKS = WEEKLY_SQL.format(source="spans", entity="entity")

# Episodes out of ``uniq``: a new island wherever a covariate or the run of weeks breaks.
_ISLANDS_SQL = """
flagged AS (
  SELECT *, CASE WHEN {same}{terminal}
                  AND lag(week_start) OVER w = week_start - 7 THEN 0 ELSE 1 END AS new_island
  FROM uniq WINDOW w AS (PARTITION BY {entity} ORDER BY week_start)),
islands AS (
  SELECT *, sum(new_island) OVER (PARTITION BY {entity} ORDER BY week_start) AS island FROM flagged),
episodes AS (
  SELECT {entity}, {covariates}, min(week_start) AS start_date, max(week_start) AS end_week_date
  FROM islands GROUP BY {entity}, island, {covariates})"""


def _islands(entity: str, covariates: list[str], terminal: bool = False) -> str:
    same = " AND ".join(
        f"lag({c}) OVER w IS NOT DISTINCT FROM {c}" for c in covariates
    )
    own = " AND (lag(term_type) OVER w IS NULL OR lag(span_id) OVER w = span_id)" if terminal else ""
    return _ISLANDS_SQL.format(same=same, terminal=own, entity=entity, covariates=", ".join(covariates))


_EPISODE_COLUMNS = """strftime(start_date, '%G-W%V') AS start_week,
  strftime(end_week_date, '%G-W%V') AS end_week, start_date, end_week_date"""


def q_iso_week(spark, d):
    return load_table(spark, d, "orders").select(
        "o_orderkey", iso_week(F.col("o_orderdate")).alias("iso_week")
    )


def q_calendar(spark, d):
    return weeks.calendar(load_table(spark, d, "orders"), "o_orderdate")


def q_spans(spark, d):
    return order_spans(spark, d)


def q_neighbour_spans(spark, d):
    """Each span with the job codes before and after it."""
    spans = order_events(spark, d).select("entity", "span_id", "start_date", "job_cd")
    by = (["entity"], ["start_date", "span_id"], "job_cd")
    return next_value(previous_value(spans, *by, "previous_job"), *by, "next_job")


def q_weekly_episodes(spark, d):
    weekly = weeks.weekly_episodes(order_spans(spark, d), "start_date", "end_date", AS_OF)
    return weekly.select("entity", "span_id", "week_start", "iso_week")


def q_weekly_unique(spark, d):
    weekly = weeks.weekly_episodes(order_spans(spark, d), "start_date", "end_date", AS_OF)
    unique = weeks.weekly_unique(weekly, _ENTITY, "start_date", "span_id")
    return unique.select("entity", "span_id", "week_start", "iso_week")


def _long_spans(spark, d):
    """Spans that overlap: 60 or 400 days, or open, by status."""
    start, status = F.col("start_date"), F.col("status")
    end = F.when(status == "F", F.date_add(start, 60)).when(status == "P", F.date_add(start, 400))
    return order_events(spark, d).select("entity", "span_id", "start_date", end.alias("end_date"), "status")


def q_start_stop_overlapping(spark, d):
    return weeks.start_stop_from_spans(
        _long_spans(spark, d), _ENTITY, "start_date", "end_date", "span_id", AS_OF, ["status"]
    )


def q_start_stop_terminal(spark, d):
    """Episodes by kind of termination alone, so that only the terminal marker keeps spans apart."""
    return weeks.start_stop_from_spans(
        _typed_spans(spark, d), ["pers_id"], "start_date", "end_date", "span_id", AS_OF, ["term_type"], "term_type"
    )


def q_weekly_owned(spark, d):
    owned = weeks.weekly_owned(_long_spans(spark, d), _ENTITY, "start_date", "end_date", "span_id", AS_OF)
    return owned.select("entity", "span_id", "week_start", "iso_week")


def q_start_stop(spark, d):
    weekly = weeks.weekly_episodes(order_spans(spark, d), "start_date", "end_date", AS_OF)
    unique = weeks.weekly_unique(weekly, _ENTITY, "start_date", "span_id")
    return weeks.start_stop(unique, _ENTITY, ["job_cd"])


def q_start_stop_direct(spark, d):
    return weeks.start_stop_from_spans(
        order_spans(spark, d), _ENTITY, "start_date", "end_date", "span_id", AS_OF, ["job_cd"]
    )


def q_forward_fill(spark, d):
    events = load_table(spark, d, "events").select(
        "event_id", "ts", "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("job_cd"),
    )
    filled = forward_fill(events, ["user_id"], ["ts", "event_id"], {"filled_job_cd": "job_cd"})
    return filled.select("event_id", "user_id", "job_cd", "filled_job_cd")


def _typed_spans(spark, d):
    known = F.when(F.col("end_date") <= F.to_date(F.lit(AS_OF)), F.col("end_date"))
    spans = workforce_spans(spark, d).withColumn("end_date", known)
    return termination_type(spans, "term_cd", "end_date", TERMINATION_RULES)


_TYPED_SQL = f"""{WORKFORCE_SPANS_SQL},
censored AS (
  SELECT * REPLACE (CASE WHEN end_date <= DATE '{AS_OF}' THEN end_date END AS end_date) FROM ended),
typed AS (
  SELECT *, CASE WHEN end_date IS NOT NULL AND term_cd IS NOT NULL THEN
              CASE term_cd WHEN 'RES' THEN 'Vol' WHEN 'RET' THEN 'Vol' WHEN 'LAY' THEN 'Inv'
                           ELSE 'Unk' END END AS term_type
  FROM censored)"""


def q_survival_summary(spark, d):
    episodes = weeks.start_stop_from_spans(
        _typed_spans(spark, d), ["pers_id"], "start_date", "end_date", "span_id", AS_OF,
        ["salary", "job_cd", "term_type"],
    )
    return weeks.survival_summary(episodes, ["pers_id"])


def _led_weeks(spark, d):
    """Weekly rows with the manager (the nation) of each person."""
    ranges = weeks.week_ranges(
        _typed_spans(spark, d), ["pers_id"], "start_date", "end_date", "span_id", AS_OF
    )
    customer = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("pers_id"), F.col("c_nationkey").alias("manager")
    )
    led = ranges.join(customer, "pers_id")
    return weeks.expand_weeks(led).withColumns(
        {
            "tenure_weeks": F.datediff("week_start", "since_week") / 7,
            "leaving": F.col("term_type").isNotNull() & (F.col("week_start") == F.col("last_week")),
        }
    )


_LED_SQL = f"""{_TYPED_SQL},{WEEKLY_SQL.format(source="typed", entity="pers_id")},
led AS (
  SELECT u.*, c_nationkey AS manager,
         datediff('day', min(week_start) OVER (PARTITION BY pers_id), week_start) / 7 AS tenure_weeks,
         term_type IS NOT NULL AND week_start = max(week_start) OVER (PARTITION BY pers_id, span_id)
           AS leaving
  FROM uniq u JOIN customer ON pers_id = c_custkey)"""


def q_team_weekly(spark, d):
    team = teams.team_weekly(
        _led_weeks(spark, d), ["manager"], "salary", "tenure_weeks", "leaving"
    )
    return rounded(team)


def q_span_of_control(spark, d):
    return teams.span_of_control(_led_weeks(spark, d), ["manager"], "pers_id", 3, 60, True)


def q_keep_valid_managers(spark, d):
    weekly = _led_weeks(spark, d)
    valid = teams.span_of_control(weekly, ["manager"], "pers_id", 3, 60)
    kept = teams.keep_valid_managers(weekly, valid, ["manager"])
    return kept.groupBy("manager").agg(
        F.count(F.lit(1)).alias("person_weeks"), F.countDistinct("week_start").alias("n_weeks")
    )


def q_start_stop_dataset(spark, d):
    return rounded(start_stop_dataset(*workforce(spark, d)))


_FULL_TIME = {"1-URGENT": "Full time", "2-HIGH": "Full time", "3-MEDIUM": "Part time"}
_REGULAR = {"1-URGENT": "Regular", "5-LOW": "Temporary"}


def q_main_run(spark, d):
    """The whole run, from loads to the written table, read back."""
    inputs, settings = workforce(spark, d)
    episodes, _ = main_run(inputs, settings, work_dir(spark, "main"), _FULL_TIME, _REGULAR)
    return rounded(episodes)


def q_main_run_teams(spark, d):
    """The second table of the whole run: team figures of every week."""
    inputs, settings = workforce(spark, d)
    _, weekly = main_run(inputs, settings, work_dir(spark, "main"), _FULL_TIME, _REGULAR)
    return rounded(weekly)


_DATASET_SQL = f"""WITH {_TYPED_SQL},
active AS (
  SELECT t.* FROM typed t
  WHERE pers_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')),
{WEEKLY_SQL.format(source="active", entity="pers_id")},
{_islands("pers_id", ["salary", "job_cd", "term_type"], True)},
led AS (
  SELECT c_custkey AS pers_id,
         CASE WHEN c_nationkey = 0 THEN 'R' || n_regionkey ELSE CAST(c_nationkey AS VARCHAR) END
           AS mgr_sup_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
team_rows AS (
  SELECT mgr_sup_id, week_start, salary,
         datediff('day', min(week_start) OVER (PARTITION BY pers_id), week_start) / 7 AS tenure,
         term_type IS NOT NULL AND week_start = max(week_start) OVER (PARTITION BY pers_id, span_id)
           AS leaving
  FROM uniq JOIN led USING (pers_id)),
teams AS (
  SELECT mgr_sup_id, week_start, count(*) AS headcount,
         CAST(count(*) FILTER (WHERE leaving) AS BIGINT) AS leavers,
         CAST(sum(CAST(salary AS DECIMAL(28, 6))) AS DOUBLE) / count(*) AS mean_salary,
         round(stddev_samp(salary), 2) AS sd_salary,
         avg(tenure) AS mean_tenure_weeks
  FROM team_rows GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5000)
SELECT e.pers_id, salary, job_cd, term_type, {_EPISODE_COLUMNS}, l.mgr_sup_id,
       headcount, leavers, mean_salary, sd_salary, mean_tenure_weeks
FROM episodes e LEFT JOIN led l USING (pers_id)
LEFT JOIN teams t ON t.mgr_sup_id = l.mgr_sup_id AND t.week_start = e.start_date"""

# The whole run leaves out people who would manage themselves.
_MAIN_SQL = _DATASET_SQL.replace(
    "FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 0 OR c_nationkey <> c_custkey)")
_MAIN_RUN_SQL = f"""SELECT *, year(start_date)::INTEGER AS start_year,
  CASE WHEN job_cd IN ('1-URGENT', '2-HIGH') THEN 'Full time' WHEN job_cd = '3-MEDIUM' THEN 'Part time' ELSE 'Unknown' END AS working_time,
  CASE job_cd WHEN '1-URGENT' THEN 'Regular' WHEN '5-LOW' THEN 'Temporary' ELSE 'Unknown' END AS permanence
FROM ({_MAIN_SQL})"""
_MAIN_TEAMS_SQL = _MAIN_SQL[: _MAIN_SQL.index("SELECT e.pers_id")] + "SELECT * FROM teams"

_LONG_SPANS_SQL = """long_spans AS (
  SELECT o_custkey AS entity, o_orderkey AS span_id, CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 60
              WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 400 END AS end_date, o_orderstatus AS status
  FROM orders)"""

START_STOP_SQL = f"""WITH {SPANS_SQL},{_ORDER_WEEKS},{_islands("entity", ["job_cd"])}
SELECT entity, {_EPISODE_COLUMNS}, job_cd FROM episodes"""

QUERIES = {
    "iso_week": (
        q_iso_week,
        "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week FROM orders",
    ),
    "calendar": (
        q_calendar,
        """WITH days AS (
  SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE),
                                INTERVAL 1 DAY)) AS t FROM orders)
SELECT CAST(t AS DATE) AS day, strftime(t, '%G-W%V') AS iso_week,
       CAST(date_trunc('week', t) AS DATE) AS week_start,
       CAST(quarter(t) AS INTEGER) AS quarter, CAST(year(t) AS INTEGER) AS year FROM days""",
    ),
    "spans_from_events": (q_spans, f"WITH {SPANS_SQL} SELECT * FROM spans"),
    "neighbour_spans": (
        q_neighbour_spans,
        f"""WITH {SPANS_SQL}
SELECT entity, span_id, start_date, job_cd, lag(job_cd) OVER w AS previous_job,
       lead(job_cd) OVER w AS next_job
FROM spans WINDOW w AS (PARTITION BY entity ORDER BY start_date, span_id)""",
    ),
    "start_stop_overlapping": (
        q_start_stop_overlapping,
        f"""WITH {_LONG_SPANS_SQL},{WEEKLY_SQL.format(source="long_spans", entity="entity")},{_islands("entity", ["status"])}
SELECT entity, {_EPISODE_COLUMNS}, status FROM episodes""",
    ),
    "start_stop_terminal": (
        q_start_stop_terminal,
        f"""WITH {_TYPED_SQL},{WEEKLY_SQL.format(source="typed", entity="pers_id")},{_islands("pers_id", ["term_type"], True)}
SELECT pers_id, {_EPISODE_COLUMNS}, term_type FROM episodes""",
    ),
    "weekly_owned": (
        q_weekly_owned,
        f"""WITH {_LONG_SPANS_SQL},{WEEKLY_SQL.format(source="long_spans", entity="entity")}
SELECT entity, span_id, week_start, strftime(week_start, '%G-W%V') AS iso_week FROM uniq""",
    ),
    "weekly_episodes": (
        q_weekly_episodes,
        f"""WITH {SPANS_SQL},{_ORDER_WEEKS}
SELECT entity, span_id, week_start, strftime(week_start, '%G-W%V') AS iso_week FROM weekly""",
    ),
    "weekly_unique": (
        q_weekly_unique,
        f"""WITH {SPANS_SQL},{_ORDER_WEEKS}
SELECT entity, span_id, week_start, strftime(week_start, '%G-W%V') AS iso_week FROM uniq""",
    ),
    "start_stop": (q_start_stop, START_STOP_SQL),
    "start_stop_direct": (q_start_stop_direct, START_STOP_SQL),
    "forward_fill": (
        q_forward_fill,
        """SELECT event_id, user_id, nullif(event_type, 'error') AS job_cd,
       last_value(nullif(event_type, 'error') IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id) AS filled_job_cd FROM events""",
    ),
    "survival_summary": (
        q_survival_summary,
        f"""WITH {_TYPED_SQL},{WEEKLY_SQL.format(source="typed", entity="pers_id")}
SELECT pers_id, min(week_start) AS first_week, max(week_start) AS last_week,
       count(*) AS weeks_at_risk, arg_max_null(term_type, week_start) AS type,
       CAST(CASE WHEN arg_max_null(term_type, week_start) IS NULL THEN 0 ELSE 1 END AS INTEGER) AS event
FROM uniq GROUP BY pers_id""",
    ),
    "team_weekly": (
        q_team_weekly,
        f"""WITH {_LED_SQL}
SELECT manager, week_start, count(*) AS headcount, count(*) FILTER (WHERE leaving) AS leavers,
       CAST(sum(CAST(salary AS DECIMAL(28, 6))) AS DOUBLE) / count(*) AS mean_salary,
         round(stddev_samp(salary), 2) AS sd_salary,
       avg(tenure_weeks) AS mean_tenure_weeks
FROM led GROUP BY manager, week_start""",
    ),
    "span_of_control": (
        q_span_of_control,
        f"""WITH {_LED_SQL}
SELECT manager, week_start, count(DISTINCT pers_id) AS reports FROM led
GROUP BY manager, week_start HAVING count(DISTINCT pers_id) BETWEEN 3 AND 60""",
    ),
    "keep_valid_managers": (
        q_keep_valid_managers,
        f"""WITH {_LED_SQL},
valid AS (SELECT manager, week_start FROM led GROUP BY manager, week_start
          HAVING count(DISTINCT pers_id) BETWEEN 3 AND 60)
SELECT manager, count(*) AS person_weeks, count(DISTINCT week_start) AS n_weeks
FROM led SEMI JOIN valid USING (manager, week_start) GROUP BY manager""",
    ),
    "start_stop_dataset": (q_start_stop_dataset, _DATASET_SQL),
    "main_run": (q_main_run, _MAIN_RUN_SQL),
    "main_run_teams": (q_main_run_teams, _MAIN_TEAMS_SQL),
}
