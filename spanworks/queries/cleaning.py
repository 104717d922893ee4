"""Cleaning, filters, scalar functions and record normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanworks.functions import text
from spanworks.functions.dates import date_prefix
from spanworks.operators import clean, people
from spanworks.operators.report import first_columns
from spanworks.plans import chain
from spanworks.queries.mapping import (
    AS_OF,
    SPANS_SQL,
    TERMINATION_RULES,
    WEEKLY_SQL,
    WORKFORCE_SPANS_SQL,
    order_events,
    order_spans,
    workforce_hierarchy,
    workforce_spans,
)
from spanworks.sources.tables import load_table

_FULL_TIME = {"1-URGENT": "Full-time", "2-HIGH": "Full-time", "3-MEDIUM": "Part-time"}
_PERMANENCE = {"1-URGENT": "Regular", "3-MEDIUM": "Regular", "5-LOW": "Temporary"}


def q_lower_case_names(spark, d):
    shouted = load_table(spark, d, "orders").toDF(
        "O_OrderKey", "O_CustKey", "O_ORDERSTATUS", "O_TotalPrice", "O_OrderDate", "O_ORDERPRIORITY"
    )
    return clean.lower_case_names(shouted)


def q_filter_sources(spark, d):
    events = load_table(spark, d, "events").withColumnRenamed("event_type", "source")
    return clean.filter_sources(events, ["click", "view"]).select("event_id", "user_id", "source")


def q_filter_live_primary(spark, d):
    orders = load_table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "ended")
        .alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") < "3").alias("primary"),
    )
    return clean.filter_live_primary(orders)


def q_timestamp_to_dates(spark, d):
    events = load_table(spark, d, "events").select("event_id", F.col("ts").alias("timestamp"))
    return clean.timestamp_to_dates(events).select("event_id", "date")


def q_clean_end_dates(spark, d):
    return clean.with_clean_end_dates(order_spans(spark, d)).select(
        "entity", "span_id", "end_date", "clean_end_date"
    )


def q_clean_strings(spark, d):
    return clean.clean_strings(load_table(spark, d, "documents"))


def q_parse_dates(spark, d):
    day = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    written = load_table(spark, d, "orders").select(
        "o_orderkey",
        F.when(status == "F", F.date_format(day, "yyyy-MM-dd"))
        .when(status == "O", F.date_format(day, "dd/MM/yyyy"))
        .otherwise("n/a").alias("written"),
    )
    parsed = clean.parse_dates(written, "written", ["yyyy-MM-dd", "dd/MM/yyyy"], "parsed")
    return parsed.withColumn("parsed", F.to_date("parsed"))


def q_date_prefix(spark, d):
    stamped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    written = F.when(F.col("l_returnflag") == "A", stamped).when(
        F.col("l_returnflag") == "N", F.date_format("l_shipdate", "yyyy-MM")
    )
    return load_table(spark, d, "lineitem").groupBy(
        "l_returnflag", date_prefix(written).alias("prefix")
    ).agg(F.count(F.lit(1)).alias("n"))


def q_cell_truncate(spark, d):
    return load_table(spark, d, "documents").select(
        "doc_id", text.truncate_cell(F.col("text")).alias("cell")
    )


def q_format_numbers(spark, d):
    return load_table(spark, d, "orders").select(
        "o_orderkey",
        text.with_thousands(
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") * 1000)
        ).alias("shown"),
    )


def q_name_parts(spark, d):
    """Schema and table of dotted names: segment and customer name; one segment has no dot."""
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(
        F.concat_ws(".", F.lower("c_mktsegment"), "c_name")
    )
    return load_table(spark, d, "customer").select(
        "c_custkey",
        text.name_part(name, "schema").alias("schema_name"),
        text.name_part(name, "table").alias("short_name"),
        text.anchor_link(name, F.col("c_acctbal") > 0).alias("link"),
    )


def q_sample_rows(spark, d):
    return load_table(spark, d, "lineitem").orderBy(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"
    ).limit(5)


def q_sample_first_columns(spark, d):
    return first_columns(q_sample_rows(spark, d))


def q_clean_terminations(spark, d):
    """Spans whose end is made wrong for one status; two records per span on some days."""
    spans = workforce_spans(spark, d).withColumn(
        "end_date",
        F.when(F.col("status") == "P", F.date_sub("start_date", 3)).otherwise(F.col("end_date")),
    ).withColumn("term_cd", F.coalesce("term_cd", F.lit("ZZZ")))
    return people.clean_terminations(
        spans, ["pers_id"], "start_date", "end_date", "term_cd", ["span_id"]
    )


def q_ongoing_start_fix(spark, d):
    fixed = people.ongoing_start_fix(order_spans(spark, d), "start_date", "end_date", "1999-01-01")
    return fixed.select("entity", "span_id", "start_date", "end_date", "effective_start")


def q_employment_class(spark, d):
    spans = order_events(spark, d).select("span_id", "job_cd")
    return people.employment_class(spans, "job_cd", _FULL_TIME, _PERMANENCE)


def q_termination_type(spark, d):
    spans = workforce_spans(spark, d).withColumn(
        "term_cd", F.when(F.col("job_cd") == "5-LOW", "ZZZ").otherwise(F.col("term_cd"))
    )
    return people.termination_type(spans, "term_cd", "end_date", TERMINATION_RULES).select(
        "pers_id", "span_id", "end_date", "term_cd", "term_type"
    )


def q_mgr_sup_id(spark, d):
    return people.mgr_sup_id(workforce_hierarchy(spark, d), "mgr_id", "sup_id", ["0", "7"])


def q_known_issues(spark, d):
    """Default managers to null, and a flag for customers without a large order (optional data)."""
    orders = load_table(spark, d, "orders").filter("o_totalprice > 495000")
    largest = orders.groupBy(F.col("o_custkey").alias("pers_id")).agg(
        F.max("o_totalprice").alias("commute")
    )
    joined = workforce_hierarchy(spark, d).join(largest, "pers_id", "left")
    flagged = people.missing_flags(joined, ["commute"])
    return people.null_default_ids(flagged, ["mgr_id"], ["000000"])


def q_union_datasets(spark, d):
    """A training part and a prediction part that lacks the target column."""
    spans = order_spans(spark, d)
    training = spans.filter("end_date IS NOT NULL").select("entity", "span_id", "end_date")
    prediction = spans.filter("end_date IS NULL").select("entity", "span_id")
    return chain.union_datasets({"training": training, "prediction": prediction})


def q_transform_chain(spark, d):
    """Names, sources, live and primary, dates, ends, terminations, weeks, fill, manager id."""
    orders = load_table(spark, d, "orders").select(
        F.col("o_custkey").alias("Pers_Id"), F.col("o_orderkey").alias("SPAN_ID"),
        F.col("o_orderpriority").alias("Source"),
        F.when(F.col("o_orderstatus") != "P", "live").otherwise("closed").alias("Status"),
        (F.col("o_totalprice") > 20000).alias("Primary"),
        F.col("o_orderdate").alias("Timestamp"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 60)).alias("End_Date"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("Job_Cd"),
        F.when(F.col("o_orderstatus") == "F", "RES").alias("Term_Cd"),
        F.lpad((F.col("o_custkey") % 25).cast("string"), 6, "0").alias("Mgr_Id"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 5).cast("string")).alias("Sup_Id"),
    )
    steps = [
        ("lower_case_names", chain.lower_case_names()),
        ("filter_sources", chain.filter_sources(["1-URGENT", "2-HIGH", "5-LOW"])),
        ("filter_live_primary", chain.filter_live_primary()),
        ("timestamp_to_dates", chain.timestamp_to_dates()),
        ("with_clean_end_dates", chain.with_clean_end_dates()),
        ("with_clean_terminations",
         chain.with_clean_terminations(["pers_id"], "date", "end_date", "term_cd", ["span_id"])),
        ("with_weekly_episodes",
         chain.with_weekly_episodes(["pers_id"], "date", "end_date", "span_id", AS_OF)),
        ("with_forward_filled_job_cd", chain.with_forward_filled_job_cd(["pers_id"])),
        ("with_mgr_sup_id", chain.with_mgr_sup_id("mgr_id", "sup_id", ["0"])),
    ]
    return chain.run_chain(orders, steps).select(
        "pers_id", "span_id", "week_start", "iso_week", "job_cd", "term_cd", "clean_end_date",
        "mgr_sup_id",
    )


_WS = r"'[ \t\n\f\r]+', ' ', 'g'"

QUERIES = {
    "lower_case_names": (q_lower_case_names, "SELECT * FROM orders"),
    "filter_sources": (
        q_filter_sources,
        "SELECT event_id, user_id, event_type AS source FROM events WHERE event_type IN ('click', 'view')",
    ),
    "filter_live_primary": (
        q_filter_live_primary,
        """SELECT o_orderkey, 'live' AS status, true AS "primary" FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderpriority < '3'""",
    ),
    "timestamp_to_dates": (
        q_timestamp_to_dates, "SELECT event_id, CAST(ts AS DATE) AS date FROM events"
    ),
    "clean_end_dates": (
        q_clean_end_dates,
        f"""WITH {SPANS_SQL}
SELECT entity, span_id, end_date, coalesce(end_date, DATE '9999-12-31') AS clean_end_date FROM spans""",
    ),
    "clean_strings": (
        q_clean_strings,
        f"""SELECT doc_id, nullif(trim(regexp_replace(text, {_WS})), '') AS text,
       nullif(trim(regexp_replace(lang, {_WS})), '') AS lang,
       nullif(trim(regexp_replace(source, {_WS})), '') AS source, n_chars FROM documents""",
    ),
    "parse_dates": (
        q_parse_dates,
        """SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                     WHEN 'O' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'n/a' END AS written,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS DATE) END AS parsed,
  o_orderstatus NOT IN ('F', 'O') AS parsed_failed FROM orders""",
    ),
    "date_prefix": (
        q_date_prefix,
        """SELECT l_returnflag,
  CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m-%d')
                    WHEN 'N' THEN strftime(l_shipdate, '%Y-%m') ELSE '-' END AS prefix,
  count(*) AS n FROM lineitem GROUP BY ALL""",
    ),
    "cell_truncate": (
        q_cell_truncate,
        """SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS cell
FROM documents""",
    ),
    "format_numbers": (
        q_format_numbers,
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN format('{:,}', o_orderkey * 1000)
                        ELSE '-' END AS shown FROM orders""",
    ),
    "name_parts": (
        q_name_parts,
        """WITH named AS (
  SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name
                 ELSE lower(c_mktsegment) || '.' || c_name END AS name FROM customer)
SELECT c_custkey, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE 'unknown' END
         AS schema_name,
       split_part(name, '.', -1) AS short_name,
       CASE WHEN c_acctbal > 0 THEN '[' || name || '](#' || translate(name, '._', '--') || ')'
            ELSE name END AS link
FROM named""",
    ),
    "sample_rows": (
        q_sample_rows,
        """SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey LIMIT 5""",
    ),
    "sample_first_columns": (
        q_sample_first_columns,
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, 'Note: Showing first 8 of 11 columns' AS note FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey LIMIT 5""",
    ),
    "clean_terminations": (
        q_clean_terminations,
        f"""WITH {WORKFORCE_SPANS_SQL},
wrong AS (
  SELECT * REPLACE (CASE WHEN status = 'P' THEN start_date - 3 ELSE end_date END AS end_date,
                    coalesce(term_cd, 'ZZZ') AS term_cd) FROM ended),
fixed AS (
  SELECT * REPLACE (CASE WHEN end_date >= start_date THEN end_date END AS end_date,
                    CASE WHEN end_date >= start_date THEN term_cd END AS term_cd) FROM wrong)
SELECT * FROM fixed
QUALIFY row_number() OVER (PARTITION BY pers_id, start_date ORDER BY span_id DESC) = 1""",
    ),
    "ongoing_start_fix": (
        q_ongoing_start_fix,
        f"""WITH {SPANS_SQL}
SELECT entity, span_id, start_date, end_date,
       CASE WHEN end_date IS NULL THEN greatest(start_date, DATE '1999-01-01') ELSE start_date END
         AS effective_start FROM spans""",
    ),
    "employment_class": (
        q_employment_class,
        """SELECT o_orderkey AS span_id, o_orderpriority AS job_cd,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Full-time'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Part-time' ELSE 'Unknown' END AS working_time,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'Regular'
       WHEN o_orderpriority = '5-LOW' THEN 'Temporary' ELSE 'Unknown' END AS permanence
FROM orders""",
    ),
    "termination_type": (
        q_termination_type,
        f"""WITH {WORKFORCE_SPANS_SQL},
coded AS (SELECT * REPLACE (CASE WHEN job_cd = '5-LOW' THEN 'ZZZ' ELSE term_cd END AS term_cd) FROM ended)
SELECT pers_id, span_id, end_date, term_cd,
       CASE WHEN end_date IS NOT NULL AND term_cd IS NOT NULL THEN
         CASE WHEN term_cd IN ('RES', 'RET') THEN 'Vol' WHEN term_cd = 'LAY' THEN 'Inv' ELSE 'Unk' END
       END AS term_type FROM coded""",
    ),
    "mgr_sup_id": (
        q_mgr_sup_id,
        """SELECT c_custkey AS pers_id, lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS mgr_id,
       ' R' || n_regionkey AS sup_id,
       CASE WHEN c_nationkey IN (0, 7) THEN 'R' || n_regionkey
            ELSE CAST(c_nationkey AS VARCHAR) END AS mgr_sup_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "known_issues": (
        q_known_issues,
        """SELECT c_custkey AS pers_id,
       CASE WHEN c_nationkey <> 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 6, '0') END AS mgr_id,
       ' R' || n_regionkey AS sup_id, commute, commute IS NULL AS is_missing_commute
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS commute FROM orders WHERE o_totalprice > 495000
           GROUP BY o_custkey) ON o_custkey = c_custkey""",
    ),
    "union_datasets": (
        q_union_datasets,
        f"""WITH {SPANS_SQL}
SELECT entity, span_id, end_date, 'training' AS dataset FROM spans WHERE end_date IS NOT NULL
UNION ALL SELECT entity, span_id, NULL, 'prediction' FROM spans WHERE end_date IS NULL""",
    ),
    "transform_chain": (
        q_transform_chain,
        f"""WITH raw AS (
  SELECT o_custkey AS pers_id, o_orderkey AS span_id, CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 60 END AS end_date,
         CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS job_cd,
         CASE WHEN o_orderstatus = 'F' THEN 'RES' END AS term_cd
  FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus <> 'P'
    AND o_totalprice > 20000),
last_record AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY pers_id, start_date ORDER BY span_id DESC) = 1),
{WEEKLY_SQL.format(source="last_record", entity="pers_id")}
SELECT pers_id, span_id, week_start, strftime(week_start, '%G-W%V') AS iso_week,
       last_value(job_cd IGNORE NULLS) OVER (PARTITION BY pers_id ORDER BY week_start) AS job_cd,
       term_cd, coalesce(end_date, DATE '9999-12-31') AS clean_end_date,
       CASE WHEN pers_id % 25 = 0 THEN 'R' || (pers_id % 5) ELSE CAST(pers_id % 25 AS VARCHAR) END
         AS mgr_sup_id
FROM uniq""",
    ),
}
