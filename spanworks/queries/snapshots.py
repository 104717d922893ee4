"""Snapshots written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanworks.operators.weeks import start_stop_from_spans
from spanworks.queries.episodes import START_STOP_SQL
from spanworks.queries.mapping import AS_OF, order_spans
from spanworks.sinks.episodes import write_start_stop
from spanworks.sinks.snapshot import (
    SnapshotConfig,
    SnapshotSaver,
    read_snapshot,
    summarize_log,
)
from spanworks.sources.tables import load_table, local_rows
from spanworks.workdir import work_dir


def _saver(spark, **settings) -> SnapshotSaver:
    return SnapshotSaver(SnapshotConfig(work_dir(spark, "snapshots"), **settings))


def large_orders(df):
    return df.filter("o_totalprice > 250000")


def failed_events():
    return lambda df: df.filter("event_type = 'error'")


def _reread(spark, saver, schema, position=-1):
    path = saver.saves_log[position][3]
    return read_snapshot(spark, path, saver.config.save_format, schema)


def _round_trip(table: str, kind: str, change=None):
    def run(spark, d):
        df = load_table(spark, d, table)
        df = change(df) if change else df
        saver = _saver(spark, save_format=kind)
        keep = saver.save_transform()(lambda x: x)
        df.transform(keep)
        return _reread(spark, saver, df.schema)

    return run


def q_snapshot_after(spark, d):
    saver = _saver(spark)
    result = load_table(spark, d, "orders").transform(saver.save_transform()(large_orders))
    return _reread(spark, saver, result.schema)


def q_snapshot_before(spark, d):
    saver = _saver(spark, when="before")
    orders = load_table(spark, d, "orders")
    orders.transform(saver.save_transform()(large_orders))
    return _reread(spark, saver, orders.schema)


def q_snapshot_both(spark, d):
    """A decorated factory; both snapshots are read back and tagged."""
    saver = _saver(spark, when="both")
    events = load_table(spark, d, "events")
    events.transform(saver.save_transform()(failed_events)())
    parts = [
        _reread(spark, saver, events.schema, i).select("event_id", F.lit(phase).alias("phase"))
        for i, phase in enumerate(("before", "after"))
    ]
    return parts[0].unionByName(parts[1])


def q_snapshot_append(spark, d):
    """Two saves into one path."""
    saver = _saver(spark, save_mode="append", include_timestamp=False)
    keep = saver.save_transform()(large_orders)
    orders = load_table(spark, d, "orders")
    orders.transform(keep)
    orders.transform(keep)
    return _reread(spark, saver, orders.schema)


def q_snapshot_ignore(spark, d):
    """A second save into the same path, of other rows, is ignored."""
    saver = _saver(spark, save_mode="ignore", include_timestamp=False)
    orders = load_table(spark, d, "orders")
    orders.transform(saver.save_transform()(large_orders))
    orders.filter("o_orderstatus = 'F'").transform(saver.save_transform()(large_orders))
    return _reread(spark, saver, orders.schema, 0)


def q_snapshot_error(spark, d):
    """A second save into the same path is refused, and the first stays."""
    saver = _saver(spark, save_mode="error", include_timestamp=False)
    orders = load_table(spark, d, "orders")
    orders.transform(saver.save_transform()(large_orders))
    try:
        orders.filter("o_orderstatus = 'F'").transform(saver.save_transform()(large_orders))
        refused = False
    except AnalysisException:
        refused = True
    return _reread(spark, saver, orders.schema, 0).withColumn("refused", F.lit(refused))


def q_snapshot_layout(spark, d):
    """Where snapshots lie: function, time and phase; the time is written as one word here."""
    saver = _saver(spark)
    orders, events = load_table(spark, d, "orders"), load_table(spark, d, "events")
    orders.transform(saver.save_transform(when="both")(large_orders))
    events.transform(saver.save_transform(when="before")(failed_events)())
    orders.transform(saver.save_transform()(large_orders))
    orders.transform(saver.save_transform(include_timestamp=False, partitions=3)(large_orders))
    below = F.substring("path", len(saver.config.save_path.rstrip("/")) + 2, 1000)
    files = [
        (path, len({r.file for r in read_snapshot(spark, path, "parquet", orders.schema if "orders" in name else events.schema)
                   .select(F.col("_metadata.file_path").alias("file")).distinct().collect()}) == 3 and "large_orders/large_orders" == path[-25:])
        for name, _, _, path, _ in saver.saves_log]
    three = local_rows(spark, files, "path string, three_files boolean")
    return saver.get_saves_summary(spark).join(three, "path").select(
        F.regexp_replace(below, r"\d{8}_\d{6}_[0-9a-f]{8}", "time").alias("place"), "phase", "row_count", "three_files")


def q_snapshot_settings(spark, d):
    """Settings shared by decorators: one saves what goes in, the other what comes out."""
    config = SnapshotConfig(work_dir(spark, "snapshots"), save_format="orc", include_timestamp=False)
    orders = load_table(spark, d, "orders")
    orders.transform(config.get_decorator("before")(large_orders))
    orders.transform(config.get_decorator()(large_orders))
    path = f"{config.save_path}/large_orders/large_orders"
    parts = [
        read_snapshot(spark, path + suffix, "orc", orders.schema).withColumn("saved", F.lit(name))
        for name, suffix in (("before", "_before"), ("after", ""))]
    return parts[0].unionByName(parts[1])


def q_snapshot_coalesced(spark, d):
    saver = _saver(spark, coalesce_partitions=2)
    orders = load_table(spark, d, "orders")
    orders.transform(saver.save_transform()(large_orders))
    return _reread(spark, saver, orders.schema).select("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("file_path") <= 2).alias("few_files")
    )


def q_snapshot_reread(spark, d):
    """Two steps, the second continuing from the files of the first."""
    saver = _saver(spark, reuse="reread")
    orders = load_table(spark, d, "orders")
    return orders.transform(saver.save_transform()(large_orders)).filter("o_orderstatus = 'F'")


def _three_saves(spark, d):
    saver = _saver(spark, when="both")
    load_table(spark, d, "orders").transform(saver.save_transform()(large_orders))
    load_table(spark, d, "events").transform(saver.save_transform(when="after")(failed_events)())
    return saver.get_saves_summary(spark)


def q_snapshot_log(spark, d):
    return _three_saves(spark, d).select("function", "phase", "row_count")


def q_snapshot_summary(spark, d):
    return summarize_log(_three_saves(spark, d)).drop("last_ts")


def q_start_stop_sink(spark, d):
    """The final table, one folder per start year, read back."""
    episodes = start_stop_from_spans(
        order_spans(spark, d), ["entity"], "start_date", "end_date", "span_id", AS_OF, ["job_cd"]
    )
    path = work_dir(spark, "episodes")
    write_start_stop(episodes, path)
    return spark.read.parquet(path).groupBy("start_year").agg(
        F.count(F.lit(1)).alias("episodes"), F.countDistinct("entity").alias("entities")
    )


def _with_blanks(df):
    """Nulls, empty texts, quotes and line breaks, all of which a text format must keep apart."""
    return df.withColumn(
        "lang",
        F.when(F.col("lang") == "fr", F.lit(None)).when(F.col("lang") == "es", "")
        .when(F.col("lang") == "de", F.lit('a "quoted", \\ text\nin two lines'))
        .otherwise(F.col("lang")),
    )


_BLANKS_SQL = """SELECT * REPLACE (
  CASE lang WHEN 'fr' THEN NULL WHEN 'es' THEN '' WHEN 'de' THEN 'a "quoted", \\ text' || chr(10) || 'in two lines'
            ELSE lang END AS lang) FROM documents"""
_LARGE = "SELECT * FROM orders WHERE o_totalprice > 250000"
_LOG_SQL = """saves AS (
  SELECT 'large_orders' AS function, 'before' AS phase, count(*) AS row_count FROM orders
  UNION ALL SELECT 'large_orders', 'after', count(*) FROM orders WHERE o_totalprice > 250000
  UNION ALL SELECT 'failed_events', 'after', count(*) FROM events WHERE event_type = 'error')"""


QUERIES = {
    "snapshot_error": (q_snapshot_error, "SELECT *, true AS refused FROM orders WHERE o_totalprice > 250000"),
    "snapshot_layout": (
        q_snapshot_layout,
        """WITH sizes AS (SELECT (SELECT count(*) FROM orders) AS every, (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS large, (SELECT count(*) FROM events) AS events)
SELECT 'large_orders/large_orders_time_before' AS place, 'before' AS phase, every AS row_count, false AS three_files FROM sizes
UNION ALL SELECT 'large_orders/large_orders_time_after', 'after', large, false FROM sizes
UNION ALL SELECT 'failed_events/failed_events_time_before', 'before', events, false FROM sizes
UNION ALL SELECT 'large_orders/large_orders_time', 'after', large, false FROM sizes
UNION ALL SELECT 'large_orders/large_orders', 'after', large, true FROM sizes""",
    ),
    "snapshot_settings": (
        q_snapshot_settings,
        """SELECT *, 'before' AS saved FROM orders UNION ALL SELECT *, 'after' FROM orders WHERE o_totalprice > 250000""",
    ),
    "snapshot_after": (q_snapshot_after, _LARGE),
    "snapshot_before": (q_snapshot_before, "SELECT * FROM orders"),
    "snapshot_both": (
        q_snapshot_both,
        """SELECT event_id, 'before' AS phase FROM events
UNION ALL SELECT event_id, 'after' FROM events WHERE event_type = 'error'""",
    ),
    "snapshot_append": (q_snapshot_append, f"{_LARGE} UNION ALL {_LARGE}"),
    "snapshot_ignore": (q_snapshot_ignore, _LARGE),
    "snapshot_coalesced": (
        q_snapshot_coalesced, f"SELECT count(*) AS n, true AS few_files FROM ({_LARGE})"
    ),
    "snapshot_reread": (q_snapshot_reread, f"{_LARGE} AND o_orderstatus = 'F'"),
    "snapshot_csv_roundtrip": (_round_trip("documents", "csv", _with_blanks), _BLANKS_SQL),
    "snapshot_csv_nested": (
        _round_trip("embeddings", "csv"), "SELECT * FROM embeddings"
    ),
    "snapshot_parquet_roundtrip": (_round_trip("orders", "parquet"), "SELECT * FROM orders"),
    "snapshot_json_roundtrip": (_round_trip("events", "json"), "SELECT * FROM events"),
    "snapshot_orc_roundtrip": (_round_trip("orders", "orc"), "SELECT * FROM orders"),
    "snapshot_log": (q_snapshot_log, f"WITH {_LOG_SQL} SELECT * FROM saves"),
    "snapshot_summary": (
        q_snapshot_summary,
        f"""WITH {_LOG_SQL}
SELECT function, count(*) AS saves, arg_min(row_count, phase) AS last_row_count
FROM saves GROUP BY function""",
    ),
    "start_stop_sink": (
        q_start_stop_sink,
        f"""SELECT CAST(year(start_date) AS INTEGER) AS start_year, count(*) AS episodes,
       count(DISTINCT entity) AS entities FROM ({START_STOP_SQL}) GROUP BY 1""",
    ),
}
