"""Audit of the test tables under neutral names, name rules, and the reports."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.operators import audit, classify, quality, report
from spanworks.operators.classify import Rule
from spanworks.sinks.reports import write_report_set
from spanworks.sources.tables import (
    column_catalog,
    flatten_table_list,
    literal,
    load_table,
    local_rows,
    quote,
    register_tables,
    table_list,
)
from spanworks.workdir import work_dir

SCHEMAS = {
    "sales": ["customer", "orders", "lineitem", "part", "supplier"],
    "geo": ["nation", "region"],
    "stream": ["events"],
    "text": ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"],
}
# Three tables do not exist: sales.returns, geo.city, text.summaries.
TABLE_LIST = {
    "core": [
        ("sales.customer", "Buyers"), ("sales.orders", "Orders"), ("sales.lineitem", "Order lines"),
        ("sales.part", "Parts"), ("sales.supplier", "Suppliers"), ("sales.returns", "Returned goods"),
    ],
    "reference": [
        ("geo.nation", "Nations"), ("geo.region", "Regions"), ("geo.city", "Cities"),
    ],
    "feeds": [("stream.events", "Web events")],
    "corpus": [
        ("text.documents", "Prose"), ("text.pages", "Web pages"), ("text.benchmark", "Test items"),
        ("text.labels", "Ratings"), ("text.conversations", "Dialogues"),
        ("text.embeddings", "Vectors"), ("text.summaries", "Abstracts"),
    ],
    "repeat": [("sales.customer", "All buyers"), ("sales.orders", "All orders")],
}
STAGE_RULES = (
    Rule(("sales",), {"pipeline_stage": "Processed", "data_source": "Shop", "migration_priority": "Critical"}),
    Rule(("geo",), {"pipeline_stage": "Raw", "data_source": "Atlas", "migration_priority": "High"}),
    Rule(("text",), {"pipeline_stage": "Landing", "data_source": "Crawl", "migration_priority": "Medium"}),
)
PURPOSE_RULES = (
    Rule(("customer", "supplier"), {"business_purpose": "Partners"}),
    Rule(("order", "line"), {"business_purpose": "Transactions"}),
    Rule(("nation", "region"), {"business_purpose": "Places"}),
)
CATEGORY_RULES = (
    Rule(("sales.", "stream."), {"report_category": "Business Tables"}),
    Rule(("geo.",), {"report_category": "Place Tables"}),
)
SAMPLE_KEYS = {
    "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"],
    "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"],
    "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
}
ALL_TABLES = [t for names in SCHEMAS.values() for t in names]


def _source(spark, d):
    """External tables over the parquet files, in schemas named after the directory."""
    prefix = f"sw_{hashlib.md5(d.encode()).hexdigest()[:8]}_"
    return register_tables(
        spark, d, SCHEMAS, prefix, work_dir(spark, "schemas"), {"purpose": "audit"}
    )


def _entries(spark) -> DataFrame:
    return flatten_table_list(table_list(spark, TABLE_LIST))


def _audit(spark, d, **options) -> DataFrame:
    return audit.audit_tables(_source(spark, d), _entries(spark), **options)


def _tables(spark, d) -> dict[str, DataFrame]:
    return {t: load_table(spark, d, t) for t in ALL_TABLES}


def _counts(spark, d) -> DataFrame:
    """Row counts under the listed names."""
    names = {f"{s}.{t}": load_table(spark, d, t) for s, ts in SCHEMAS.items() for t in ts}
    return audit.row_counts(spark, names)


def q_table_row_counts(spark, d):
    return audit.row_counts(spark, _tables(spark, d))


def q_column_catalog(spark, d):
    """Columns of all tables beside the row count of their table."""
    tables = _tables(spark, d)
    columns = column_catalog(spark, tables).select("table_name", "ordinal", "column_name")
    return columns.join(audit.row_counts(spark, tables), "table_name")


def q_column_counts(spark, d):
    tables = _tables(spark, d)
    counts = column_catalog(spark, tables).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count")
    )
    return counts.join(audit.row_counts(spark, tables), "table_name")


def _named_columns(spark, d, rule) -> dict[str, list[str]]:
    """Columns of each table whose name fits a rule, found from the schemas alone."""
    catalog = column_catalog(spark, _tables(spark, d))
    hits: dict[str, list[str]] = {}
    for row in catalog.filter(rule(F.col("column_name"))).orderBy("table_name", "ordinal").collect():
        hits.setdefault(row["table_name"], []).append(row["column_name"])
    return hits


def _union_by_table(spark, d, rule, measure) -> DataFrame:
    parts = [
        measure(load_table(spark, d, t), columns).select(F.lit(t).alias("table_name"), "*")
        for t, columns in _named_columns(spark, d, rule).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def q_key_candidates(spark, d):
    """Columns named like keys, and whether their values are in fact unique."""
    return _union_by_table(spark, d, classify.is_key_name, quality.uniqueness)


def q_date_columns(spark, d):
    """Columns named like dates, with nulls and whether the declared type is a time type."""
    def measure(df, columns):
        times = [f.name for f in df.schema.fields if "time" in f.dataType.typeName() or f.dataType.typeName() == "date"]
        rows = quality.nullity_stats(df.select(*columns)).drop("null_share")
        return rows.withColumn("is_time_type", F.col("column_name").isin(times))

    return _union_by_table(spark, d, classify.is_date_name, measure)


def q_important_columns(spark, d):
    return _union_by_table(spark, d, classify.is_important_name, quality.distinct_counts)


def q_flatten_table_list(spark, d):
    return _entries(spark).join(_counts(spark, d), "table_name", "left")


def q_distinct_tables(spark, d):
    return audit.distinct_tables(_entries(spark)).join(_counts(spark, d), "table_name", "left")


def q_catalog_presence(spark, d):
    source = _source(spark, d)
    names = [name for tables in TABLE_LIST.values() for name, _ in tables]
    present = audit.catalog_presence(_entries(spark), source.listing(names))
    return present.drop("position", "description").join(_counts(spark, d), "table_name", "left")


def q_table_properties(spark, d):
    """Properties of all tables beside their row counts."""
    source = _source(spark, d)
    parts = [source.properties(f"{s}.{t}") for s, names in SCHEMAS.items() for t in names]
    properties = reduce(DataFrame.unionAll, parts)
    return properties.select("table_name", F.col("properties")["purpose"].alias("purpose")).join(
        _counts(spark, d), "table_name"
    )


_CHANGED = "2024-03-01 05:06:07"


def q_table_times(spark, d):
    """Tables registered with a known time of change; they were created since the session began."""
    prefix = f"swt_{hashlib.md5(d.encode()).hexdigest()[:8]}_"
    known = {"purpose": "times", "last_modified_time": _CHANGED.replace(" ", "T")}
    source = register_tables(spark, d, SCHEMAS, prefix, work_dir(spark, "schemas"), known)
    names = [f"{s}.{t}" for s, ts in SCHEMAS.items() for t in ts]
    begun = datetime.fromtimestamp(spark.sparkContext.startTime / 1000, timezone.utc)
    rows = []
    for name in names:
        _, created, updated = source.details(name)
        created = created if created is None or created.tzinfo else created.replace(tzinfo=timezone.utc)
        lately = created is not None and begun.replace(microsecond=0) <= created <= datetime.now(timezone.utc)
        rows.append((name, lately, updated.strftime("%Y-%m-%d %H:%M:%S") if updated else None))
    times = local_rows(spark, rows, "table_name string, created_in_session boolean, updated_at string")
    return times.join(_counts(spark, d), "table_name").select("table_name", "row_count", "created_in_session", "updated_at")


def q_audit_tables(spark, d):
    return _audit(spark, d, isolate=False).select(
        "table_name", "schema_name", "short_name", "description", "exists", "accessible",
        "error_class", "row_count", "column_count", F.concat_ws(", ", "columns").alias("column_names"),
    )


def q_audit_isolated(spark, d):
    """The same audit with counts taken table by table where one fails, and the keys of the rows sampled in key order."""
    order = {f"{s}.{t}": SAMPLE_KEYS[t] for s, ts in SCHEMAS.items() for t in ts}
    audited = _audit(spark, d, sample_rows=5, sample_order=order)
    key = F.create_map(*[F.lit(x) for name, columns in order.items() for x in (name, columns[0])])[F.col("table_name")]
    keys = F.transform("sample", lambda r: F.from_json(r, "map<string,string>")[key])
    return audited.select("table_name", "row_count", F.array_join(keys, ";").alias("sampled"))


def q_audit_unreadable(spark, d):
    """The audit with a table of broken files among the others: it alone has no count."""
    source = _source(spark, d)
    path = f"{work_dir(spark, 'broken')}/broken.parquet"
    spark.range(9).selectExpr("repeat(cast(id AS string), 99) AS value").write.text(path)
    name = source.full_name("stream.broken")
    spark.sql(f"DROP TABLE IF EXISTS {quote(name)}")
    spark.sql(f"CREATE TABLE {quote(name)} (a INT) USING parquet LOCATION {literal(path)}")
    listed = {**TABLE_LIST, "broken": [("stream.broken", "Broken files")]}
    entries = flatten_table_list(table_list(spark, listed))
    audited = audit.audit_tables(source, entries)
    spark.sql(f"DROP TABLE {quote(name)}")
    return audited.select("table_name", "accessible", "row_count", (F.col("accessible") & F.col("error").isNotNull()).alias("failed"))


def q_audit_single(spark, d):
    """The audit of one table, under its qualified name, with the time of the check."""
    source = _source(spark, d)
    audited = audit.audit_table(source, "sales.lineitem", "Order lines", 0)
    qualified = source.full_name("sales.lineitem").rpartition(".")[2]
    return audited.select(
        "table_name", F.lit(qualified).alias("qualified"), "description", "accessible", "row_count", "column_count",
        (F.abs(F.timestamp_diff("MINUTE", F.col("check_time"), F.current_timestamp())) < 1440).alias("checked_today"))


def q_run_audit(spark, d):
    """The audit of the whole list with its summary per category, joined."""
    audited, summary = audit.run_audit(_source(spark, d), TABLE_LIST, 0)
    rows = _entries(spark).join(audited.select("table_name", "row_count"), "table_name")
    return rows.groupBy("category").agg(F.sum("row_count").alias("rows")).join(summary, "category")


def q_report_headers(spark, d):
    """The main report under its printed headers."""
    return report.with_headers(_main(spark, d)).select("`S.N.`", "Table", "Accessible")


def q_audit_accessible(spark, d):
    return audit.accessible(_audit(spark, d)).select("table_name", "row_count")


def q_audit_missing(spark, d):
    """The absent names of the list and a table of each nation, with the customers that would be in it."""
    nation = load_table(spark, d, "nation")
    listed = {**TABLE_LIST, "nations": [(f"geo.{r.n_name.lower()}", "A nation") for r in nation.select("n_name").collect()]}
    missing = audit.missing(audit.audit_tables(_source(spark, d), flatten_table_list(table_list(spark, listed))))
    customer = load_table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = customer.groupBy(F.concat(F.lit("geo."), F.lower("n_name")).alias("table_name")).agg(F.count(F.lit(1)).alias("n_customers"))
    return missing.select("table_name", "error_class").join(wanted, "table_name", "left")


def _messages(spark, d):
    """Events as access attempts: an error text that depends on the kind and value of the event."""
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    message = (
        F.when(kind == "signup", F.concat(F.lit("PERMISSION_DENIED: user lacks "), value))
        .when(kind == "error", F.concat(F.lit("Query Timeout after "), value))
        .when((kind == "click") & (F.col("value") < 20), "[SCHEMA_NOT_FOUND] no such schema")
        .when(kind == "click", "Connection reset, out of memory")
        .when((kind == "view") & (F.col("value") < 10), F.concat(F.lit("table does not exist: "), value))
        .when(kind == "view", F.concat(F.lit("code "), value))
    )
    return load_table(spark, d, "events").select(
        "event_id", message.alias("message"), message.isNull().alias("accessible")
    )


_MESSAGES_SQL = """classified AS (
  SELECT event_id, event_type = 'purchase' AS accessible,
         CASE WHEN event_type = 'signup' THEN 'Permission denied'
              WHEN event_type = 'error' THEN 'Query timeout'
              WHEN event_type = 'click' AND value < 20 THEN 'Schema does not exist'
              WHEN event_type = 'click' THEN 'Connection error'
              WHEN event_type = 'view' AND value < 10 THEN 'Table does not exist'
              WHEN event_type = 'view' THEN 'Unknown error' END AS error_class,
         CASE WHEN event_type = 'signup' THEN true
              WHEN event_type = 'click' AND value < 20 THEN false
              WHEN event_type = 'view' AND value < 10 THEN false END AS "exists"
  FROM events)"""


def q_error_class(spark, d):
    return classify.with_error_class(_messages(spark, d), "message").drop("message")


def q_audit_blocked(spark, d):
    """Attempts on something that exists but was refused."""
    attempts = classify.with_error_class(_messages(spark, d), "message")
    return audit.blocked(attempts).select("event_id", "error_class")


def _part_names(spark, d):
    """Parts as tables: brand as schema, type and name as table name."""
    return load_table(spark, d, "part").select(
        "p_partkey", F.lower("p_brand").alias("schema_name"),
        F.concat_ws("_", "p_type", "p_name").alias("short_name"),
    )


_BRAND_RULES = (
    Rule(("brand#25",), {"pipeline_stage": "Pilot", "migration_priority": "Critical"}),
    Rule(("brand#2",), {"pipeline_stage": "Landing", "data_source": "Shop", "migration_priority": "High"}),
    Rule(("brand#1", "brand#3"), {"pipeline_stage": "Raw", "data_source": "Archive"}),
)
_PART_RULES = (
    Rule(("ring", "widget"), {"business_purpose": "Small Goods"}),
    Rule(("promo", "economy"), {"business_purpose": "Campaigns"}),
)


def q_table_context(spark, d):
    named = classify.with_table_context(
        _part_names(spark, d), "schema_name", "short_name", _BRAND_RULES, _PART_RULES
    )
    return named.drop("schema_name", "short_name")


def q_report_category(spark, d):
    named = _part_names(spark, d).withColumn("name", F.concat_ws(".", "schema_name", "short_name"))
    rules = [
        Rule(("brand#25", "ECONOMY"), {"report_category": "First Tables"}),
        Rule(("brand#2",), {"report_category": "Second Tables"}),
    ]
    return classify.with_report_category(named, "name", rules).groupBy("report_category").agg(
        F.count(F.lit(1)).alias("n")
    )


def q_audit_by_category(spark, d):
    return audit.by_category(_entries(spark), _audit(spark, d))


def q_audit_by_schema(spark, d):
    return audit.by_schema(_audit(spark, d))


def q_audit_overall(spark, d):
    return audit.overall(_audit(spark, d))


def q_audit_preview(spark, d):
    return report.preview(_audit(spark, d))


def _main(spark, d, audited=None):
    """The ranked report without the catalog dates, which are those of the registration."""
    audited = audited or _audit(spark, d)
    ranked = report.main_report(audited, STAGE_RULES, "lake", "catalog audit", PURPOSE_RULES)
    return ranked.drop("created", "updated")


def q_report_main(spark, d):
    return _main(spark, d)


def q_report_csv_rows(spark, d):
    rows = report.csv_rows(_audit(spark, d))
    return rows.select("table_name", "description", "accessible", "row_count", "column_count", "column_names")


def q_report_groups(spark, d):
    return report.groups(_audit(spark, d), CATEGORY_RULES)


def q_report_links(spark, d):
    return _main(spark, d).select("serial", "table", "records")


def q_report_comments(spark, d):
    return report.with_comments(_audit(spark, d), STAGE_RULES, PURPOSE_RULES).select(
        "table_name", "comments", "row_count"
    )


def q_report_markdown_lines(spark, d):
    audited = _audit(spark, d)
    return report.main_lines(audited, _main(spark, d, audited), "Table Access Report", "lake")


def q_report_set(spark, d):
    """All four reports written and read back; dates and the lines that hold them apart."""
    path = work_dir(spark, "reports")
    write_report_set(_audit(spark, d), path, "Table Access Report", "lake", "catalog audit", STAGE_RULES, CATEGORY_RULES, PURPOSE_RULES)
    main = spark.read.option("header", "true").csv(f"{path}/main_csv")
    rows = spark.read.option("header", "true").csv(f"{path}/audit_csv")
    kept = ["S.N.", "Table", "Catalog", "Schema", "Source", "Accessible", "Total Records", "Columns", "Primary Key", "Comments"]
    parts = [
        main.select(F.lit("main_csv").alias("report"), F.concat_ws("|", *[F.col(f"`{c}`") for c in kept]).alias("line")),
        rows.select(F.lit("audit_csv").alias("report"), F.concat_ws("|", "table_name", "description", "accessible", "row_count", "column_count", "column_names").alias("line")),
    ]
    for name, starts in (("main_md", ("- **", "## ")), ("samples_md", ("### ", "## ", "**Description"))):
        lines = spark.read.text(f"{path}/{name}").select(F.lit(name).alias("report"), F.col("value").alias("line"))
        parts.append(lines.filter(reduce(lambda a, b: a | b, [F.col("line").startswith(s) for s in starts])))
    return reduce(DataFrame.unionAll, parts)


#: Columns of the tables by how a sample shows them: numbers to four places, times, how many values; the rest as text.
_PLACES = frozenset("c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value".split())
_TIMES = frozenset("o_orderdate l_shipdate ts".split())
_SHOWN = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _shown(df: DataFrame) -> list:
    out = []
    for c in df.columns:
        if c in _PLACES:
            cell = F.col(c).cast("decimal(18,4)").cast("string")
        elif c in _TIMES:
            cell = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            cell = F.concat(F.size(c), F.lit(" values")) if c == "embedding" else F.substring(F.col(c).cast("string"), 1, audit.SAMPLE_CHARS)
        out.append(cell.alias(c))
    return out


def q_report_sample_lines(spark, d):
    """The sample report: the first five rows of every table by its key, ties by the other columns."""
    sampled = []
    for schema, names in SCHEMAS.items():
        for table in names:
            df = load_table(spark, d, table)
            keys = SAMPLE_KEYS[table]
            order = [*keys, *[c for c in df.columns if c not in keys and c != "embedding"]]
            first = df.orderBy(*order).limit(5).select(F.struct(F.struct(*order).alias("place"), F.to_json(F.struct(*_shown(df))).alias("row")).alias("r"))
            rows = first.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("sample"))
            sampled.append(rows.select(F.lit(f"{schema}.{table}").alias("table_name"), "sample"))
    audited = _audit(spark, d).drop("sample").join(reduce(DataFrame.unionAll, sampled), "table_name", "left")
    return report.sample_lines(audited, CATEGORY_RULES, "Table Samples")


def q_report_sample_lines_all(spark, d):
    """The sample report with the first rows in key order of all tables, long cells cut in the executors."""
    sampled = []
    for schema, names in SCHEMAS.items():
        for table in names:
            df = load_table(spark, d, table)
            keys, cells = SAMPLE_KEYS[table], audit._cut(df)
            # the cells decide between rows of equal keys
            first = df.select(*cells).orderBy(*keys, *[c for c in df.columns if c not in keys]).limit(5)
            rows = first.select(F.struct(*keys, F.to_json(F.struct(*df.columns)).alias("row")).alias("r"))
            rows = rows.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("sample"))
            sampled.append(rows.select(F.lit(f"{schema}.{table}").alias("table_name"), "sample"))
    samples = reduce(DataFrame.unionAll, sampled)
    audited = _audit(spark, d).drop("sample").join(samples, "table_name", "left")
    return report.sample_lines(audited, CATEGORY_RULES, "Table Samples")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ENTRIES_SQL = "entries(position, category, ordinal, table_name, description) AS (VALUES " + ", ".join(
    f"({p}, {_quoted(c)}, {o}, {_quoted(t)}, {_quoted(text)})"
    for p, (c, tables) in enumerate(TABLE_LIST.items(), 1)
    for o, (t, text) in enumerate(tables, 1)
) + ")"
_COUNTS_SQL = "counts AS (" + " UNION ALL ".join(
    f"""SELECT '{s}.{t}' AS table_name, '{t}' AS short_name, count(*) AS row_count FROM {t}"""
    for s, ts in SCHEMAS.items()
    for t in ts
) + ")"
_COLUMNS_SQL = """cols AS (
  SELECT DISTINCT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name
  FROM information_schema.columns WHERE table_name IN (""" + ", ".join(map(_quoted, ALL_TABLES)) + "))"
_KEY_SQL = (
    "regexp_matches(lower(column_name), '^(?:.*_id$|.*_key$|id$|key$|.*_pk$|.*_uuid$|.*_guid$"
    "|emp_id|employee_id|client_id|person_id|work_id)')"
)
_DATE_SQL = (
    "regexp_matches(lower(column_name), "
    "'date|time|created|updated|modified|timestamp|start|end|effective|expire')"
)
_AUDIT_SQL = f"""{_ENTRIES_SQL}, {_COUNTS_SQL}, {_COLUMNS_SQL},
named AS (
  SELECT table_name, split_part(table_name, '.', 1) AS schema_name,
         split_part(table_name, '.', 2) AS short_name,
         arg_max(description, position * 1000 + ordinal) AS description
  FROM entries GROUP BY table_name),
shapes AS (
  SELECT table_name AS short_name, count(*) AS column_count,
         string_agg(column_name, ', ' ORDER BY ordinal) AS column_names,
         array_to_string((list(column_name ORDER BY ordinal) FILTER (WHERE {_KEY_SQL}))[1:3], ', ')
           AS key_names,
         array_to_string((list(column_name ORDER BY ordinal) FILTER (WHERE {_DATE_SQL}))[1:3], ', ')
           AS date_names
  FROM cols GROUP BY table_name),
audit AS (
  SELECT n.*, row_count IS NOT NULL AS accessible, row_count IS NOT NULL AS "exists",
         CASE WHEN row_count IS NULL THEN 'Table does not exist' END AS error_class,
         row_count, CASE WHEN row_count IS NOT NULL THEN CAST(column_count AS INTEGER) END AS column_count,
         column_names, key_names, date_names
  FROM named n LEFT JOIN counts c USING (table_name) LEFT JOIN shapes s ON s.short_name = n.short_name)"""
_COMMENTS_SQL = f"""{_AUDIT_SQL},
commented AS (
  SELECT *, CASE WHEN accessible THEN concat_ws(' | ', description,
      '🏗️ ' || CASE schema_name WHEN 'sales' THEN 'Processed' WHEN 'geo' THEN 'Raw'
                                 WHEN 'text' THEN 'Landing' ELSE 'Unknown' END,
      '📊 ' || CASE WHEN short_name IN ('customer', 'supplier') THEN 'Partners'
                    WHEN short_name IN ('orders', 'lineitem') THEN 'Transactions'
                    WHEN short_name IN ('nation', 'region') THEN 'Places' ELSE 'Unknown' END,
      '🔑 Key fields: ' || key_names, '📅 Date fields: ' || date_names,
      CASE schema_name WHEN 'sales' THEN '🚨 Critical migration priority'
                       WHEN 'geo' THEN '⚡ High migration priority' END)
    ELSE description || ' | ❌ ' || error_class END AS comments
  FROM audit)"""
_MAIN_SQL = f"""{_COMMENTS_SQL},
main AS (
  SELECT CAST(row_number() OVER (ORDER BY accessible DESC, schema_name, short_name) AS INTEGER) AS serial,
    CASE WHEN accessible THEN '[' || table_name || '](#' || translate(table_name, '._', '--') || ')'
         ELSE table_name END AS "table",
    'lake' AS catalog, schema_name AS "schema", 'catalog audit' AS source,
    CASE WHEN accessible THEN 'Yes' ELSE 'No' END AS accessible,
    CASE WHEN accessible THEN format('{{:,}}', row_count) ELSE '-' END AS records,
    CASE WHEN accessible THEN format('{{:,}}', column_count) ELSE '-' END AS columns,
    CASE WHEN accessible THEN coalesce(key_names, '-') ELSE '-' END AS primary_key, comments
  FROM commented)"""
_LINES_SQL = f"""{_MAIN_SQL},
totals AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE accessible) AS ok FROM audit),
schemas AS (
  SELECT schema_name, count(*) AS n, count(*) FILTER (WHERE accessible) AS ok,
         row_number() OVER (ORDER BY schema_name) AS r FROM audit GROUP BY schema_name),
blocks AS (
  SELECT 1 AS section, 1 AS r, ['# Table Access Report', '', '**Catalog:** lake', '', '## Summary Statistics', '',
    '- **Total Tables Checked:** ' || n,
    '- **Accessible Tables:** ' || ok || ' (' || format('{{:.1f}}', ok * 100.0 / n) || '%)',
    '- **Tables with Access Issues:** 0', '- **Tables Not Found:** ' || (n - ok),
    '', '## Schema Breakdown', ''] AS block FROM totals
  UNION ALL
  SELECT 2, r, ['- **' || schema_name || ':** ' || ok || '/' || n || ' accessible ('
                || format('{{:.1f}}', ok * 100.0 / n) || '%)'] FROM schemas
  UNION ALL
  SELECT 3, 1, ['', '## Main Report Table', '',
    '| S.N. | Table | Catalog | Schema | Source | Accessible | Total Records | Columns | Primary Key | Comments |',
    '|---|---|---|---|---|---|---|---|---|---|']
  UNION ALL
  SELECT 4, serial, ['| ' || concat_ws(' | ', serial, "table", catalog, "schema", source, accessible,
                                       records, columns, primary_key, comments) || ' |'] FROM main)"""
def _cell_sql(column: str) -> str:
    if column in _PLACES:
        text = f"CAST(CAST({column} AS DECIMAL(18, 4)) AS VARCHAR)"
    elif column in _TIMES:
        text = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    else:
        text = f"len({column}) || ' values'" if column == "embedding" else f"CAST({column} AS VARCHAR)"
    short = f"CASE WHEN length({text}) > 40 THEN substr({text}, 1, 40) || '...' ELSE coalesce({text}, '') END"
    return f"replace(translate({short}, chr(13) || chr(10), '  '), '|', '\\|')"


def _sampled_rows_sql(table: str) -> str:
    columns, keys = _SHOWN[table].split(), SAMPLE_KEYS[table]
    order = ", ".join([*keys, *[c for c in columns if c not in keys and c != "embedding"]])
    line = " || ' | ' || ".join(_cell_sql(c) for c in columns[:8])
    return f"""SELECT '{table}' AS short_name, {len(columns)} AS n_columns, '| {" | ".join(columns[:8])} |' AS heading, '|{"|".join(["---"] * len(columns[:8]))}|' AS rule,
  list('| ' || {line} || ' |' ORDER BY {order}) AS lines FROM (SELECT * FROM {table} ORDER BY {order} LIMIT 5)"""


_SAMPLED_ROWS_SQL = " UNION ALL ".join(map(_sampled_rows_sql, ALL_TABLES))
_SAMPLES_SQL = f"""{_AUDIT_SQL},
placed AS (
  SELECT *, CASE WHEN schema_name IN ('sales', 'stream') THEN 'Business Tables'
                 WHEN schema_name = 'geo' THEN 'Place Tables' ELSE 'Other Tables' END AS section
  FROM audit WHERE accessible),
numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY section, table_name) AS INTEGER) AS r,
         row_number() OVER (PARTITION BY section ORDER BY table_name) = 1 AS is_first
  FROM placed),
samples AS ({_SAMPLED_ROWS_SQL}),
blocks AS (
  SELECT 1 AS section, 1 AS r, ['# Table Samples', '',
    '**Summary:** ' || count(*) FILTER (WHERE accessible) || ' accessible tables out of ' || count(*)
      || ' checked', ''] AS block FROM audit
  UNION ALL
  SELECT 2, r, CASE WHEN is_first THEN ['## ' || section, ''] ELSE [] END
    || ['### ' || table_name, '**Description:** ' || description]
    || ['**Columns:** ' || n_columns || ' | **Sample Rows:** ' || len(lines), '', heading, rule] || lines
    || CASE WHEN n_columns > 8 THEN ['*Note: Showing first 8 of ' || n_columns || ' columns*'] ELSE [] END || [''] AS block
  FROM numbered JOIN samples USING (short_name))"""
_IMPORTANT = [
    ("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"),
    ("part", "p_name"), ("part", "p_type"), ("orders", "o_orderstatus"), ("lineitem", "l_discount"),
    ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"),
]
_KEYS = [
    ("events", "event_id"), ("events", "user_id"), ("documents", "doc_id"), ("embeddings", "vec_id"),
    ("pages", "page_id"), ("benchmark", "item_id"), ("labels", "doc_id"), ("conversations", "conv_id"),
]

QUERIES = {
    "table_row_counts": (
        q_table_row_counts,
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES),
    ),
    "column_catalog": (
        q_column_catalog,
        f"""WITH {_COUNTS_SQL}, {_COLUMNS_SQL}
SELECT c.table_name, ordinal, column_name, row_count FROM cols c JOIN counts n ON n.short_name = c.table_name""",
    ),
    "column_counts": (
        q_column_counts,
        f"""WITH {_COUNTS_SQL}, {_COLUMNS_SQL}
SELECT c.table_name, count(*) AS column_count, any_value(row_count) AS row_count
FROM cols c JOIN counts n ON n.short_name = c.table_name GROUP BY c.table_name""",
    ),
    "key_candidates": (
        q_key_candidates,
        " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,
       count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"""
            for t, c in _KEYS
        ),
    ),
    "date_columns": (
        q_date_columns,
        " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,
       count(*) - count({c}) AS nulls, {time} AS is_time_type FROM {t}"""
            for t, c, time in [
                ("orders", "o_orderdate", "true"), ("lineitem", "l_shipdate", "true"),
                ("lineitem", "l_extendedprice", "false"),
            ]
        ),
    ),
    "important_columns": (
        q_important_columns,
        " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,
       count(DISTINCT {c}) AS n_distinct FROM {t}"""
            for t, c in _IMPORTANT
        ),
    ),
    "flatten_table_list": (
        q_flatten_table_list,
        f"""WITH {_ENTRIES_SQL}, {_COUNTS_SQL}
SELECT position, category, ordinal, e.table_name, description, row_count
FROM entries e LEFT JOIN counts c ON c.table_name = e.table_name""",
    ),
    "distinct_tables": (
        q_distinct_tables, f"WITH {_AUDIT_SQL} SELECT table_name, description, row_count FROM audit"
    ),
    "catalog_presence": (
        q_catalog_presence,
        f"""WITH {_ENTRIES_SQL}, {_COUNTS_SQL}
SELECT category, ordinal, e.table_name, row_count IS NOT NULL AS in_catalog, row_count
FROM entries e LEFT JOIN counts c ON c.table_name = e.table_name""",
    ),
    "table_properties": (
        q_table_properties,
        f"""WITH {_COUNTS_SQL}
SELECT table_name, 'audit' AS purpose, row_count FROM counts""",
    ),
    "table_times": (
        q_table_times,
        f"WITH {_COUNTS_SQL} SELECT table_name, row_count, true AS created_in_session, '{_CHANGED}' AS updated_at FROM counts",
    ),
    "audit_tables": (
        q_audit_tables,
        f"""WITH {_AUDIT_SQL}
SELECT table_name, schema_name, short_name, description, "exists", accessible, error_class,
       row_count, column_count, coalesce(column_names, '') AS column_names FROM audit""",
    ),
    "audit_isolated": (
        q_audit_isolated,
        f"""WITH {_AUDIT_SQL}, sampled AS ({" UNION ALL ".join(
            f"""SELECT '{s}.{t}' AS table_name, string_agg(CAST(k AS VARCHAR), ';' ORDER BY k) AS sampled
  FROM (SELECT {SAMPLE_KEYS[t][0]} AS k FROM {t} ORDER BY {", ".join(SAMPLE_KEYS[t])} LIMIT 5)""" for s, ts in SCHEMAS.items() for t in ts)})
SELECT table_name, row_count, sampled FROM audit LEFT JOIN sampled USING (table_name)""",
    ),
    "audit_unreadable": (
        q_audit_unreadable,
        f"""WITH {_AUDIT_SQL}
SELECT table_name, accessible, row_count, false AS failed FROM audit
UNION ALL SELECT 'stream.broken', true, NULL, true""",
    ),
    "audit_single": (
        q_audit_single,
        """SELECT 'sales.lineitem' AS table_name, 'lineitem' AS qualified, 'Order lines' AS description, true AS accessible,
  (SELECT count(*) FROM lineitem) AS row_count,
  (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS column_count, true AS checked_today""",
    ),
    "run_audit": (
        q_run_audit,
        f"""WITH {_AUDIT_SQL}
SELECT category, CAST(sum(row_count) AS BIGINT) AS rows, count(*) AS total, count(*) FILTER (WHERE accessible) AS accessible_count,
       count(*) FILTER (WHERE "exists") AS existing_count
FROM entries JOIN audit USING (table_name) GROUP BY category""",
    ),
    "report_headers": (
        q_report_headers,
        f"""WITH {_MAIN_SQL} SELECT serial AS "S.N.", "table" AS "Table", accessible AS "Accessible" FROM main""",
    ),
    "audit_accessible": (
        q_audit_accessible, f"WITH {_AUDIT_SQL} SELECT table_name, row_count FROM audit WHERE accessible"
    ),
    "audit_missing": (
        q_audit_missing,
        f"""WITH {_AUDIT_SQL}, of_nations AS (
  SELECT 'geo.' || lower(n_name) AS table_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT table_name, error_class, NULL AS n_customers FROM audit WHERE NOT "exists"
UNION ALL SELECT table_name, 'Table does not exist', nullif(n, 0) FROM of_nations""",
    ),
    "audit_blocked": (
        q_audit_blocked,
        f'WITH {_MESSAGES_SQL} SELECT event_id, error_class FROM classified WHERE "exists" AND NOT accessible',
    ),
    "error_class": (q_error_class, f"WITH {_MESSAGES_SQL} SELECT * FROM classified"),
    "table_context": (
        q_table_context,
        """WITH names AS (
  SELECT p_partkey, lower(p_brand) AS s, lower(p_type || '_' || p_name) AS t FROM part)
SELECT p_partkey,
  CASE WHEN contains(s, 'brand#25') THEN 'Pilot' WHEN contains(s, 'brand#2') THEN 'Landing'
       WHEN contains(s, 'brand#1') OR contains(s, 'brand#3') THEN 'Raw' ELSE 'Unknown' END AS pipeline_stage,
  CASE WHEN contains(s, 'brand#25') THEN 'Unknown' WHEN contains(s, 'brand#2') THEN 'Shop'
       WHEN contains(s, 'brand#1') OR contains(s, 'brand#3') THEN 'Archive' ELSE 'Unknown' END AS data_source,
  CASE WHEN contains(s, 'brand#25') THEN 'Critical' WHEN contains(s, 'brand#2') THEN 'High' ELSE 'Low' END
    AS migration_priority,
  CASE WHEN contains(t, 'ring') OR contains(t, 'widget') THEN 'Small Goods'
       WHEN contains(t, 'promo') OR contains(t, 'economy') THEN 'Campaigns' ELSE 'Unknown' END
    AS business_purpose
FROM names""",
    ),
    "report_category": (
        q_report_category,
        """SELECT CASE WHEN contains(lower(p_brand), 'brand#25') OR contains(p_type, 'ECONOMY') THEN 'First Tables'
            WHEN contains(lower(p_brand), 'brand#2') THEN 'Second Tables' ELSE 'Other Tables' END
         AS report_category, count(*) AS n FROM part GROUP BY 1""",
    ),
    "audit_by_category": (
        q_audit_by_category,
        f"""WITH {_AUDIT_SQL}
SELECT category, count(*) AS total, count(*) FILTER (WHERE accessible) AS accessible_count,
       count(*) FILTER (WHERE "exists") AS existing_count
FROM entries JOIN audit USING (table_name) GROUP BY category""",
    ),
    "audit_by_schema": (
        q_audit_by_schema,
        f"""WITH {_AUDIT_SQL}
SELECT schema_name, count(*) AS total, count(*) FILTER (WHERE accessible) AS accessible_count,
       round(count(*) FILTER (WHERE accessible) * 100.0 / count(*), 1) AS accessible_percent
FROM audit GROUP BY schema_name""",
    ),
    "audit_overall": (
        q_audit_overall,
        f"""WITH {_AUDIT_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE accessible) AS accessible_count,
       count(*) FILTER (WHERE "exists") AS existing_count, CAST(0 AS BIGINT) AS blocked_count,
       count(*) FILTER (WHERE NOT "exists") AS missing_count,
       round(count(*) FILTER (WHERE accessible) * 100.0 / count(*), 1) AS accessible_percent,
       round(count(*) FILTER (WHERE "exists") * 100.0 / count(*), 1) AS existing_percent
FROM audit""",
    ),
    "audit_preview": (
        q_audit_preview,
        f"""WITH {_AUDIT_SQL},
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY schema_name, short_name) AS INTEGER) AS ordinal,
         '- ' || table_name || ' (' || format('{{:,}}', column_count) || ' cols, '
              || format('{{:,}}', row_count) || ' rows)' AS line
  FROM audit WHERE accessible)
SELECT * FROM ranked WHERE ordinal <= 10
UNION ALL SELECT 11, '... and ' || (count(*) - 10) || ' more' FROM ranked""",
    ),
    "report_main": (q_report_main, f"WITH {_MAIN_SQL} SELECT * FROM main"),
    "report_csv_rows": (
        q_report_csv_rows,
        f"""WITH {_AUDIT_SQL}
SELECT table_name, description, accessible, row_count, column_count,
       coalesce(column_names, '') AS column_names FROM audit""",
    ),
    "report_groups": (
        q_report_groups,
        f"""WITH {_AUDIT_SQL}
SELECT CASE WHEN schema_name IN ('sales', 'stream') THEN 'Business Tables'
            WHEN schema_name = 'geo' THEN 'Place Tables' ELSE 'Other Tables' END AS report_category,
       string_agg(table_name, ', ' ORDER BY table_name) AS tables, count(*) AS n_tables
FROM audit WHERE accessible GROUP BY 1""",
    ),
    "report_links": (q_report_links, f'WITH {_MAIN_SQL} SELECT serial, "table", records FROM main'),
    "report_comments": (
        q_report_comments, f"WITH {_COMMENTS_SQL} SELECT table_name, comments, row_count FROM commented"
    ),
    "report_markdown_lines": (
        q_report_markdown_lines,
        f"""WITH {_LINES_SQL}
SELECT section, CAST(r AS INTEGER) AS "row",
       CAST(unnest(generate_series(0, len(block) - 1)) AS INTEGER) AS ordinal, unnest(block) AS line
FROM blocks""",
    ),
    "report_set": (
        q_report_set,
        f"""SELECT 'main_csv' AS report, concat_ws('|', serial, "table", "catalog", "schema", source, accessible, records, "columns", primary_key, comments) AS line
FROM (WITH {_MAIN_SQL} SELECT * FROM main)
UNION ALL SELECT 'audit_csv', concat_ws('|', table_name, description, accessible, row_count, column_count, column_names) FROM (WITH {_AUDIT_SQL} SELECT * FROM audit)
UNION ALL SELECT 'main_md', line FROM (WITH {_LINES_SQL} SELECT unnest(block) AS line FROM blocks) WHERE line LIKE '- **%' OR line LIKE '## %'
UNION ALL SELECT 'samples_md', line FROM (WITH {_SAMPLES_SQL} SELECT unnest(block) AS line FROM blocks)
WHERE line LIKE '### %' OR line LIKE '## %' OR line LIKE '**Description%'""",
    ),
    "report_sample_lines": (
        q_report_sample_lines,
        f"""WITH {_SAMPLES_SQL}
SELECT section, r AS "row", CAST(unnest(generate_series(0, len(block) - 1)) AS INTEGER) AS ordinal,
       unnest(block) AS line
FROM blocks""",
    ),
    "report_sample_lines_all": (q_report_sample_lines_all, None),
}
