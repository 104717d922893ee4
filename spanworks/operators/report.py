"""Reports over the audit of a table list: ranking, comments, links and text lines.

All inputs have one row per audited table, so global ordering and collected lists
are bounded by the length of the table list.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanworks.functions.dates import date_prefix
from spanworks.functions.text import anchor_link, truncate_cell, with_thousands
from spanworks.operators.audit import accessible, by_schema, overall
from spanworks.operators.classify import (
    PURPOSE_RULES,
    UNKNOWN_ERROR,
    Rule,
    is_date_name,
    is_key_name,
    with_report_category,
    with_table_context,
)

# Marks and phrases in the comments.
MARK_ERROR, MARK_STAGE, MARK_PURPOSE = "❌ ", "🏗️ ", "📊 "
MARK_KEYS, MARK_DATES = "🔑 Key fields: ", "📅 Date fields: "
PRIORITY_NOTES = {
    "Critical": "🚨 Critical migration priority",
    "High": "⚡ High migration priority",
}
# Headers of the main report.
MAIN_HEADERS = {
    "serial": "S.N.", "table": "Table", "catalog": "Catalog", "schema": "Schema",
    "source": "Source", "accessible": "Accessible", "records": "Total Records",
    "columns": "Columns", "created": "Creation Date", "updated": "Last Update Date",
    "primary_key": "Primary Key", "comments": "Comments",
}
SAMPLE_COLUMNS = 8
LISTED_NAMES = 3
PREVIEW_ROWS = 10


def _first_names(columns: Column, rule: Callable[[Column], Column]) -> Column:
    """The first three names that fit, in column order; null when none does."""
    hits = F.filter(columns, rule)
    return F.when(F.size(hits) > 0, F.concat_ws(", ", F.slice(hits, 1, LISTED_NAMES)))


def with_comments(
    audit: DataFrame, stage_rules: Sequence[Rule], purpose_rules: Sequence[Rule] = PURPOSE_RULES
) -> DataFrame:
    """Adds ``comments``: the description, then the error or what is known of the table."""
    context = with_table_context(audit, "schema_name", "short_name", stage_rules, purpose_rules)
    columns = F.col("columns")
    note = None
    for priority, text in PRIORITY_NOTES.items():
        hit = F.col("migration_priority") == priority
        note = F.when(hit, text) if note is None else note.when(hit, text)
    known = F.concat_ws(
        " | ",
        F.col("description"),
        F.concat(F.lit(MARK_STAGE), "pipeline_stage"),
        F.concat(F.lit(MARK_PURPOSE), "business_purpose"),
        F.concat(F.lit(MARK_KEYS), _first_names(columns, is_key_name)),
        F.concat(F.lit(MARK_DATES), _first_names(columns, is_date_name)),
        note,
    )
    unclear = F.col("error_class") == UNKNOWN_ERROR
    cause = F.when(unclear, F.concat("error_class", F.lit(": "), "error")).otherwise(F.col("error_class"))
    failed = F.concat_ws(
        " | ", F.col("description"), F.concat(F.lit(MARK_ERROR), F.coalesce(cause, F.lit("")))
    )
    return context.withColumn("comments", F.when(F.col("accessible"), known).otherwise(failed))


def main_report(
    audit: DataFrame, stage_rules: Sequence[Rule], catalog: str, source: str,
    purpose_rules: Sequence[Rule] = PURPOSE_RULES,
) -> DataFrame:
    """The ranked report: accessible tables first, then by schema and table name."""
    ranking = W.orderBy(F.desc("accessible"), "schema_name", "short_name", "table_name")
    ok = F.col("accessible")

    def if_ok(number: str) -> Column:
        return F.when(ok, with_thousands(F.col(number))).otherwise(F.lit("-"))

    return with_comments(audit, stage_rules, purpose_rules).select(
        F.row_number().over(ranking).alias("serial"),
        anchor_link(F.col("table_name"), ok).alias("table"),
        F.lit(catalog).alias("catalog"),
        F.col("schema_name").alias("schema"),
        F.lit(source).alias("source"),
        F.when(ok, "Yes").otherwise("No").alias("accessible"),
        if_ok("row_count").alias("records"),
        if_ok("column_count").alias("columns"),
        date_prefix(F.col("created_at").cast("string")).alias("created"),
        date_prefix(F.col("updated_at").cast("string")).alias("updated"),
        F.coalesce(_first_names(F.col("columns"), is_key_name), F.lit("-")).alias("primary_key"),
        "comments",
    )


def with_headers(report: DataFrame, headers: Mapping[str, str] | None = None) -> DataFrame:
    """The main report under its printed column names; ``headers`` replaces some of them."""
    return report.withColumnsRenamed({**MAIN_HEADERS, **(headers or {})})


def csv_rows(audit: DataFrame) -> DataFrame:
    """Audit rows that fit a CSV file: no sample, column names as one text."""
    flat = audit.withColumns(
        {
            "column_names": F.concat_ws(", ", "columns"),
            "properties": F.to_json("properties"),
        }
    )
    return flat.drop("sample", "columns")


def groups(audit: DataFrame, category_rules: Sequence[Rule]) -> DataFrame:
    """Accessible tables listed by report category."""
    named = with_report_category(accessible(audit), "table_name", category_rules)
    return named.groupBy("report_category").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("table_name"))).alias("tables"),
        F.count(F.lit(1)).alias("n_tables"),
    )


def preview(audit: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Lines on the first accessible tables, and how many more there are."""
    ok = accessible(audit)
    rank = F.row_number().over(W.orderBy("schema_name", "short_name", "table_name"))
    text = F.concat(
        F.lit("- "), "table_name", F.lit(" ("), with_thousands(F.col("column_count")),
        F.lit(" cols, "), with_thousands(F.col("row_count")), F.lit(" rows)"),
    )
    lines = ok.select(rank.alias("ordinal"), text.alias("line")).filter(F.col("ordinal") <= rows)
    more = ok.agg((F.count(F.lit(1)) - rows).alias("n")).filter("n > 0").select(
        F.lit(rows + 1).alias("ordinal"),
        F.concat(F.lit("... and "), F.col("n").cast("string"), F.lit(" more")).alias("line"),
    )
    return lines.unionByName(more)


def first_columns(df: DataFrame, limit: int = SAMPLE_COLUMNS) -> DataFrame:
    """The first columns of a wide table, each row noting how many there are in all."""
    note = None
    if len(df.columns) > limit:
        note = f"Note: Showing first {limit} of {len(df.columns)} columns"
    return df.select(*df.columns[:limit], F.lit(note).cast("string").alias("note"))


def _cell(value: Column) -> Column:
    """A short text that stays within its table cell."""
    one_line = F.translate(truncate_cell(value), "\r\n", "  ")
    return F.replace(one_line, F.lit("|"), F.lit("\\|"))


def _row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def _rule_line(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda _: F.lit("---")), "|"), F.lit("|"))


def _numbered(df: DataFrame, section: int, order: Sequence[str], lines: Column) -> DataFrame:
    """Arrays of lines, one array per row, to lines numbered within a section."""
    ranked = df.withColumn("_row", F.row_number().over(W.orderBy(*order)))
    return ranked.select(
        F.lit(section).alias("section"), F.col("_row").alias("row"),
        F.posexplode(lines).alias("ordinal", "line"),
    )


def _head(title: str, catalog: str | None, generated: str | None) -> list[Column]:
    lines = [f"# {title}", ""]
    lines += [f"**Generated:** {generated}", ""] if generated else []
    lines += [f"**Catalog:** {catalog}", ""] if catalog else []
    return [F.lit(line) for line in lines]


def main_lines(
    audit: DataFrame, report: DataFrame, title: str, catalog: str | None = None,
    generated: str | None = None,
) -> DataFrame:
    """The Markdown main report: summary, schemas and the ranked table, as numbered lines."""
    percent = lambda c: F.concat(F.format_number(F.coalesce(c, F.lit(0.0)), 1), F.lit("%"))
    total, ok = F.col("total").cast("string"), F.col("accessible_count").cast("string")
    summary = F.array(
        *_head(title, catalog, generated), F.lit("## Summary Statistics"), F.lit(""),
        F.concat(F.lit("- **Total Tables Checked:** "), total),
        F.concat(F.lit("- **Accessible Tables:** "), ok, F.lit(" ("), percent(F.col("accessible_percent")), F.lit(")")),
        F.concat(F.lit("- **Tables with Access Issues:** "), F.col("blocked_count").cast("string")),
        F.concat(F.lit("- **Tables Not Found:** "), F.col("missing_count").cast("string")),
        F.lit(""), F.lit("## Schema Breakdown"), F.lit(""),
    )
    schema_line = F.array(
        F.concat(
            F.lit("- **"), "schema_name", F.lit(":** "), ok, F.lit("/"), total,
            F.lit(" accessible ("), percent(F.col("accessible_percent")), F.lit(")"),
        )
    )
    headers = [MAIN_HEADERS[c] for c in report.columns]
    heading = F.array(*[F.lit(h) for h in headers])
    table_head = F.array(
        F.lit(""), F.lit("## Main Report Table"), F.lit(""), _row_line(heading), _rule_line(heading)
    )
    cells = F.array(*[F.col(c).cast("string") for c in report.columns])
    totals = overall(audit)
    return (
        _numbered(totals, 1, ["total"], summary)
        .unionByName(_numbered(by_schema(audit), 2, ["schema_name"], schema_line))
        .unionByName(_numbered(totals, 3, ["total"], table_head))
        .unionByName(_numbered(report, 4, ["serial"], F.array(_row_line(cells))))
    )


def sample_lines(
    audit: DataFrame, category_rules: Sequence[Rule], title: str, catalog: str | None = None,
    generated: str | None = None,
) -> DataFrame:
    """The Markdown sample report: per accessible table its description and sampled rows."""
    totals = overall(audit)
    summary = F.concat(
        F.lit("**Summary:** "), F.col("accessible_count").cast("string"),
        F.lit(" accessible tables out of "), F.col("total").cast("string"), F.lit(" checked"),
    )
    top = F.array(*_head(title, catalog, generated), summary, F.lit(""))
    named = with_report_category(accessible(audit), "table_name", category_rules)
    shown = F.slice("columns", 1, SAMPLE_COLUMNS)
    row_type = T.MapType(T.StringType(), T.StringType())

    def row(text: Column) -> Column:
        parsed = F.from_json(text, row_type)
        return _row_line(F.transform(shown, lambda c: _cell(F.try_element_at(parsed, c))))

    count = F.size("columns").cast("string")
    n_rows = F.size("sample").cast("string")
    note = F.concat(
        F.lit(f"*Note: Showing first {SAMPLE_COLUMNS} of "), count, F.lit(" columns*")
    )
    head = F.array(
        F.concat(F.lit("### "), "table_name"),
        F.concat(F.lit("**Description:** "), F.coalesce("description", F.lit(""))),
    )
    empty = F.concat(head, F.array(F.lit("*No data available*"), F.lit("")))
    full = F.concat(
        head,
        F.array(
            F.concat(F.lit("**Columns:** "), count, F.lit(" | **Sample Rows:** "), n_rows),
            F.lit(""), _row_line(shown), _rule_line(shown),
        ),
        F.transform("sample", row),
        F.when(F.size("columns") > SAMPLE_COLUMNS, F.array(note)).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("")),
    )
    by = ["report_category", "table_name"]
    first = F.row_number().over(W.partitionBy("report_category").orderBy("table_name")) == 1
    titled = named.withColumn("_first", first)
    heading = F.when(
        F.col("_first"), F.array(F.concat(F.lit("## "), "report_category"), F.lit(""))
    ).otherwise(F.array().cast("array<string>"))
    has_rows = F.coalesce(F.size("sample") > 0, F.lit(False))
    body = F.concat(heading, F.when(has_rows, full).otherwise(empty))
    return _numbered(totals, 1, ["total"], top).unionByName(_numbered(titled, 2, by, body))
