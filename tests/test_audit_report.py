import re

import pytest
from pyspark.sql import functions as F

from spanworks.operators import audit, report
from spanworks.queries import audits
from spanworks.sinks.reports import write_csv_report, write_lines, write_report_set
from spanworks.sources.tables import (
    CatalogSource,
    flatten_table_list,
    literal,
    local_rows,
    qualified_name,
    quote,
    table_list,
)


@pytest.fixture(scope="module")
def audited(spark, data_dir):
    return audits._audit(spark, data_dir, sample_rows=5)


def test_names():
    assert qualified_name("s.t", "c") == "c.s.t" and qualified_name("s.t") == "s.t"
    assert quote("a.b`c") == "`a`.`b``c`"
    assert literal("it's \\") == "'it\\'s \\\\'"


def test_audit(audited):
    rows = {r.table_name: r for r in audited.collect()}
    assert len(rows) == 17 and sum(r.accessible for r in rows.values()) == 14
    assert rows["sales.customer"].description == "All buyers"
    assert rows["geo.region"].row_count == 5 and rows["geo.region"].columns == ["r_regionkey", "r_name"]
    assert rows["geo.city"].exists is False and rows["geo.city"].error_class == "Table does not exist"
    assert rows["sales.orders"].properties == {"purpose": "audit"} and rows["sales.orders"].created_at
    assert len(rows["sales.orders"].sample) == 5


def test_roll_ups(spark, audited):
    total = audit.overall(audited).first()
    assert (total.total, total.accessible_count, total.accessible_percent) == (17, 14, 82.4)
    by_schema = audit.by_schema(audited).collect()
    assert {r.schema_name: (r.accessible_count, r.total) for r in by_schema} == {
        "geo": (2, 3), "sales": (5, 6), "stream": (1, 1), "text": (6, 7)}
    assert sum(r.total for r in by_schema) == total.total
    by_category = audit.by_category(audits._entries(spark), audited).collect()
    assert {r.category: (r.accessible_count, r.total) for r in by_category} == {
        "core": (5, 6), "reference": (2, 3), "feeds": (1, 1), "corpus": (6, 7), "repeat": (2, 2)}
    assert audit.missing(audited).count() == 3 and audit.blocked(audited).isEmpty()


def test_empty_list(spark):
    entries = flatten_table_list(table_list(spark, {}))
    empty = audit.audit_tables(CatalogSource(spark), entries)
    assert empty.count() == 0
    total = audit.overall(empty).first()
    assert total.total == 0 and total.accessible_percent is None


def test_unlisted_schema_is_probed(spark):
    entries = flatten_table_list(table_list(spark, {"a": [("nodb.t", "x"), ("t_without_schema", "y")]}))
    rows = audit.audit_tables(CatalogSource(spark), entries).collect()
    assert {(r.exists, r.accessible) for r in rows} == {(False, False)}
    assert {r.schema_name for r in rows} == {"nodb", "unknown"}
    foreign = CatalogSource(spark, catalog="no_such_catalog")
    row = audit.audit_tables(foreign, entries.limit(1)).first()
    assert row.error_class in ("Invalid catalog", "Table does not exist")


def test_name_without_schema_beside_listed_ones(spark, data_dir):
    source = audits._source(spark, data_dir)
    spark.range(4).createOrReplaceTempView("lone_view")
    plain = CatalogSource(spark)
    listed = source.full_name("geo.nation")
    entries = flatten_table_list(table_list(spark, {"a": [("lone_view", "x"), (listed, "y")]}))
    rows = {r.table_name: r for r in audit.audit_tables(plain, entries).collect()}
    assert rows["lone_view"].row_count == 4 and rows["lone_view"].schema_name == "unknown"
    assert rows[listed].row_count == 25


def test_failed_count_keeps_the_table(spark, audited):
    good = spark.range(3)
    bad = spark.range(3).filter(F.raise_error(F.lit("boom")).isNull())
    rows = {r.table_name: r for r in audit._isolated_counts(spark, {"g": good, "b": bad}).collect()}
    assert rows["g"].row_count == 3 and rows["b"].row_count is None
    assert "boom" in rows["b"].count_error


def test_unreadable_files_keep_the_other_tables(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    bad = spark.read.schema("a int").parquet(str(tmp_path / "bad.parquet"))
    rows = {r.table_name: r for r in audit._isolated_counts(spark, {"g": spark.range(3), "b": bad.filter("a > 0")}).collect()}
    assert rows["g"].row_count == 3 and rows["b"].row_count is None and rows["b"].count_error


def test_presence_ignores_case(spark):
    entries = local_rows(spark, [("S.T",), ("s.x",)], "table_name string")
    listing = local_rows(spark, [("s.t",)], "table_name string")
    assert {r.table_name: r.in_catalog for r in audit.catalog_presence(entries, listing).collect()} == {
        "S.T": True, "s.x": False}


def test_main_report(audited):
    rows = report.main_report(audited, audits.STAGE_RULES, "lake", "audit").orderBy("serial").collect()
    assert [r.serial for r in rows] == list(range(1, 18))
    assert [r.accessible for r in rows] == ["Yes"] * 14 + ["No"] * 3
    assert [r.table for r in rows[14:]] == ["geo.city", "sales.returns", "text.summaries"]
    assert rows[14].records == "-" and rows[14].created == "-" and rows[14].comments == "Cities | ❌ Table does not exist"
    assert rows[0].comments == "Nations | 🏗️ Raw | 📊 Unknown | ⚡ High migration priority"
    assert report.with_headers(report.main_report(audited, [], "c", "s")).columns[0] == "S.N."
    named = report.with_headers(report.main_report(audited, [], "c", "s"), {"accessible": "Reachable"})
    assert "Reachable" in named.columns and "Accessible" not in named.columns


def test_unknown_error_is_spelled_out(audited):
    odd = audited.withColumns({"accessible": F.lit(False), "error_class": F.lit("Unknown error"), "error": F.lit("boom")})
    comments = report.with_comments(odd, []).select("comments").distinct().collect()
    assert all(r.comments.endswith("❌ Unknown error: boom") for r in comments)


def test_markdown(spark, audited, tmp_path):
    main = report.main_report(audited, audits.STAGE_RULES, "lake", "audit")
    write_lines(report.main_lines(audited, main, "Audit"), str(tmp_path / "main"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "main")).collect()]
    assert lines[0] == "# Audit" and "- **geo:** 2/3 accessible (66.7%)" in lines
    assert sum(line.startswith("| ") for line in lines) == 18
    write_lines(report.sample_lines(audited, audits.CATEGORY_RULES, "Samples"), str(tmp_path / "samples"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "samples")).collect()]
    assert lines[:5] == [
        "# Samples", "", "**Summary:** 14 accessible tables out of 17 checked", "", "## Business Tables"]
    assert "**Columns:** 11 | **Sample Rows:** 5" in lines
    assert "*Note: Showing first 8 of 11 columns*" in lines
    at = lines.index("### text.documents")
    for line in lines[at + 6 : at + 11]:
        cells = re.split(r"(?<!\\)\|", line.strip("|"))
        assert len(cells) == 5 and all(len(c.strip().replace("\\|", "|")) <= 43 for c in cells)


def test_preview_and_csv(spark, audited, tmp_path):
    lines = [r.line for r in report.preview(audited).orderBy("ordinal").collect()]
    assert len(lines) == 11 and lines[-1] == "... and 4 more"
    write_csv_report(report.csv_rows(audited), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.count() == 17 and "sample" not in back.columns
    assert back.filter("table_name = 'geo.region'").first()["column_names"] == "r_regionkey, r_name"


def test_report_set(spark, audited, tmp_path):
    write_report_set(audited, str(tmp_path), "Audit", "lake", "audit", audits.STAGE_RULES, audits.CATEGORY_RULES)
    main = spark.read.option("header", "true").csv(str(tmp_path / "main_csv"))
    assert main.columns == list(report.MAIN_HEADERS.values()) and main.count() == 17
    assert spark.read.text(str(tmp_path / "main_md")).filter("value LIKE '**Generated:** 20%'").count() == 1
    assert spark.read.text(str(tmp_path / "samples_md")).filter("value LIKE '### %'").count() == 14


def test_single_table_and_whole_run(spark, data_dir):
    source = audits._source(spark, data_dir)
    row = audit.audit_table(source, "geo.region", "Regions").first()
    assert (row.row_count, row.column_count, len(row.sample)) == (5, 2, 5)
    audited, summary = audit.run_audit(source, audits.TABLE_LIST, sample_rows=0)
    assert audited.count() == 17 and summary.agg(F.sum("total")).first()[0] == 19


def test_samples_of_all_tables(spark, data_dir):
    """Every readable table shows its five first rows in key order."""
    lines = [r.line for r in audits.q_report_sample_lines_all(spark, data_dir).orderBy("section", "row", "ordinal").collect()]
    assert "*No data available*" not in lines
    for schema, names in audits.SCHEMAS.items():
        for table in names:
            keys = audits.SAMPLE_KEYS[table]
            df = spark.read.parquet(f"{data_dir}/{table}.parquet")
            at = lines.index(f"### {schema}.{table}")
            head = next(k for k in range(at, len(lines)) if lines[k].startswith("| "))
            shown = [c.strip() for c in lines[head].strip("|").split("|")]
            cells = [[c.strip() for c in line.strip("|").split("|")] for line in lines[head + 2 : head + 7]]
            expected = [[str(r[k]) for k in keys] for r in df.select(*keys).orderBy(*keys).limit(5).collect()]
            assert [[row[shown.index(k)] for k in keys] for row in cells] == expected
            assert max(map(len, lines[head + 2 : head + 7])) < 5000
