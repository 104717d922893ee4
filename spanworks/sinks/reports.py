"""Writing reports. A report has one row or line per audited table: one output file is right."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from spanworks.operators import report
from spanworks.operators.classify import PURPOSE_RULES, Rule


def write_csv_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Numbered lines as one text file in order."""
    ordered = lines.orderBy("section", "row", "ordinal").select("line")
    ordered.coalesce(1).write.mode(mode).text(path)


def write_report_set(
    audit: DataFrame, path: str, title: str, catalog: str, source: str,
    stage_rules: Sequence[Rule], category_rules: Sequence[Rule],
    purpose_rules: Sequence[Rule] = PURPOSE_RULES,
) -> None:
    """All reports of one audit: audit rows and main report as CSV, both reports as Markdown."""
    main = report.main_report(audit, stage_rules, catalog, source, purpose_rules)
    write_csv_report(report.csv_rows(audit), f"{path}/audit_csv")
    write_csv_report(report.with_headers(main), f"{path}/main_csv")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    write_lines(report.main_lines(audit, main, title, catalog, now), f"{path}/main_md")
    write_lines(report.sample_lines(audit, category_rules, title, catalog, now), f"{path}/samples_md")
