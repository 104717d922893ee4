"""Classification by rules over names and messages.

Column rules are patterns; table, category and error rules are ordered lists in
which the first match wins. Rules become one ``CASE`` expression: no join, and any
number of rows is classified inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns, matched from the start of the lower-cased name.
KEY_PATTERNS = (
    ".*_id$", ".*_key$", "^id$", "^key$", ".*_pk$", ".*_uuid$", ".*_guid$",
    "emp_id", "employee_id", "client_id", "person_id", "work_id",
)
# A name containing one of these words.
DATE_WORDS = (
    "date", "time", "created", "updated", "modified", "timestamp", "start", "end",
    "effective", "expire",
)
IMPORTANT_WORDS = (
    "name", "status", "type", "code", "amount", "salary", "rate", "count", "flag", "indicator",
)


@dataclass(frozen=True)
class Rule:
    """If the text contains one of ``words``, the outputs apply."""

    words: tuple[str, ...]
    outputs: Mapping[str, str]


# What a table is about, by words in its lower-cased name; the first match wins.
PURPOSE_RULES = (
    Rule(("employee", "person", "pers"), {"business_purpose": "Employee/Person Data"}),
    Rule(("client", "clnt"), {"business_purpose": "Client Data"}),
    Rule(("work", "job", "assignment"), {"business_purpose": "Work Assignment Data"}),
    Rule(("payroll", "payrl", "earn"), {"business_purpose": "Payroll/Earnings Data"}),
    Rule(("turnover", "trnovr"), {"business_purpose": "Turnover Prediction"}),
    Rule(("hierarchy", "hrchy", "manager", "mngr"), {"business_purpose": "Organizational Hierarchy"}),
    Rule(("dim_", "dimension"), {"business_purpose": "Dimension Table"}),
    Rule(("fact_",), {"business_purpose": "Fact Table"}),
)
UNKNOWN_ERROR = "Unknown error"
ANALYSIS_ERROR = "Analysis error"
#: An error condition at the start of a text, and names of tables and columns inside one.
CONDITION = r"^\[?([A-Z][A-Z0-9]*(?:[._][A-Z0-9_]+)+)(?=\]|:|\s|$)"
NAMES = r"`[^`]*`|'[^']*'|\"[^\"]*\"|\b[A-Za-z]\w*(?:\.\w+)+\b"
# Classes of access errors, by words in the error condition and message.
# An unknown cause leaves ``exists`` null: a time-out is no evidence that a table exists.
ERROR_RULES = (
    Rule(("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "DOES NOT EXIST"),
         {"error_class": "Table does not exist", "exists": "false"}),
    Rule(("SCHEMA_NOT_FOUND",), {"error_class": "Schema does not exist", "exists": "false"}),
    Rule(("PERMISSION_DENIED", "ACCESS_DENIED", "INSUFFICIENT_PERMISSIONS", "PERMISSION"),
         {"error_class": "Permission denied", "exists": "true"}),
    Rule(("INVALID_CATALOG", "REQUIRES_SINGLE_PART_NAMESPACE"),
         {"error_class": "Invalid catalog", "exists": "false"}),
    Rule(("TIMEOUT",), {"error_class": "Query timeout"}),
    Rule(("CONNECTION",), {"error_class": "Connection error"}),
    Rule(("MEMORY",), {"error_class": "Memory error"}),
)


def is_key_name(name: Column) -> Column:
    return F.lower(name).rlike("^(?:" + "|".join(KEY_PATTERNS) + ")")


def is_date_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(DATE_WORDS))


def is_important_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(IMPORTANT_WORDS))


def first_match(text: Column, rules: Sequence[Rule], output: str, default: str | None) -> Column:
    """``output`` of the first rule with a word contained in ``text``."""
    otherwise = F.lit(default).cast("string")
    case = None
    for rule in rules:
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in rule.words])
        value = F.lit(rule.outputs.get(output, default)).cast("string")
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return otherwise if case is None else case.otherwise(otherwise)


def with_table_context(
    df: DataFrame, schema_name: str, short_name: str, stage_rules: Sequence[Rule],
    purpose_rules: Sequence[Rule] = PURPOSE_RULES,
) -> DataFrame:
    """Adds stage, source, priority (by schema) and purpose (by table name)."""
    schema = F.col(schema_name)
    return df.withColumns(
        {
            "pipeline_stage": first_match(schema, stage_rules, "pipeline_stage", "Unknown"),
            "data_source": first_match(schema, stage_rules, "data_source", "Unknown"),
            "migration_priority": first_match(schema, stage_rules, "migration_priority", "Low"),
            "business_purpose": first_match(
                F.lower(F.col(short_name)), purpose_rules, "business_purpose", "Unknown"
            ),
        }
    )


def with_report_category(
    df: DataFrame, name: str, rules: Sequence[Rule], default: str = "Other Tables"
) -> DataFrame:
    """Adds ``report_category``, the section of the report a table belongs to."""
    return df.withColumn(
        "report_category", first_match(F.col(name), rules, "report_category", default)
    )


def with_error_class(df: DataFrame, message: str, rules: Sequence[Rule] = ERROR_RULES) -> DataFrame:
    """Adds ``error_class`` and ``exists`` (null when unknown) for an error text; null stays null.

    A text that begins with an error condition, such as ``[SCHEMA_NOT_FOUND]``, is classed by
    it alone; one that no rule knows is an analysis error. Other texts are searched, without
    the quoted and the dotted names in them, which are those of tables and columns.
    """
    condition = F.regexp_extract(F.col(message), CONDITION, 1)
    told = F.upper(F.regexp_replace(F.col(message), NAMES, " "))
    text = F.when(condition != "", condition).otherwise(told)
    unknown = F.when(condition != "", F.lit(ANALYSIS_ERROR)).otherwise(F.lit(UNKNOWN_ERROR))
    known = F.coalesce(first_match(text, rules, "error_class", None), unknown)
    return df.withColumns(
        {
            "error_class": F.when(F.col(message).isNotNull(), known),
            "exists": F.when(
                F.col(message).isNotNull(), first_match(text, rules, "exists", None).cast("boolean")
            ),
        }
    )
