"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, MapType, StringType, StructField, StructType, TimestampType

_TYPES = {
    "string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(),
    "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType()), "map<string,boolean>": MapType(StringType(), BooleanType()),
}


def _schema(columns: str) -> StructType:
    """From ``name type`` pairs; unlike Spark's own parser it needs no session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split(" ") for c in columns.split(", "))])

PAGES = _schema(
    "page_key string, curriculum_key string, detail_url string, classroom string, code string, school_year string, student_id string, student_name string, "
    "grade string, division string, subject string, school_course string, row_index int, page_index int, status string, html string, fetched_at timestamp, "
    "error string, retries int"
)
TARGETS = _schema(
    "page_key string, seq int, target_no string, target_name string, start_date date, end_date date, period_text string, is_current boolean, target_score string, "
    "current_score string, site_progress string, progress_delay string"
)
UNITS = _schema(
    "page_key string, row_no int, unit_name string, middle_unit string, textbook string, problem_code string, score double, max_score double, score_rate double, "
    "exec_date date, today_textbook string, division_text string, confirm_test string, target_checks map<string,boolean>"
)
PROGRESS = _schema(
    "page_key string, seq int, target_no string, units int, executed int, on_time int, before int, after int, not_executed int, executed_rate double, on_time_rate double, "
    "before_rate double, after_rate double, not_executed_rate double, latest date, textbooks string"
)
FINDINGS = _schema(
    "page_key string, severity string, errors array<string>, warnings array<string>, reviews array<string>, fix_items array<string>, "
    "sections map<string,string>, unclassified array<string>"
)
STORE = {"pages": PAGES, "targets": TARGETS, "units": UNITS, "progress": PROGRESS, "findings": FINDINGS}
#: States of a page.
STATUSES = ("unfetched", "fetching", "fetched", "fetch_failed", "parsing", "parsed", "parse_failed", "saved", "skipped")
