"""Keys of lessons and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def curriculum_key(code: Column, student: Column, subject: Column, page: Column, row: Column) -> Column:
    """``code_student_subject_row``, with the page before the row from page 2 on."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (code, student, subject)]
    return F.concat_ws("_", *text, F.when(page > 1, page.cast("string")), F.coalesce(row.cast("string"), F.lit("")))


def page_key(url: Column, key: Column) -> Column:
    """The page's address, or the curriculum key where it has none."""
    return F.coalesce(F.nullif(url, F.lit("")), key)


def page_index_from_key(key: Column) -> Column:
    """The last but one of five or more parts if that is a number from 2 on, else 1."""
    parts = F.split(key, "_")
    number = F.element_at(parts, -2).try_cast("int")
    return F.when((F.size(parts) >= 5) & (number >= 2), number).otherwise(1)
