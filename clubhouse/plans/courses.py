"""Course lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.functions.names import in_order_of
from clubhouse.schemas import COURSES
from clubhouse.tables import Tables


def course_list(tables: Tables, ordered: bool = True, collation: str | None = None) -> DataFrame:
    """All courses by name, in the order of bytes or of a collation; equal names by id."""
    listed = tables.courses.select(*COURSES.names)
    return listed.orderBy(in_order_of("name", collation), F.asc_nulls_last("id")) if ordered else listed


def course_by_id(tables: Tables, course_id: int) -> DataFrame:
    return tables.courses.where(F.col("id") == course_id).select(*COURSES.names).limit(1)
