"""Competition results on Spark: load sheets, check and change tables, report."""

from clubhouse.tables import Tables

__all__ = ["Tables"]
