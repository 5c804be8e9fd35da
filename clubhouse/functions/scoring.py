"""Score, flag and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clubhouse.functions.names import _col


def to_par(stored, strokes, par) -> Column:
    """The stored value, else strokes minus par."""
    return F.coalesce(_col(stored), _col(strokes) - _col(par))


def is_counted(disqualified="disqualified") -> Column:
    """Not disqualified; an unknown flag counts as not disqualified."""
    return ~F.coalesce(_col(disqualified), F.lit(False))


def is_win(placement="placement", disqualified="disqualified") -> Column:
    return F.coalesce(_col(placement) == 1, F.lit(False)) & is_counted(disqualified)


def disqualified_on_load(strokes="strokes", notes="notes") -> Column:
    """A staged row counts as disqualified without strokes or with "dq" in its notes."""
    return _col(strokes).isNull() | F.coalesce(_col(notes), F.lit("")).ilike("%dq%")


def whole_strokes(strokes="strokes") -> Column:
    """Decimal strokes as an integer, halves away from zero."""
    return F.round(_col(strokes)).cast("int")


def differs(left, right) -> Column:
    """Null-safe "is distinct from"."""
    return ~_col(left).eqNullSafe(_col(right))


def text_key(column) -> Column:
    return F.coalesce(_col(column), F.lit(""))


def id_key(column) -> Column:
    """Ids start at 1, so 0 can stand for "no id"."""
    return F.coalesce(_col(column), F.lit(0))


def location(city="city", state="state") -> Column:
    """"City, State"; NULL as soon as one part is NULL."""
    return F.concat(_col(city), F.lit(", "), _col(state))


def two_decimals(column) -> Column:
    return _col(column).cast("decimal(10,2)")


def exact_average(total, count) -> Column:
    """Average of integers to two decimals, halves away from zero.

    The quotient keeps 18 decimals, so the one visible rounding is the last.
    """
    quotient = _col(total).cast("decimal(20,0)") / F.nullif(_col(count), F.lit(0)).cast(
        "decimal(20,0)"
    )
    return two_decimals(quotient)
