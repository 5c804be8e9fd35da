"""Name expressions (columns in, column out)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TEAM_SEPARATOR = " / "


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def full_name(first, last) -> Column:
    """"First Last"; a NULL part is left out, two NULLs give ''."""
    return F.concat_ws(" ", _col(first), _col(last))


def strict_full_name(first, last) -> Column:
    """"First Last"; NULL as soon as one part is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def tidy_full_name(first, last) -> Column:
    """"First Last" without empty parts, trimmed."""
    return F.trim(
        F.concat_ws(" ", F.nullif(_col(first), F.lit("")), F.nullif(_col(last), F.lit("")))
    )


def joined_name(first, last) -> Column:
    """"First Last" where a NULL part counts as empty text but the space stays."""
    empty = F.lit("")
    return F.concat(F.coalesce(_col(first), empty), F.lit(" "), F.coalesce(_col(last), empty))


def compact_name(first, last) -> Column:
    """"F. Last"; a NULL part counts as empty text."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(F.left(_col(first), F.lit(1)), empty),
        F.lit(". "),
        F.coalesce(_col(last), empty),
    )


def compact_team_name(*names) -> Column:
    """"F. Last / G. Other": NULL members are left out, and blanks and slashes
    are trimmed off both ends."""
    joined = F.concat_ws(TEAM_SEPARATOR, *[_col(n) for n in names])
    return F.trim(joined, F.lit(TEAM_SEPARATOR))


def player_ids(*ids) -> Column:
    """Member ids as an array without NULLs, in slot order, duplicates kept."""
    return F.array_compact(F.array(*[_col(i) for i in ids]))


def is_member(player, *ids) -> Column:
    """True if the player fills one of the slots. For a given player a scan can
    check the comparisons, which an IN over columns would not let it do."""
    return reduce(or_, [_col(i) == _col(player) for i in ids])


def in_order_of(column: str, collation: str | None) -> Column:
    """A text as a sort key, NULLs last: by bytes, or as a collation (such as
    "UNICODE" or "de") has it."""
    return F.asc_nulls_last(column if collation is None else F.collate(F.col(column), collation))
