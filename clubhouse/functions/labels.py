"""Presentation columns: the texts a results page shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clubhouse.functions.names import TEAM_SEPARATOR, _col

# Fixed texts.
NO_VALUE = "—"
EVEN_PAR = "E"
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}
UNKNOWN_COURSE = "Unknown Course"
COURSE_TO_BE_DECIDED = "TBD"
MAJOR = "Major Tournament"
DATE_FORMAT = "MMM d, yyyy"
UNNAMED_EVENT = "(Unnamed Event)"
NO_DATE = "No date"
DEBUT = "Debut "
HALL_OF_FAME = "Hall of Fame"
SEPARATOR = " · "


def _filled(column) -> Column:
    """Empty text as NULL."""
    return F.nullif(_col(column), F.lit(""))


def to_par_label(value) -> Column:
    value = _col(value)
    return (
        F.when(value.isNull(), NO_VALUE)
        .when(value == 0, EVEN_PAR)
        .when(value > 0, F.concat(F.lit("+"), value.cast("string")))
        .otherwise(value.cast("string"))
    )


def date_label(date) -> Column:
    return F.date_format(_col(date), DATE_FORMAT)


def team_label(*names, separator: str = TEAM_SEPARATOR) -> Column:
    return F.concat_ws(separator, *[_filled(n) for n in names])


def course_label(name, par, course_id) -> Column:
    """"Name (Par n)", "Name" without a par, "Course #id" without a name."""
    par = F.nullif(_col(par), F.lit(0)).cast("string")
    suffix = F.coalesce(F.concat(F.lit(" (Par "), par, F.lit(")")), F.lit(""))
    number = F.coalesce(_col(course_id).cast("string"), F.lit(NO_VALUE))
    return F.coalesce(
        F.concat(_filled(name), suffix), F.concat(F.lit("Course #"), number)
    )


def medal(placement) -> Column:
    placement = _col(placement)
    label = F.concat(F.lit("#"), placement.cast("string"))
    for place, sign in MEDALS.items():
        label = F.when(placement == place, sign).otherwise(label)
    return label


def course_or_unknown(name) -> Column:
    return F.coalesce(_filled(name), F.lit(UNKNOWN_COURSE))


def course_or_undecided(name) -> Column:
    return F.coalesce(_filled(name), F.lit(COURSE_TO_BE_DECIDED))


def major_title(is_major, label) -> Column:
    """The major's own label or a general one; NULL for other events."""
    return F.when(_col(is_major), F.coalesce(_filled(label), F.lit(MAJOR)))


def value_or_dash(value) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(NO_VALUE))


def two_decimal_label(value) -> Column:
    """A number as text with two decimals and no grouping, halves rounded up."""
    return _col(value).cast("decimal(20,2)").cast("string")


def player_title(full_name, nickname) -> Column:
    """A player's name, with the nickname in quotation marks if there is one."""
    nick = F.concat(F.lit(" (“"), _filled(nickname), F.lit("”)"))
    return F.concat(_col(full_name), F.coalesce(nick, F.lit("")))


def _debut(year) -> Column:
    return F.concat(F.lit(DEBUT), F.nullif(_col(year), F.lit(0)).cast("string"))


def player_line(hometown, debut_year) -> Column:
    """Hometown and debut, whichever is known; '' for neither."""
    return F.concat_ws(SEPARATOR, _filled(hometown), _debut(debut_year))


def player_detail_line(hometown, debut_year, hof_inducted, hof_year) -> Column:
    """Hometown, debut and hall of fame. The separators belong to the first and
    the last of the three, whether or not there is a debut."""
    home = F.concat(_filled(hometown), F.lit(SEPARATOR))
    year = F.concat(F.lit(" ("), F.nullif(_col(hof_year), F.lit(0)).cast("string"), F.lit(")"))
    fame = F.concat(F.lit(SEPARATOR + HALL_OF_FAME), F.coalesce(year, F.lit("")))
    return F.concat_ws("", home, _debut(debut_year), F.when(_col(hof_inducted), fame))


def event_title(name) -> Column:
    return F.coalesce(_filled(name), F.lit(UNNAMED_EVENT))


def date_or_none(date) -> Column:
    return F.coalesce(date_label(date), F.lit(NO_DATE))


def member_label(name, player_id) -> Column:
    """A member's name, or "#id" without one."""
    return F.coalesce(_filled(name), F.concat(F.lit("#"), _col(player_id).cast("string")))


def members_label(names, ids, separator: str = TEAM_SEPARATOR) -> Column:
    """The members of a team by name or "#id"; a dash for a team of nobody."""
    listed = [F.when(_col(i).isNotNull(), member_label(n, i)) for n, i in zip(names, ids)]
    return F.coalesce(F.nullif(F.concat_ws(separator, *listed), F.lit("")), F.lit(NO_VALUE))
