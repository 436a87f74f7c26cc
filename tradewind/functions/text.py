"""Text, casting and season helpers (all built-in column functions, no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like_any(c, patterns: Iterable[str]) -> Column:
    """Case-insensitive ``LIKE`` against any pattern (``%``/``_`` wildcards); false for no patterns."""
    terms = [col(c).ilike(p) for p in patterns]
    return reduce(or_, terms) if terms else F.lit(False)


def concat_skip_null(*cols) -> Column:
    """String concatenation that treats NULL as empty (``concat`` would return NULL)."""
    return F.concat_ws("", *[col(c).cast("string") for c in cols])


def two_digit(c) -> Column:
    """Zero-padded two-digit text of an integer; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.format_string("%02d", c))


def safe_int(c) -> Column:
    """Whole number (bigint) from text; NULL for text that is no whole number (``'Other'``, ``''``).

    A whole number that does not fit a bigint is an error: as NULL its row would silently leave joins
    and filters.
    """
    text = col(c).cast("string")
    number = text.try_cast("bigint")
    too_large = number.isNull() & text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(too_large, F.raise_error(F.concat(F.lit("whole number out of range: "), text)).cast("bigint")).otherwise(number)


def starts_with(c, prefix: str) -> Column:
    """Prefix test on the text form of a key (pushable when ``c`` is a string column)."""
    return col(c).cast("string").startswith(prefix)


def is_blank(c) -> Column:
    """Zero-length text (a single space is not blank)."""
    return F.octet_length(col(c)) == 0


def row_sum(cols: Iterable) -> Column:
    return reduce(add, [col(c) for c in cols])


# --- seasons -------------------------------------------------------------------------------

def season_year_text(season) -> Column:
    """Last four characters of a season label such as ``'Fall 2021'``."""
    return F.right(col(season), F.lit(4))


def season_year(season) -> Column:
    """Year of a season label as int; NULL when the label does not end in a number."""
    return season_year_text(season).try_cast("int")


def season_order(season) -> Column:
    """1 for spring seasons, 2 for everything else."""
    return F.when(col(season).ilike("%Spring%"), F.lit(1)).otherwise(F.lit(2))


def season_half_spring_first(season) -> Column:
    """Half-year name where only spring labels are Spring-Summer (other labels: Fall-Winter)."""
    return F.when(col(season).ilike("%Spring%"), F.lit("Spring-Summer")).otherwise(F.lit("Fall-Winter"))


def season_half_fall_first(season) -> Column:
    """Half-year name where only fall labels are Fall-Winter (other labels: Spring-Summer)."""
    return F.when(col(season).ilike("%Fall%"), F.lit("Fall-Winter")).otherwise(F.lit("Spring-Summer"))


def historic_season(season) -> Column:
    """Sortable season code ``<year text><1|2>`` (spring before fall within a year)."""
    return concat_skip_null(season_year_text(season), season_order(season))
