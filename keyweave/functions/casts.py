"""Casts and orderings whose semantics differ between text data and Spark defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Unicode-aware strip removes (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set inside a regular expression with Unicode classes.
SPACE_CLASS = r"[\s\x1c-\x1f]"

# Words that stand for a missing value (fixed values): nan, none, null.
_MISSING_WORD = r"^(?i:nan|none|null)$"

# Text that is a number: no 'd'/'f' suffix, no thousands separators.
_NUMBER = (
    r"^[ \t\n\x0b\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[+-]?(?i:nan|inf|infinity))[ \t\n\x0b\f\r]*$"
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Unicode-aware strip (Spark's own ``trim`` removes only the ASCII space)."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def clean(value: Column | str) -> Column:
    """Stripped text, or NULL when it is blank or one of the missing-value words."""
    return F.nullif(F.regexp_replace(strip(value), _MISSING_WORD, ""), F.lit(""))


def strict_double(value: Column | str) -> Column:
    """Text to double, NULL unless the whole text is a number."""
    return F.regexp_extract(as_column(value), _NUMBER, 1).try_cast("double")


def metric_double(value: Column | str) -> Column:
    """The number inside a metric column: thousands separators are removed first."""
    return strict_double(F.replace(as_column(value), F.lit(","), F.lit("")))


def finite_or_null(value: Column | str) -> Column:
    """NaN and infinities become NULL when a result leaves the engine."""
    number = as_column(value)
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)


def like_pattern(pattern: str) -> str:
    """A LIKE pattern without escape character: backslashes are ordinary text."""
    return pattern.replace("\\", "\\\\")


def nulls_last(name: str, descending: bool = False) -> Column:
    """Sort order with NULLs last in both directions."""
    column = F.col(f"`{name}`")
    return column.desc_nulls_last() if descending else column.asc_nulls_last()
