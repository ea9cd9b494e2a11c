"""Native text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that every operator here means, as characters and as a class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than white space, in order."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, not once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)
