"""The different notions of a missing cell. Each operator uses the one that its rules call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def missing_upload(c: Column) -> Column:
    """Null, ``-`` or empty."""
    return c.isNull() | _in(c.cast("string"), "-", "")


def missing_input(c: Column) -> Column:
    """Null, or ``-`` or empty after trimming white space."""
    return c.isNull() | _in(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), "-", "")


def missing_image(c: Column) -> Column:
    """Null or one of the words that stand for no image; no trimming."""
    return c.isNull() | _in(c.cast("string"), "", "-", "nan", "NaN", "none", "None")


def missing_link(c: Column) -> Column:
    """Null or one of the words that stand for no link."""
    return c.isNull() | _in(c.cast("string"), "", "-", "None", "nan")


def missing_market_image(url: Column, local_path: Column, source: Column, wanted: str) -> Column:
    """An image struct of another source, or one with neither url nor file."""
    blank = lambda c: c.isNull() | _in(F.trim(c), "", "-")
    return ~F.coalesce(source == wanted, F.lit(False)) | (blank(url) & blank(local_path))


def to_number(c: Column) -> Column:
    """A number from text with commas, percent signs or blanks; null for anything else, such as a message or ``12d``."""
    text = F.regexp_replace(F.trim(c.cast("string")), "[,%\\s]", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def accounting_number(c: Column) -> Column:
    """As :func:`to_number`; ``(100)`` is -100."""
    return to_number(F.regexp_replace(F.regexp_replace(c.cast("string"), "[,\\s]", ""), r"^\((.*)\)$", "-$1"))


def true(c: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(c, F.lit(False))


def stripped(df: DataFrame) -> DataFrame:
    """All text columns without white space at their ends."""
    return df.withColumns({f.name: F.regexp_replace(F.col(f"`{f.name}`"), r"(?U)^\s+|\s+$", "") for f in df.schema.fields if f.dataType.typeName() == "string"})
