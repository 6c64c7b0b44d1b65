"""Small column builders that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for a missing value, and for a missing author.
FALSE_NULLS = ("none", "null", "nothing else")
FALSE_AUTHORS = ("no author", "none", "null")


def existing(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """First column that is not blank, and its name."""
    found = existing(df, names)
    if not found:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    text = [nullif_blank(F.col(f"`{n}`").cast("string")) for n in found]
    return F.coalesce(*text), F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for t, n in zip(text, found, strict=True)])


def as_text(df: DataFrame, name: str) -> Column:
    """Lists joined by spaces (empty: null), other values as strings."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.when(F.size(c) > 0, F.array_join(c.cast("array<string>"), " "))
    return c.cast("string")


def null_words(c: Column, words: tuple[str, ...] = FALSE_NULLS) -> Column:
    """Words for nothing become null, whatever their case and surrounding space."""
    return F.when(~F.lower(F.trim(c)).isin(*words), c)


def as_list(df: DataFrame, name: str) -> Column:
    """A list; scalars become lists of one, nulls and words for nothing the empty list."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(c.cast("array<string>"), F.expr("cast(array() as array<string>)"))
    kept = null_words(c.cast("string"))
    return F.when(kept.isNotNull(), F.array(kept)).otherwise(F.expr("cast(array() as array<string>)"))


def filled_list(c: Column) -> Column:
    """The list, null if empty."""
    return F.when(F.size(c) > 0, c)


def meaningful(c: Column) -> Column:
    """Trimmed strings of a list, without blanks."""
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` of ``whole`` as a percentage, ``0.00%`` where there is nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit("0.00%")).otherwise(F.format_string(f"%.{digits}f%%", F.lit(100.0) * part / whole))
