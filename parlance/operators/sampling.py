"""Reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.top import top_rows


def seeded(seed: int, *columns: str) -> Column:
    """A hash that orders rows the same way everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def round_robin(df: DataFrame, n: int, pair: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, evenly over the pairs, shuffled inside and between them; null members count as UNKNOWN."""
    named = df
    for c in pair:
        named = named.withColumn(f"__{c}", F.coalesce(F.col(c), F.lit(f"UNKNOWN_{c.upper()}")))
    keys = [f"__{c}" for c in pair]
    turns = top_rows(named.withColumn("__seeded", seeded(seed, id_col)), keys, [("__seeded", False), (id_col, False)], n, "__turn")
    return turns.orderBy("__turn", seeded(seed, *keys), *keys).limit(n).drop("__turn", "__seeded", *keys)


def simple(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(seed, id_col), id_col).limit(n)


def excerpt(text: Column, title: Column | None = None, length: int = 300) -> Column:
    """The start of a text, white space made even; null as an empty string. A title in front goes, with the colons, dashes, spaces and line breaks behind it."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    body = clean(text)
    if title is not None:
        head = clean(title)
        body = F.when((head != "") & body.startswith(head), F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), r"^[\n :\-]+", "")).otherwise(body)
    return F.substring(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), 1, length)
