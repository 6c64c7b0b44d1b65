"""The first rows of each group, by heads that are kept small in every task and merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task holds before it trims, and those it holds at most; what is more is handed on and merged later.
ROOM, MOST = 20_000, 200_000


def _new_group(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in by:
        column = table[c].combine_chunks()
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.if_else(pc.or_(pc.is_null(before), pc.is_null(after)), pc.xor(pc.is_null(before), pc.is_null(after)), pc.not_equal(before, after))
        new[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
    return new


def _heads(table: pa.Table, by: list[str], order: list[tuple[str, str]], n: int) -> tuple[pa.Table, np.ndarray]:
    """The first ``n`` rows of each group, sorted, and their ranks from 1."""
    table = table.sort_by([*((c, "ascending") for c in by), *order])
    first = np.flatnonzero(_new_group(table, by))
    rank = np.arange(len(table)) - np.repeat(first, np.diff(np.append(first, len(table)))) + 1
    return table.filter(pa.array(rank <= n)), rank[rank <= n]


def top_rows(df: DataFrame, by: list[str], order: list[tuple[str, bool]], n: int, rank: str | None = None) -> DataFrame:
    """At most ``n`` rows of each group, the first by ``order`` (name, whether falling); ``rank`` names a column for their places.

    Nulls count as the least values, NaN as the greatest; a null is a group of its own. Every task keeps the heads of its groups
    only, so a group of any size hands on ``n`` rows a task, and no window runs over the rows.
    """
    kinds, key = dict(df.dtypes), "__group"
    rows, sort = df, []
    for k, (c, falling) in enumerate(order):
        odd = F.isnan(c) if kinds[c] in ("float", "double") else F.lit(False)
        place = F.when(F.col(c).isNull(), 2 if falling else 0).when(odd, 0 if falling else 2).otherwise(1)
        rows = rows.withColumn(f"__place_{k}", place)
        sort += [(f"__place_{k}", "ascending"), (c, "descending" if falling else "ascending")]
    if not by:
        rows = rows.withColumn(key, F.lit(0))
    groups = list(by) or [key]
    schema, columns = rows.schema, df.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, waiting = None, [], 0
        for batch in batches:
            fresh.append(batch)
            waiting += batch.num_rows
            if waiting >= ROOM:
                table = pa.Table.from_batches(fresh)
                held = _heads(pa.concat_tables([held, table]) if held is not None else table, groups, sort, n)[0]
                fresh, waiting = [], 0
                if len(held) > MOST:
                    yield from held.to_batches()
                    held = None
        if fresh:
            table = pa.Table.from_batches(fresh)
            held = _heads(pa.concat_tables([held, table]) if held is not None else table, groups, sort, n)[0]
        if held is not None:
            yield from held.to_batches()

    def final(table: pa.Table) -> pa.Table:
        found, places = _heads(table, groups, sort, n)
        found = found.select(columns)
        return found.append_column(rank, pa.array(places, pa.int32())) if rank else found

    out = T.StructType([*df.schema.fields, *([T.StructField(rank, T.IntegerType())] if rank else [])])
    return rows.mapInArrow(partial, schema).groupBy(*groups).applyInArrow(final, out)
