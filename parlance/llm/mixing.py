"""Mixing sources to target weights by fitting subset sums of document lengths.

A source's target is a number of words between nothing and twice its size. Up to its size each document is taken
whole at most once; beyond, every document is taken once and the rest of the target is fitted with second copies.
Fitting works on counts of documents by exact length: each length first gives its proportional share, rounded down,
then lengths from the longest down fill the rest, and the last ``WINDOW`` words are fitted exactly by bounded-knapsack
dynamic programming over the counts that are left. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import stash

SHARE, TIMES, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), 17
#: Words that dynamic programming fits; counts of lengths beyond it are filled from the longest down.
WINDOW = 20_000
#: Documents of a length that are given back before the last fit.
ROOM = 64
SALTS = 64

WORDS = r"cast(regexp_count(__text, r'[^\x20\x09-\x0D]+') as bigint)"


def subset_sum(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Copies of each length whose sum comes nearest to ``budget`` from below; bounded counts split into powers of two, sums kept as bits."""
    mask, sums, items, states = (1 << (budget + 1)) - 1, 1, [], []
    for length, count in counts:
        count, size = min(count, budget // length if length else 0), 1
        while count > 0:
            take = min(size, count)
            if sums >> budget & 1:
                break
            items.append((length, take))
            states.append(sums)
            sums |= (sums << (length * take)) & mask
            count, size = count - take, size * 2
    at, taken = sums.bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(states), strict=True):
        if not before >> at & 1:  # not reached without this item
            at -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def fit_counts(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """Documents to take of each length (at most ``counts``) so that their words come near ``budget`` and don't pass it."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    budget = min(budget, total)
    if budget <= 0 or total == 0:
        return [0] * len(sizes)
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
    rest = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:  # long lengths first, down to the window
        if sizes[i] and rest > WINDOW:
            more = min(counts[i] - take[i], (rest - WINDOW) // sizes[i])
            take[i], rest = take[i] + more, rest - more * sizes[i]
    for i in reversed(order):  # some documents of each length, short ones first, go back for the dynamic programme to choose from
        if sizes[i] and rest < WINDOW:
            back = min(take[i], ROOM, (WINDOW - rest) // sizes[i])
            take[i], rest = take[i] - back, rest + back * sizes[i]
    left = [(sizes[i], counts[i] - take[i]) for i in order if 0 < sizes[i] <= rest and counts[i] > take[i]]
    number = {s: i for i, s in enumerate(sizes)}
    for length, more in subset_sum(left, rest).items():
        take[number[length]] += more
    return take


def targets(sizes: DataFrame, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """``source, source_size`` -> with ``target``: weights 5, 2, 1 by code point (null last), stopped at ``times`` the size.

    Resharing the excess by weight until nobody is above ends where each target is ``min(times * size, level * weight)``;
    the level follows from running sums in the order of ``times * size / weight``. One row per source is all that is sorted.
    """
    place = Window.orderBy(F.col("__source").isNull(), F.col("__source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    fill = Window.orderBy("__ratio", F.col("__source").isNull(), "__source")
    every = Window.partitionBy()
    ranked = sizes.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * float(times)).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    ranked = (
        ranked.withColumn("__budget", F.sum("source_size").over(every) * share)
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__open", F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__budget") - F.col("__capped")) / F.col("__open"))
    )
    level = F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(every)
    return ranked.withColumn("target", F.least(F.col("__cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("__weight"))).select("__source", "source_size", "target")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, times: int = TIMES, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """``size, source_size, target, taken`` of every document.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, an empty one another.
    Repeated rows count each; which of equal rows is taken makes no difference. Other columns come back if ``carry`` names them.
    """
    spark = documents.sparkSession
    inner = [F.col(f"`{c}`").alias(f"__carry_{i}") for i, c in enumerate(carry or [])]
    rows = documents.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").cast("string").alias("__source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), *inner)
    rows = rows.withColumn("size", F.expr(WORDS)).withColumn("__order", F.xxhash64(F.lit(seed), "__id", "__text")).drop("__text")
    rows = rows.withColumn("__salt", F.pmod("__order", F.lit(SALTS)).cast("int"))
    counts = stash(rows.groupBy("__source", "size", "__salt").agg(F.count("*").alias("n")), "lengths")
    sized = counts.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stash(targets(sized, share, times), "targets")
    by_length = counts.groupBy("__source", "size").agg(F.sum("n").alias("n"))
    goal = goal.withColumnRenamed("__source", "goal_source")
    fitted = by_length.join(goal, F.col("__source").eqNullSafe(F.col("goal_source"))).drop("goal_source")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        size, aim = int(group["source_size"][0]), round(float(group["target"][0]))
        rounds, rest = divmod(aim, size) if size else (0, 0)
        take = fit_counts([int(x) for x in group["size"]], [int(x) for x in group["n"]], rest)
        return group.assign(rounds=rounds, extra=take)[["__source", "size", "source_size", "target", "rounds", "extra"]]

    plan = fitted.groupBy("__source").applyInPandas(fit, "__source string, size long, source_size long, target double, rounds long, extra long")
    plan = plan.withColumnsRenamed({"__source": "plan_source", "size": "plan_size"})
    # the copies of a length go to its salts in order
    before = Window.partitionBy("__source", "size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = salts.join(plan, F.col("__source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size"))).select(
        F.col("__source").alias("q_source"), F.col("size").alias("q_size"), F.col("__salt").alias("q_salt"), "source_size", "target", "rounds", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("__before"))).alias("quota")
    )
    within = Window.partitionBy("__source", "size", "__salt").orderBy("__order", "__id")
    ranked = rows.withColumn("__rank", F.row_number().over(within))
    joined = ranked.join(quota, F.col("__source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("__salt") == F.col("q_salt")))
    taken = F.col("size") * (F.col("rounds") + F.when((F.col("__rank") <= F.col("quota")) & (F.col("size") > 0), 1).otherwise(0))
    out = joined.select(F.col("__id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"__carry_{i}") for i in range(len(inner))])
    for i, c in enumerate(carry or []):
        out = out.withColumnRenamed(f"__carry_{i}", c)
    return out
