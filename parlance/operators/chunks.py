"""Context chunks around matched sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_chunks(matched: DataFrame, id_col: str = "entry_ID", least: int = 250, carry: list[str] = ()) -> DataFrame:
    """Chunks of each text, numbered, without repeats of the same set of matched sentences.

    Around each matched sentence its neighbours join in the order +1, -1, +2, -2, ... as long as those before hold fewer
    than ``least`` characters; parts are joined by ``". "`` in that order. ``carry`` names columns of the matched sentence (actor, date, source)
    that come along. Running sums of lengths tell how far a chunk reaches, by bisection; only finished chunks leave the row of their text.
    """
    order = Window.partitionBy(id_col).orderBy("sentence_id")
    entry = F.struct("sentence_id", "sentence", "matched", "matched_keywords", "matched_words", "upto", *carry)
    rows = matched.withColumn("upto", F.sum(F.length("sentence").cast("long")).over(order))
    texts = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("s"), F.max("matched").alias("hit")).filter("hit = 1")
    # characters of the sentence at `at` and of those up to r to its right and l to its left
    held = lambda r, l: f"(s[least(size(s) - 1, at + {r})].upto - case when at - {l} > 0 then s[at - {l} - 1].upto else 0 end)"
    # the largest number k of neighbours (right ones first) of which the last joins a chunk that is still short
    short = held("cast((a.mid) div 2 as int)", "cast((a.mid - 1) div 2 as int)")
    bisect = f"""aggregate(sequence(1, 33), struct(0 as lo, 2 * size(s) as hi, cast(size(s) as int) as mid),
        (a, x) -> case when a.lo >= a.hi then a when {short} < {least}
            then struct(a.mid as lo, a.hi as hi, a.mid + cast((a.hi - a.mid + 1) div 2 as int) as mid)
            else struct(a.lo as lo, a.mid - 1 as hi, a.lo + cast((a.mid - 1 - a.lo + 1) div 2 as int) as mid) end, a -> a.lo)"""
    reach = f"filter(transform(sequence(0, {bisect}), k -> at + case when k % 2 = 1 then cast((k + 1) div 2 as int) else -cast(k div 2 as int) end), i -> i >= 0 and i < size(s))"
    kept = ", ".join(["at", f"{reach} as parts", *[f"s[at].{c} as {c}" for c in carry]])
    gather = lambda c: f"nullif(array_join(array_distinct(flatten(transform(x.members, i -> coalesce(s[i].{c}, cast(array() as array<string>))))), ', '), '')"
    more = "".join(f", x.{c} as {c}" for c in carry)
    grown = f"transform(filter(sequence(0, size(s) - 1), at -> s[at].matched = 1), at -> struct({kept}))"
    named = f"transform({grown}, x -> struct(x.at as at, x.parts as parts, array_sort(filter(x.parts, i -> s[i].matched = 1)) as members{more}))"
    whole = f"transform({named}, x -> struct(x.at as at, x.members as members, array_join(transform(x.parts, i -> s[i].sentence), '. ') as chunk, {gather('matched_keywords')} as matched_keywords, {gather('matched_words')} as matched_words{more}))"
    each = texts.select(id_col, F.explode(F.expr(whole)).alias("x")).select(id_col, "x.*")
    once = each.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "members").orderBy("at"))).filter("__n = 1")
    numbered = once.withColumn("chunk_id", F.row_number().over(Window.partitionBy(id_col).orderBy("at")))
    return numbered.select(id_col, "chunk_id", (F.col("at") + 1).alias("anchor_id"), *carry, "chunk", "matched_keywords", "matched_words")


def distinct_chunks(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of chunks with equal text in a data set the first stays."""
    return chunks.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "chunk").orderBy(*order))).filter("__n = 1").drop("__n")
