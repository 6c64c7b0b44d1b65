"""Term and bigram statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import inside_days
from parlance.operators.top import top_rows

TOKEN = r"(?U)[\\p{L}\\p{M}\\p{N}\'-]+"


def tokens(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``pos`` and ``term`` (lower case, with a letter in it)."""
    each = df.select(*keep, F.posexplode(F.expr(f"regexp_extract_all(lower({text_col}), '{TOKEN}', 0)")).alias("pos", "term"))
    return each.filter(F.col("term").rlike(r"(?U)\p{L}"))


def term_counts(tokenised: DataFrame, by: list[str], stop_words: list[str] = (), excluded: list[str] = ()) -> DataFrame:
    """Counts of content terms; terms that match an excluded pattern are left out."""
    rows = tokenised.filter(~F.col("term").isin(*stop_words)) if stop_words else tokenised
    for pattern in excluded:
        rows = rows.filter(~F.col("term").rlike(pattern))
    return rows.groupBy(*by, "term").agg(F.count("*").alias("n"))


def excluded_counts(tokenised: DataFrame, by: list[str], excluded: list[str]) -> DataFrame:
    """Counts of the terms that excluded patterns match."""
    return tokenised.filter(F.col("term").rlike("|".join(f"(?:{p})" for p in excluded))).groupBy(*by, "term").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent of each group, ties by term."""
    return top_rows(counts, by, [("n", True), ("term", False)], n, "rank")


def top_by_language(counts: DataFrame, by: list[str], lang: str, n: int) -> DataFrame:
    """Top terms per language, added up over languages, and the top of the sums."""
    return top_terms(top_terms(counts, [*by, lang], n).groupBy(*by, "term").agg(F.sum("n").alias("n")), by, n)


def repeated_terms(counts: DataFrame) -> DataFrame:
    return counts.filter("n > 1").orderBy("n", "term")


def bigrams(tokenised: DataFrame, sentence: list[str], by: list[str], stop_words: list[str] = ()) -> DataFrame:
    """Counts of neighbouring content terms inside a sentence."""
    rows = tokenised.filter(~F.col("term").isin(*stop_words)) if stop_words else tokenised
    pairs = rows.withColumn("next", F.lead("term").over(Window.partitionBy(*sentence).orderBy("pos"))).filter("next is not null")
    return pairs.groupBy(*by, F.concat_ws(" ", "term", "next").alias("bigram")).agg(F.count("*").alias("n"))


def pieces(df: DataFrame, id_col: str, text_col: str = "text", most: int = 8000, least: int = 200) -> DataFrame:
    """``piece_id, piece``: a trimmed text in pieces of at most ``most`` characters, each trimmed, blank ones left out.

    A piece ends at its last line break, or at its last space if it has no line break at all; where that is not more than
    ``least`` characters in, and where there is none, it is cut hard.
    """
    clean = lambda c: f"regexp_replace({c}, '(?U)^\\\\s+|\\\\s+$', '')"
    window = f"substring(__whole, a.at + 1, {most})"
    back = lambda mark: f"locate({mark}, reverse({window}))"
    place = f"case when {back(repr(chr(10)))} > 0 then {most} - {back(repr(chr(10)))} else {most} - {back(repr(' '))} end"
    found = f"contains({window}, ' ') or contains({window}, {chr(39)}\\n{chr(39)})"
    step = f"case when a.at + {most} >= n then n when ({found}) and {place} > {least} then a.at + {place} else a.at + {most} end"
    ends = f"aggregate(sequence(1, n div {least + 1} + 1), named_struct('at', 0, 'ends', cast(array() as array<int>)), (a, k) -> case when a.at >= n then a else named_struct('at', {step}, 'ends', concat(a.ends, array({step}))) end, a -> a.ends)"
    rows = df.select(id_col, F.expr(clean(f"coalesce({text_col}, '')")).alias("__whole")).withColumn("n", F.length("__whole")).withColumn("ends", F.expr(ends))
    cut = f"filter(transform(ends, (e, i) -> {clean('substring(__whole, if(i = 0, 0, get(ends, i - 1)) + 1, e - if(i = 0, 0, get(ends, i - 1)))')}), x -> x <> '')"
    return rows.select(id_col, F.posexplode(F.expr(cut)).alias("k", "piece")).select(id_col, (F.col("k") + 1).cast("long").alias("piece_id"), "piece")


def peak_texts(indexed: DataFrame, texts: DataFrame, peaks: DataFrame, id_col: str, date: str, lang: str, english: str = "en") -> DataFrame:
    """Texts of each peak with ``route``: English or the country's own set; blank texts go."""
    inside = inside_days(indexed.select(id_col, date), date, peaks.select("peak_id", "from_date", "to_date")).select("peak_id", id_col)
    met = inside.join(texts.select(id_col, lang, "text"), id_col).filter(F.length(F.trim("text")) > 0)
    return met.select("peak_id", id_col, F.when(F.col(lang) == english, "english").otherwise("default").alias("route"), "text")
