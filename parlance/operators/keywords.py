"""Sentences, keyword matches and the index of matched texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import patterns
from parlance.functions.patterns import PatternIndex, sql_quote, wildcard_regex


def sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per fragment between line breaks and dots, numbered from 1. Empty fragments stay; blank texts go."""
    parts = df.filter(F.length(F.trim(F.col(text_col))) > 0)
    return parts.select(*[c for c in df.columns if c != text_col], F.posexplode(F.split(F.col(text_col), r"\n+|\.", -1)).alias("pos", "sentence")).withColumn("sentence_id", F.col("pos") + 1).drop("pos")


def hits(text: str, keyword: str, edges: str = "sentence") -> str:
    """SQL for all matches of one keyword."""
    return f"regexp_extract_all({text}, {sql_quote(wildcard_regex(keyword, edges))}, 0)"


def usable(df: DataFrame, date_col: str, text_col: str = "sentence") -> DataFrame:
    """Fragments with a date whose text is not the word for a missing value."""
    return df.filter(F.col(date_col).isNotNull() & (F.col(text_col) != "nan"))


def _found(keywords: list[str], false_positives: list[str], text_col: str) -> str:
    """SQL for the keywords that are hit, with their hits. A few have one alternation as a guard; of more those of one word are looked up by the words of the text, of the others only those that share a piece with it are run."""
    empty = "cast(array() as array<struct<k:string,h:array<string>>>)"
    if not keywords:
        return empty
    fp = ", ".join(sql_quote(w.strip().lower()) for w in false_positives if w.strip())
    stays = f"lower(trim(x)) not in ({fp})" if fp else "true"
    if len(keywords) <= patterns.FEW:
        structs = ", ".join(f"named_struct('k', {sql_quote(k)}, 'h', filter({hits(text_col, k)}, x -> {stays}))" for k in keywords)
        guard = sql_quote("|".join(f"(?:{wildcard_regex(k)})" for k in keywords))
        return f"case when {text_col} rlike {guard} then filter(array({structs}), s -> size(s.h) > 0) else {empty} end"
    whole = [k for k in keywords if patterns.plain(k)]
    others = [k for k in keywords if not patterns.plain(k)]
    runs = [f"transform({patterns.word_hits(whole, text_col, FOLDED)}, s -> named_struct('k', s.k, 'h', filter(s.h, x -> {stays})))"] if whole else []
    if others:
        runs.append(f"transform({PatternIndex(others).candidates(FOLDED)}, p -> named_struct('k', p.k, 'h', filter(regexp_extract_all({text_col}, p.p, 0), x -> {stays})))")
    run = f"concat({', '.join(runs)})"
    return f"coalesce(filter({run}, s -> size(s.h) > 0), {empty})"


#: Column of the text in the case that patterns compare by, while an index needs it.
FOLDED = "__folded"


def _named(df: DataFrame, found: str, text_col: str) -> DataFrame:
    ordered = lambda c: F.transform(F.array_sort(F.transform(c, lambda w: F.struct(F.lower(w).alias("l"), w.alias("w")))), lambda s: s["w"])
    out = df.withColumn(FOLDED, F.expr(patterns.folded(text_col))) if FOLDED in found else df
    out = out.withColumn("__found", F.expr(found))
    names = ordered(F.array_distinct(F.expr("transform(__found, s -> s.k)")))
    return out.select(*df.columns, F.when(F.size("__found") > 0, names).alias("matched_keywords"), ordered(F.array_distinct(F.flatten(F.expr("transform(__found, s -> s.h)")))).alias("matched_words"), (F.size("__found") > 0).cast("int").alias("matched"))


def match(df: DataFrame, keywords: list[str], false_positives: list[str] = (), text_col: str = "sentence") -> DataFrame:
    """``matched_keywords`` (null if none), ``matched_words`` and ``matched`` for one dictionary.

    A hit that is a false positive does not count. A few keywords are guarded by a cheap alternation of all their patterns; a
    large dictionary goes along as an index of pieces, so that the time of a sentence hardly grows with it.
    """
    return _named(df, _found(keywords, false_positives, text_col), text_col)


def match_routed(df: DataFrame, dictionaries: dict[str, tuple[list[str], list[str]]], route: Column, text_col: str = "sentence") -> DataFrame:
    """Each row is matched by the dictionary that ``route`` names, in one pass; rows of unknown routes match nothing."""
    cases = " ".join(f"when {sql_quote(name)} then {_found(keywords, wrong, text_col)}" for name, (keywords, wrong) in dictionaries.items())
    return _named(df.withColumn("__route", route), f"case __route {cases} else {_found([], [], text_col)} end", text_col).drop("__route")


def index(matched: DataFrame, id_col: str, first: list[str] = (), count: str | None = None) -> DataFrame:
    """One row per text with a match: first non-null of ``first`` columns, keywords and words in order of discovery, the matched sentences as ``count``."""
    rows = matched.filter("matched = 1")
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("sentence_id", c)))
    union = lambda c: F.array_distinct(F.flatten(F.transform(ordered(c), lambda s: s[c]))).alias(c)
    return rows.groupBy(id_col).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("sentence_id"))).alias(c) for c in first], union("matched_keywords"), union("matched_words"), *([F.count("*").alias(count)] if count else []))


def distinct_words(indexed: DataFrame, by: list[str]) -> DataFrame:
    """Distinct matched words in lower case, with an empty column for review."""
    return indexed.select(*by, F.explode("matched_words").alias("w")).select(*by, F.lower("w").alias("word")).distinct().withColumn("review", F.lit(""))


def masked(text: Column | str, keywords: list[str], theme: str) -> Column:
    """Every hit replaced by ``[THEME]``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, F.lit("|".join(f"(?:{wildcard_regex(k, 'word')})" for k in keywords)), F.lit(f"[{theme.upper()}]"))


def without_urls(text: Column) -> Column:
    """Heads of URLs and picture links removed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)pic\.twitter\.com/\S*", ""), r"(?i)(?:https?://)?(?:www\.)", "")


def actor_masked(text: str, actor: str) -> Column:
    """The actor's name, in any case, replaced by a space; without a name the text as it is."""
    return F.expr(f"case when coalesce(trim({actor}), '') = '' then {text} else regexp_replace({text}, concat('(?iU)\\\\Q', trim({actor}), '\\\\E'), ' ') end")


def keyword_pairs(words: Column, pairs: list[tuple[str, ...]]) -> Column:
    """Words of incomplete pairs (of two words or more) go; those that a complete pair has too stand at the end, in the order of the pairs.

    All pairs are looked at before any word goes, so a word of two pairs stays if one of them is complete.
    """
    none = F.expr("cast(array() as array<string>)")
    listed = lambda pair: F.array(*map(F.lit, pair))
    whole = lambda pair: F.size(F.array_except(listed(pair), words)) == 0
    of = lambda complete: F.concat(none, *[F.when(whole(p) == F.lit(complete), listed(p)).otherwise(none) for p in pairs])
    left = F.array_except(words, of(False))
    return F.concat(left, F.array_except(of(True), left))


def post_blocks(text: Column) -> Column:
    """What stands behind ``Post_text`` and ``Comment_text`` up to the next ``---``, line by line; the whole text if there is nothing."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?:Post_text|Comment_text)(.*?)(?=---)"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(text)


def annotation_match(df: DataFrame, keywords: list[str], text_col: str = "text") -> DataFrame:
    """Keywords found between spaces, sorted; rows without any go if there are keywords at all."""
    if not keywords:
        return df.withColumn("matched_keywords", F.expr("cast(array() as array<string>)"))
    if len(keywords) <= patterns.FEW:
        structs = ", ".join(f"named_struct('l', lower({sql_quote(k)}), 'k', {sql_quote(k)}, 'hit', {text_col} rlike {sql_quote(wildcard_regex(k, 'space'))})" for k in keywords)
        rows, found = df, f"filter(array({structs}), s -> s.hit)"
    else:
        rows = df.withColumn(FOLDED, F.expr(patterns.folded(text_col)))
        index = PatternIndex(keywords, "space")
        found = f"transform(filter({index.candidates(FOLDED)}, p -> {text_col} rlike p.p), p -> named_struct('l', lower(p.k), 'k', p.k))"
    return rows.withColumn("matched_keywords", F.expr(f"transform(array_sort({found}), s -> s.k)")).filter(F.size("matched_keywords") > 0).drop(FOLDED)


def with_header(link: Column, actor: Column, keywords: Column | None, date: Column, text: Column) -> Column:
    """Text under a block that names link, actor, keywords and date."""
    rows = [F.concat(F.lit("Link: "), F.coalesce(link, F.lit(""))), F.concat(F.lit("Actor: "), F.coalesce(actor, F.lit("")))]
    if keywords is not None:
        rows.append(F.concat(F.lit("Matched keywords: "), F.array_join(keywords, ", ")))
    rows.append(F.concat(F.lit("Publication date: "), F.coalesce(date.cast("string"), F.lit(""))))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n\n"), F.coalesce(text, F.lit("")))


def language_shares(df: DataFrame, by: list[str], lang: str = "lang", text: str = "text", target: str = "en", least_chars: int = 50, least_share: float = 0.5) -> DataFrame:
    """Share of one language among the texts and characters of each group, groups of ``least_share`` and more."""
    n, rows = F.length(text), df.filter(F.length(text) >= least_chars)
    hit = F.coalesce(F.col(lang) == target, F.lit(False))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_texts"), F.count_if(hit).alias("n_hit"), F.sum(n).alias("chars"), F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("chars_hit"), F.round(F.avg(F.when(hit, n)), 1).alias("mean_hit"), F.round(F.avg(F.when(~hit, n)), 1).alias("mean_other")
    )
    out = out.withColumn("text_share", F.round(F.col("n_hit") / F.col("n_texts"), 3)).withColumn("char_share", F.round(F.col("chars_hit") / F.col("chars"), 3))
    return out.filter(F.col("n_hit") / F.col("n_texts") >= least_share).orderBy(F.desc("text_share"), F.desc("char_share"), F.desc("n_texts"), *by)


def language_profile(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text", prefix: int = 500) -> DataFrame:
    """Language whose stop-words occur most often in the first characters of the text (ties by name); the lexicon is small and fixed."""
    tokens = df.select(id_col, F.explode(F.expr(f"regexp_extract_all(lower(substring({text_col}, 1, {prefix})), '(?U)[\\\\p{{L}}]+', 0)")).alias("word"))
    counts = tokens.join(F.broadcast(lexicon), "word").groupBy(id_col, "lang").count()
    return counts.groupBy(id_col).agg(F.max_by("lang", F.struct(F.col("count"), F.col("lang"))).alias("profile_lang"))
