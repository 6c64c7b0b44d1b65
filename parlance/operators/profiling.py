"""Profiles and checks of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import share
from parlance.operators.standardize import running_number
from parlance.operators.top import top_rows


def type_label(variant: str) -> str:
    """SQL: NA, EmptyList, list, bool, int, float, str or dict of a VARIANT."""
    s = f"schema_of_variant({variant})"
    return f"""case when {s} = 'VOID' then 'NA' when {s} = 'ARRAY<VOID>' and variant_get({variant}, '$[0]', 'variant') is null then 'EmptyList' when {s} like 'ARRAY%' then 'list'
        when {s} = 'BOOLEAN' then 'bool' when {s} = 'BIGINT' then 'int' when {s} like 'DECIMAL%' or {s} in ('DOUBLE', 'FLOAT') then 'float' when {s} = 'STRING' then 'str' else 'dict' end"""


def json_types(df: DataFrame, json: str, keep: list[str] = ()) -> DataFrame:
    """One row per row and key with its type; what is no object is skipped."""
    parsed = df.select(*keep, F.expr(f"try_parse_json({json})").alias("v")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*keep, "key", F.expr(type_label("value")).alias("type"))


def type_profile(types: DataFrame, by: list[str] = ()) -> DataFrame:
    return types.groupBy(*by, "key", "type").agg(F.count("*").alias("n"))


def type_deviations(profile: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types other than expected; keys nobody expects; expected keys that never occur. ``expected`` (key, types) is small."""
    small = F.broadcast(expected)
    wrong = profile.join(small, "key").filter(~F.array_contains("types", F.col("type"))).drop("types")
    return wrong, profile.join(small, "key", "left_anti").select("key").distinct(), expected.join(profile, "key", "left_anti").select("key")


def mismatch_context(rows: DataFrame, cap: int = 10) -> DataFrame:
    """Platforms, actors and pairs of them behind each wrong (key, type), shortened to a report's length.

    Each list has its own small groups, so that no group gathers more names than there are.
    """
    out = rows.groupBy("key", "type").agg(F.count("*").alias("n"))
    pair = F.concat_ws("/", "platform", "actor")
    for name, c in (("platforms", F.col("platform")), ("actors", F.col("actor")), ("pairs", pair)):
        each = rows.select("key", "type", c.alias("x")).filter("x is not null").distinct()
        some = top_rows(each, ["key", "type"], [("x", False)], cap).groupBy("key", "type").agg(F.sort_array(F.collect_list("x")).alias(name))
        out = out.join(some, ["key", "type"], "left")
    return out


def examples(rows: DataFrame, by: list[str], order: str, n: int = 2) -> DataFrame:
    """The first ``n`` rows of each group."""
    return top_rows(rows, by, [(order, False)], n)


def key_sets(df: DataFrame, json: str) -> DataFrame:
    """Distinct sets of keys with their counts."""
    keys = F.array_sort(F.expr(f"json_object_keys({json})"))
    return df.select(F.array_join(keys, ",").alias("keys")).filter("keys is not null").groupBy("keys").agg(F.count("*").alias("n"))


def type_mixes(profile: DataFrame, allowed: list[set[str]] | None = None, by: list[str] = ()) -> DataFrame:
    """Keys with more than one type, unless the mix is allowed, inside each group (without ``by`` across all)."""
    allowed = allowed or [{"str", "NA"}, {"list", "NA"}, {"dict", "NA"}, {"int", "NA"}]
    mixes = profile.groupBy(*by, "key").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")).filter(F.col("types").contains(","))
    return mixes.filter(~F.col("types").isin(*[",".join(sorted(a)) for a in allowed]))


def row_hash(df: DataFrame, without: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in without])), 256)


def duplicate_rows(df: DataFrame, id_col: str, without: list[str] | None = None) -> DataFrame:
    """Rows equal but for the id: ``group_size``, the first id and the row's number in the order of ids.

    Sizes and first ids are aggregated before anything is dealt by hash; only rows that are not alone are then numbered, and a
    group of any size is spread over many tasks.
    """
    keyed = df.select(F.col(id_col), row_hash(df, [id_col, *(without or [])]).alias("hash"))
    repeated = keyed.groupBy("hash").agg(F.count("*").alias("group_size"), F.min(id_col).alias("first_id")).filter("group_size > 1")
    numbered = running_number(keyed.join(repeated, "hash"), "hash", [id_col])
    return numbered.select(id_col, "hash", "group_size", "first_id", F.col("__number").cast("int").alias("occurrence"))


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """Missing and repeated keys with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).withColumn("problem", F.when(F.col(key).isNull(), "missing").otherwise("duplicate"))


def sidecar(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: values, frequency in percent, a first example."""
    n = F.count("*")
    aggs = [F.struct(F.lit(c).alias("field"), F.count(c).alias("n"), F.when(n > 0, F.round(F.lit(100.0) * F.count(c) / n, 2)).alias("percent"), F.min(F.col(c).cast("string")).alias("example")) for c in fields]
    return df.agg(F.array(*aggs).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def dataset_card(df: DataFrame, scraped: str, published: str, platform: str = "platform") -> DataFrame:
    """One row for the data set: records, last day of scraping, first and last year of publication, and what kinds of platforms it holds."""
    kinds = F.array_join(F.sort_array(F.collect_set(platform)), "+")
    year = F.year(F.col(published))
    return df.agg(F.count("*").alias("records"), F.max(scraped).alias("last_scraped"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), kinds.alias("type_label"))


def field_types(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Type of each field and its first value that is not null, in the order of ``order``."""
    first = [F.struct(F.lit(c).alias("field"), F.lit(dict(df.dtypes)[c]).alias("type"), F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias("first_value")) for c in fields]
    return df.agg(F.array(*first).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def composition(df: DataFrame, by: str) -> DataFrame:
    """Rows and percent of each value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 2))


def sentinels(df: DataFrame, texts: list[str], file: str, order: list[str], rows: int = 5000, most: int = 13) -> DataFrame:
    """``value, chunks``: very short texts that occur in more than one chunk of ``rows`` rows of a file, candidates for words that stand for missing values.

    A row's texts are joined as they are, null as nothing. Rows of a file are numbered by ``order``; a large file is spread over many tasks.
    """
    joined = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts])
    numbered = running_number(df.select(joined.alias("value"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"), *order), "file", order)
    short = numbered.filter(F.length("value").between(1, most)).select("value", "file", F.floor((F.col("__number") - 1) / rows).alias("chunk")).distinct()
    return short.groupBy("value").agg(F.count("*").alias("chunks")).filter("chunks > 1")


def latest(df: DataFrame, by: list[str], date: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(date).alias("latest"))


def source_list(df: DataFrame, columns: list[str], platform: str = "platform") -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("UNKNOWN")).alias(c) if c == platform else F.col(c) for c in columns]).distinct().orderBy(*columns)


def first_seen_pairs(df: DataFrame, pair: list[str], order: str) -> DataFrame:
    """Pairs in the order in which they are first seen, with their rows."""
    return df.groupBy(*pair).agg(F.min(order).alias("first_row"), F.count("*").alias("n")).orderBy("first_row")


def contents(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """Texts with first and last date; rows without a key go."""
    return df.dropna(subset=by).groupBy(*by).agg(F.count("*").alias("n_texts"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def pseudonymised(df: DataFrame, identifiers: DataFrame, actor: str = "actor") -> DataFrame:
    """Flagged actors under their identifiers, those last; a flagged name that occurs twice is an error."""
    flagged = identifiers.filter(F.lower(F.trim(F.col("is_influencer").cast("string"))) == "true").select(F.col("actor").alias("__actor"), "identifier")
    if flagged.groupBy("__actor").count().filter("count > 1").limit(1).count():
        raise ValueError("a flagged actor has more than one identifier")
    out = df.join(F.broadcast(flagged), F.col(actor) == F.col("__actor"), "left").withColumn(actor, F.coalesce("identifier", actor)).withColumn("is_flagged", F.col("identifier").isNotNull())
    return out.drop("__actor", "identifier").orderBy("is_flagged", actor)


def mapping_check(data: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys of the data that the mapping lacks, keys of the mapping that the data lacks, keys mapped twice."""
    a, b = data.select(key).dropna().distinct(), mapping.select(key).dropna()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("not mapped")).union(b.distinct().join(a, key, "left_anti").withColumn("problem", F.lit("not in data"))).union(b.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate")))


def flagged_check(data: DataFrame, mapping: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Flagged keys that the data or the mapping lacks."""
    names = flagged.select(key).dropna().distinct()
    missing = lambda other, problem: names.join(other.select(key).dropna().distinct(), key, "left_anti").withColumn("problem", F.lit(problem))
    return missing(data, "flagged, not in data").union(missing(mapping, "flagged, not mapped"))


def in_days(df: DataFrame, date: str, start: str, end: str, source: str, dropped: str = "flashback") -> DataFrame:
    """Rows of an inclusive range of days without the dropped source."""
    from parlance.operators.timeseries import without_source

    return without_source(df.filter(F.to_date(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))), F.col(source), dropped)


def date_examples(df: DataFrame, by: list[str], raw: str, parsed: str, n: int = 5) -> DataFrame:
    """The first different raw dates of each group with what became of them."""
    pairs = df.select(*by, raw, parsed).distinct()
    return top_rows(pairs, by, [(raw, False), (parsed, False)], n, "rank")


def date_audit(df: DataFrame, raw: str, date: Column, start: str, end: str) -> DataFrame:
    """INSIDE, OUTSIDE or UNPARSED for every date."""
    out = df.withColumn("standardised", date)
    inside = F.col("standardised").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return out.withColumn("status", F.when(F.col("standardised").isNull(), "UNPARSED").when(inside, "INSIDE").otherwise("OUTSIDE"))


def nested_audit(audit: DataFrame, levels: list[str], fields: list[str]) -> DataFrame:
    """The audit as one document per first level, sorted below."""
    out = audit.groupBy(*levels).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.sort_array(F.collect_list(F.struct(levels[k], "rows"))).alias("rows"))
    return out


def share_table(matched: DataFrame, corpus: DataFrame, country: str, theme: str) -> DataFrame:
    """Matched texts by country and theme, as shares of the country and of the corpus, with a row for all countries."""
    sizes = corpus.groupBy(country).agg(F.count("*").alias("n_country")).withColumn("n_all", F.sum("n_country").over(Window.partitionBy()))
    counts = matched.groupBy(country, theme).agg(F.count("*").alias("n"))
    rows = counts.join(F.broadcast(sizes), country, "left")
    each = rows.select(country, theme, "n", share(F.col("n"), F.col("n_all")).alias("of_corpus"), share(F.col("n"), F.col("n_country")).alias("of_country"))
    total = rows.groupBy(theme).agg(F.sum("n").alias("n"), F.max("n_all").alias("n_all"))
    return each.unionByName(total.select(F.lit("ALL").alias(country), theme, "n", share(F.col("n"), F.col("n_all")).alias("of_corpus"), share(F.col("n"), F.col("n_all")).alias("of_country")))


def totals(df: DataFrame, by: str, inside: Column) -> DataFrame:
    """Rows before and after a filter, per group and for all (null group)."""
    return df.rollup(by).agg(F.count("*").alias("n_before"), F.count_if(F.coalesce(inside, F.lit(False))).alias("n_after"))
