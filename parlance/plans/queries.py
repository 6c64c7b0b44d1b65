"""Registered queries of the analytics operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import annotation, chunks, keywords, peaks, profiling, reduce, sampling, standardize, terms, timeseries, vectors

Query = Callable[[SparkSession, str], DataFrame]

#: The neutral dictionary of the queries: stems that occur in the tables' invented text.
TERMS, WRONG = ["thing*", "*tion", "er"], ["ration", "Thingth"]
FOREIGN = ["nicht", "ein*"]
STOP_WORDS = ["the", "of", "and", "in", "to", "der", "die", "und", "le", "la", "de", "que"]
START, END = "1995-01-01", "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus texts: the source is the actor, days follow from the id."""
    return table(spark, sf_dir, "documents").withColumn("day", F.expr("date_add(date'2015-01-01', cast(doc_id % 3865 as int))"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.sentences(docs(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.match(split(spark, sf_dir), TERMS, WRONG)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders per market segment, dense, with each segment's total."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("actor")), F.col("o_custkey") == F.col("c_custkey"))
    series = timeseries.period_counts(orders.select("actor", F.to_date("o_orderdate").alias("day")), "day", ["actor"], START, END)
    return series.withColumn("total_texts", F.sum("n").over(Window.partitionBy("actor")))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months above the running baseline, by a rule that SQL can follow."""
    features = timeseries.rolling_features(timeseries.engagement(activity(spark, sf_dir)), ["actor"])
    return features.filter(F.coalesce(F.col("n") > F.col("baseline"), F.lit(False)))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.collapsed(flagged(spark, sf_dir), activity(spark, sf_dir))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.ranked(peaks.without_dominated(collapsed(spark, sf_dir)))


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as strings, so that engines agree on them."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})


def listed(df: DataFrame) -> DataFrame:
    """Lists of strings joined by commas."""
    return df.withColumns({c: F.array_join(c, ",") for c, kind in df.dtypes if kind == "array<string>"})


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tokens(docs(spark, sf_dir), ["doc_id", "lang", "source"])


def prefix_columns(df: DataFrame) -> DataFrame:
    """First two dimensions as coordinates."""
    return df.select("vec_id", F.col("label").cast("string").alias("actor"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle.replace("{DOCS}", DOCS).replace("{SENT}", SENT).replace("{MATCH}", MATCH).replace("{ACT}", ACT).replace("{COLL}", COLL)
        return f

    return register


W = "'[\\p{L}\\p{N}_]+'"
DOCS = "docs as (select *, date '2015-01-01' + cast(doc_id % 3865 as int) as day from documents)"
SENT = """sent as (select doc_id, lang, source, day, unnest(s) as sentence, unnest(range(1, len(s) + 1)) as sentence_id
    from (select *, string_split_regex(text, '\\n+|\\.') as s from docs where length(trim(text)) > 0))"""
MATCH = f"""words as (select *, regexp_extract_all(sentence, {W}) as w from sent),
    hits as (select * exclude (w), list_filter(w, lambda x: lower(x) like 'thing%' and lower(x) <> 'thingth') as h1, list_filter(w, lambda x: lower(x) like '%tion' and lower(x) <> 'ration') as h2, list_filter(w, lambda x: lower(x) = 'er') as h3 from words),
    matched as (select *, list_concat(case when len(h2) > 0 then ['*tion'] else [] end, case when len(h3) > 0 then ['er'] else [] end, case when len(h1) > 0 then ['thing*'] else [] end) as ks,
      array_to_string(list_transform(list_sort(list_transform(list_distinct(list_concat(h1, h2, h3)), lambda x: {{'l': lower(x), 'w': x}})), lambda z: z.w), ',') as ws from hits)"""
ACT = f"""cal as (select cast(last_day(d) as date) as date from generate_series(timestamp '{START}', timestamp '{END}', interval 1 month) t(d)),
    act as (select c_mktsegment as actor, last_day(o_orderdate) as date, count(*) as k from orders join customer on o_custkey = c_custkey group by all),
    dense as (select a.actor, cal.date, coalesce(act.k, 0) as n from (select distinct actor from act) a cross join cal left join act on act.actor = a.actor and act.date = cal.date),
    tot as (select *, cast(sum(n) over (partition by actor) as bigint) as total_texts from dense),
    eng as (select *, case when total_texts > 0 then n / total_texts else 0.0 end as share from tot),
    wei as (select *, share * total_texts / (total_texts + 10.0) as weight from eng)"""
ROLL = "rolled as (select *, case when count(n) over w >= 2 then avg(n) over w end as raw_mean, coalesce(case when count(n) over w >= 2 then stddev_samp(n) over w end, 0.0) as rolling_std from wei window w as (partition by actor order by date rows between 9 preceding and current row)), based as (select *, lag(raw_mean) over (partition by actor order by date) as baseline from rolled)"
COLL = f"""{{ACT}}, {ROLL}, fl as (select * from based where n > baseline),
    coll as (select f.date, cast(sum(f.n) as bigint) as count, sum(weight) as weight, array_to_string(list_sort(list(distinct actor)), ',') as actors, count(distinct actor) as actors_engaged, any_value(t.n_texts_total) as n_texts_total,
      cast(date_trunc('month', f.date) as date) as from_date, last_day(f.date) as to_date
      from fl f left join (select date, cast(sum(n) as bigint) as n_texts_total from tot group by date) t on t.date = f.date group by f.date)""".replace("{ACT}", ACT)
UNDOM = "und as (select * from (select *, lag(to_date) over o as pt, lag(weight) over o as pw, lead(from_date) over o as nf, lead(weight) over o as nw from coll window o as (order by from_date)) where not (coalesce(pt + 1 = from_date and pw >= weight, false) or coalesce(to_date + 1 = nf and nw >= weight, false)))"
TOP = f"with {{COLL}}, {UNDOM}, t15 as (select * from und where n_texts_total > 5 order by actors_engaged desc, count desc, from_date limit 15), ranked as (select *, row_number() over (order by from_date) as peak_id from t15)"


@query("with {DOCS}, {SENT} select doc_id, cast(sentence_id as bigint) as sentence_id, sentence from sent")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "sentence")


@query("with {DOCS}, {SENT}, {MATCH} select doc_id, cast(sentence_id as bigint) as sentence_id, case when len(ks) > 0 then array_to_string(ks, ',') end as matched_keywords, ws as matched_words, cast(len(ks) > 0 as int) as matched from matched")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(matched(spark, sf_dir).select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "matched_keywords", "matched_words", "matched"))


@query(
    """with {DOCS}, {SENT}, {MATCH}, k as (select doc_id, kw, min(sentence_id * 10 + i) as f from (select doc_id, sentence_id, unnest(ks) as kw, unnest(range(len(ks))) as i from matched where len(ks) > 0) group by all)
    select doc_id, any_value(source) as source, any_value(kws) as matched_keywords, count(*) as n_sentences from matched join (select doc_id, string_agg(kw, ',' order by f) as kws from k group by doc_id) using (doc_id) where len(ks) > 0 group by doc_id"""
)
def theme_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(keywords.index(matched(spark, sf_dir), "doc_id", ["source"], "n_sentences").drop("matched_words"))


@query(
    f"""with {{DOCS}}, {{SENT}}, words as (select *, regexp_extract_all(sentence, {W}) as w from sent)
    select doc_id, cast(sentence_id as bigint) as sentence_id, cast(case when lang = 'en' then len(list_filter(w, lambda x: lower(x) like 'thing%' and lower(x) <> 'thingth' or lower(x) like '%tion' and lower(x) <> 'ration' or lower(x) = 'er')) > 0
      when lang = 'de' then len(list_filter(w, lambda x: lower(x) = 'nicht' or lower(x) like 'ein%')) > 0 else false end as int) as matched from words"""
)
def routed_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords.match_routed(split(spark, sf_dir), {"en": (TERMS, WRONG), "de": (FOREIGN, [])}, F.col("lang"))
    return rows.select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "matched")


@query("with {DOCS}, {SENT}, {MATCH} select distinct lang, lower(unnest(list_concat(h1, h2, h3))) as word, '' as review from matched")
def distinct_matched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.distinct_words(keywords.index(matched(spark, sf_dir), "doc_id", ["lang"]), ["lang"])


@query(
    """select source, n_texts, n_hit, chars, chars_hit, round(mean_hit, 1) as mean_hit, round(mean_other, 1) as mean_other, round(n_hit / n_texts, 3) as text_share, round(chars_hit / chars, 3) as char_share
    from (select source, count(*) as n_texts, count(*) filter (lang = 'en') as n_hit, cast(sum(length(text)) as bigint) as chars, cast(coalesce(sum(length(text)) filter (lang = 'en'), 0) as bigint) as chars_hit,
      avg(length(text)) filter (lang = 'en') as mean_hit, avg(length(text)) filter (lang <> 'en' or lang is null) as mean_other from documents where length(text) >= 50 group by source) where n_hit / n_texts >= 0.5"""
)
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.language_shares(docs(spark, sf_dir), ["source"])


LEXICON = [("the", "en"), ("of", "en"), ("and", "en"), ("der", "de"), ("die", "de"), ("und", "de"), ("le", "fr"), ("la", "fr"), ("que", "fr"), ("el", "es"), ("los", "es"), ("para", "es")]


@query(
    "with lex(word, lang) as (values " + ", ".join(f"('{w}', '{x}')" for w, x in LEXICON) + "), tok as (select doc_id, unnest(regexp_extract_all(lower(substring(text, 1, 500)), '[\\p{L}]+')) as word from documents), "
    "c as (select doc_id, lex.lang, count(*) as k from tok join lex using (word) group by all) select doc_id, arg_max(lang, {'k': k, 'l': lang}) as profile_lang from c group by doc_id"
)
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.language_profile(docs(spark, sf_dir), spark.createDataFrame(LEXICON, "word string, lang string"), "doc_id")


@query("select doc_id, regexp_replace(text, '(?i)(\\A|[^\\p{L}\\p{N}_])thing[\\p{L}\\p{N}_]*', '\\1[THEME]', 'g') as masked from documents")
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", keywords.masked("text", ["thing*"], "theme").alias("masked"))


@query("select page_id, regexp_replace(regexp_replace(url, '(?i)pic\\.twitter\\.com/\\S*', '', 'g'), '(?i)(?:https?://)?(?:www\\.)', '', 'g') as stripped from pages")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", keywords.without_urls(F.col("url")).alias("stripped"))


@query("with {DOCS} select doc_id, '---\nLink: doc/' || doc_id || '\nActor: ' || coalesce(source, '') || '\nPublication date: ' || strftime(day, '%Y-%m-%d') || '\n---\n\n' || coalesce(text, '') as text from docs")
def header_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", keywords.with_header(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("source"), None, F.col("day"), F.col("text")).alias("text"))


@query("with {ACT} select actor, strftime(date, '%Y-%m-%d') as date, n from dense")
def monthly_counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(activity(spark, sf_dir).select("actor", "date", "n"))


@query(
    """with cal as (select cast(d as date) + 6 as date from generate_series(timestamp '2023-12-25', timestamp '2024-02-28', interval 7 day) t(d)), c as (select event_type, cast(date_trunc('week', ts) as date) + 6 as date, count(*) as k from events group by all)
    select e.event_type, strftime(cal.date, '%Y-%m-%d') as date, coalesce(c.k, 0) as n from (select distinct event_type from events) e cross join cal left join c on c.event_type = e.event_type and c.date = cal.date"""
)
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    return text_dates(timeseries.period_counts(rows, "day", ["event_type"], "2023-12-31", "2024-02-28", "W"))


@query(
    """with c as (select date_trunc('month', o_orderdate) as lo, count(*) as k from orders group by all), cal as (select unnest(generate_series((select min(lo) from c), (select max(lo) from c), interval 1 month)) as lo)
    select strftime(last_day(cal.lo), '%Y-%m-%d') as date, coalesce(k, 0) as n from cal left join c using (lo)"""
)
def own_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(timeseries.own_span_counts(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day"))


@query("with c as (select o_orderpriority as actor, count(*) as w from orders group by all) select strftime(last_day(o_orderdate), '%Y-%m-%d') as date, count(*) as n, round(sum(1.0 / w), 6) as weighted from orders join c on actor = o_orderpriority group by all")
def weighted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    rows = orders.join(orders.groupBy("o_orderpriority").agg(F.count("*").alias("w")), "o_orderpriority")
    out = timeseries.period_counts(rows, "day", [], START, END, weight="w").filter("n > 0")
    return text_dates(out.withColumn("weighted", F.round("weighted", 6)))


@query(
    f"""with {{ACT}}, {ROLL} select actor, strftime(date, '%Y-%m-%d') as date, n, round(coalesce(first_value(raw_mean ignore nulls) over (partition by actor order by date rows between current row and unbounded following), last_value(raw_mean ignore nulls) over (partition by actor order by date rows between unbounded preceding and current row)), 6) as rolling_mean,
      round(rolling_std, 6) as rolling_std, round(baseline, 6) as baseline, cast(dayofyear(date) as int) as day_of_year from based"""
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.rolling_features(activity(spark, sf_dir), ["actor"]).select("actor", "date", "n", *[F.round(c, 6).alias(c) for c in ("rolling_mean", "rolling_std", "baseline")], "day_of_year")
    return text_dates(out)


@query("with {COLL} select strftime(date, '%Y-%m-%d') as date, count, round(weight, 6) as weight, actors, n_texts_total, cast(actors_engaged as int) as actors_engaged, strftime(from_date, '%Y-%m-%d') as from_date, strftime(to_date, '%Y-%m-%d') as to_date from coll")
def engagement_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(listed(collapsed(spark, sf_dir).withColumn("weight", F.round("weight", 6))))


@query(f"with {{COLL}}, {UNDOM} select strftime(from_date, '%Y-%m-%d') as from_date, count from und")
def adjacent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(peaks.without_dominated(collapsed(spark, sf_dir)).select("from_date", "count"))


@query(TOP + " select cast(peak_id as int) as peak_id, strftime(from_date, '%Y-%m-%d') as from_date, strftime(to_date, '%Y-%m-%d') as to_date, count, n_texts_total, actors from ranked")
def top_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(listed(top(spark, sf_dir).select("peak_id", "from_date", "to_date", "count", "n_texts_total", "actors")))


@query(TOP + " select d.actor, strftime(d.date, '%Y-%m-%d') as date, d.n, cast(r.peak_id as int) as peak_id, r.peak_id is not null as is_peak from dense d left join ranked r on r.date = d.date")
def peak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(peaks.attached(activity(spark, sf_dir).select("actor", "date", "n"), top(spark, sf_dir)))


@query(TOP + " select cast(peak_id as int) as peak_id, cast(actors_engaged as int) as n_actors_engaged, replace(actors, ',', ', ') as actors_names, count as n_texts_actors, 'open' as status from ranked")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.review_sheet(top(spark, sf_dir)).select("peak_id", "n_actors_engaged", "actors_names", "n_texts_actors", "status")


@query(TOP + ", {DOCS} select cast(r.peak_id as int) as peak_id, count(*) as n_texts from docs d join ranked r on d.day - interval 20 year between r.from_date and r.to_date group by all".replace("{DOCS}", "docs as (select *, date '2015-01-01' + cast(doc_id % 3865 as int) as day from documents)"))
def peak_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peak_text_counts(docs(spark, sf_dir).withColumn("day", F.add_months("day", -240)), top(spark, sf_dir), "day")


@query(
    """with s as (select event_type as actor, cast(ts as date) as date, count(*) as n from events group by all), v as (select *, n / sum(n) over (partition by actor) as v, row_number() over (partition by actor order by date) as i from s),
    c as (select *, coalesce(cast(n <> lag(n) over (partition by actor order by date) as int), 1) as new from v), f as (select *, sum(new) over (partition by actor order by date) as run from c), m as (select actor, run, any_value(v) as v, (min(i) + max(i)) // 2 as i from f group by actor, run),
    t as (select * from (select *, lag(v) over w as a, lead(v) over w as b from m window w as (partition by actor order by run)) where a < v and b < v),
    l as (select t.actor, t.i, t.v, (select max(x.i) from v x where x.actor = t.actor and x.i < t.i and x.v > t.v) as li, (select min(x.i) from v x where x.actor = t.actor and x.i > t.i and x.v > t.v) as ri from t),
    p as (select l.actor, v.date, l.v, l.v - greatest((select min(x.v) from v x where x.actor = l.actor and x.i <= l.i and x.i > coalesce(l.li, 0)), (select min(x.v) from v x where x.actor = l.actor and x.i >= l.i and x.i < coalesce(l.ri, 1000000))) as prominence from l join v on v.actor = l.actor and v.i = l.i)
    select actor, strftime(date, '%Y-%m-%d') as date, round(v, 6) as share, round(prominence, 6) as prominence from p where prominence >= 0.005"""
)
def prominence_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("actor"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    out = peaks.prominent(timeseries.shares(daily, ["actor"]), ["actor"])
    return text_dates(out.select("actor", "date", F.round("share", 6).alias("share"), F.round("prominence", 6).alias("prominence")))


def _forest(trees: int = 200, seed: int = 42, levels: int = 8) -> str:
    """CTEs of the isolation forest over ``feats`` (actor, date, n, baseline, x), a level after another; ``scored`` is the last."""
    hashed = lambda what: f"list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substring(md5('{seed}|' || actor || '|' || tree || '|' || node || '|{what}'), i, 1)) - 1) * 16 ** (8 - i))) / 4294967296.0"
    c = "case when {0} > 2 then 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / cast({0} as double) when {0} = 2 then 1.0 else 0.0 end"
    out = [
        f"t as (select actor, date, x, tree, least(256, count(*) over (partition by actor, tree)) as size, row_number() over (partition by actor, tree order by md5('{seed}|' || actor || '|' || tree || '|' || strftime(date, '%Y-%m-%d')), date) as place from feats, unnest(range({trees})) u(tree))",
        "l0 as (select actor, date, x, tree, size, place <= size as chosen, cast(ceil(log2(greatest(size, 2))) as int) as levels, cast(1 as bigint) as node, cast(null as double) as depth from t)",
    ]
    for k in range(levels + 1):
        low, high = (", ".join(f"{f}(x[{i}]) filter (chosen) over w" for i in range(1, 5)) for f in ("min", "max"))
        out += [
            f"a{k} as (select *, count(*) filter (chosen) over w as m, [{low}] as low, [{high}] as high from l{k} window w as (partition by actor, tree, node))",
            f"b{k} as (select *, list_filter([1, 2, 3, 4], lambda i: high[i] > low[i]) as wide from a{k})",
            f"c{k} as (select * exclude (depth), coalesce(depth, case when m <= 1 or levels <= {k} or len(wide) = 0 then {k} + {c.format('m')} end) as depth, wide[cast(floor({hashed('feature')} * len(wide)) as int) + 1] as f, {hashed('cut')} as u from b{k})",
            f"l{k + 1} as (select actor, date, x, tree, size, chosen, levels, case when depth is null then 2 * node + cast(x[f] >= low[f] + u * (high[f] - low[f]) as int) else node end as node, depth from c{k})",
        ]
    out.append(f"scores as (select actor, date, round(pow(2.0, -(avg(depth) / greatest({c.format('max(size)')}, 1e-9))), 9) as score from l{levels + 1} group by actor, date)")
    out.append("ranked as (select f.*, score, row_number() over (partition by actor order by score, date) - 1 as r, (count(*) over (partition by actor) - 1) * (1 - 0.3) as spot from feats f join scores using (actor, date))")
    out.append("lined as (select *, max(score) filter (r = floor(spot)) over w as below, max(score) filter (r = ceil(spot)) over w as above from ranked window w as (partition by actor))")
    out.append("scored as (select actor, date, n, baseline, score, round(score, 9) > round(below + (above - below) * (spot - floor(spot)), 9) and coalesce(n > baseline, false) as is_anomaly from lined)")
    return ", ".join(out)


FILLED = "coalesce(first_value(raw_mean ignore nulls) over (partition by actor order by date rows between current row and unbounded following), last_value(raw_mean ignore nulls) over (partition by actor order by date rows between unbounded preceding and current row))"
FOREST = f"{{ACT}}, {ROLL}, filled as (select *, {FILLED} as filled from based), feats as (select actor, date, n, baseline, [cast(n as double), coalesce(round(filled, 9), 0), round(rolling_std, 9), cast(dayofyear(date) as double)] as x from filled), {_forest()}"


@query(f"with {FOREST} select actor, strftime(date, '%Y-%m-%d') as date, n, round(score, 6) as score, is_anomaly from scored")
def isolation_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(_scored(spark, sf_dir).select("actor", "date", "n", F.round("score", 6).alias("score"), "is_anomaly"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.isolation_anomalies(timeseries.rolling_features(activity(spark, sf_dir), ["actor"]), ["actor"])


@query(
    """with {ACT}, r as (select actor, row_number() over (order by sum(weight) desc, actor) as actor_rank from wei group by actor), l as (select w.actor, w.date, weight, sum(weight) over (partition by date) as t, coalesce(sum(weight) over (partition by date order by actor_rank rows between unbounded preceding and 1 preceding), 0.0) as below from wei w join r using (actor))
    select actor, strftime(date, '%Y-%m-%d') as date, round(-t / 2 + below, 6) as lower, round(-t / 2 + below + weight, 6) as upper, round(t / 2, 6) as peak_y from l"""
)
def streamgraph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.layers(timeseries.engagement(activity(spark, sf_dir)), "actor")
    return text_dates(out.select("actor", "date", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "peak_y")]))


@query(
    """with {ACT}, i as (select *, row_number() over (partition by actor order by date) as i, count(*) over (partition by actor) as c from wei), k as (select d, exp(-0.5 * (d / 2.0) * (d / 2.0)) as e from range(-6, 7) t(d)), kk as (select d, e / sum(e) over () as e from k)
    select a.actor, strftime(a.date, '%Y-%m-%d') as date, round(sum(b.weight * e), 6) as smooth from i a cross join kk join i b on b.actor = a.actor and b.i = least(greatest(a.i + d, 1), a.c) group by all"""
)
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.smoothed(timeseries.engagement(activity(spark, sf_dir)), ["actor"], "weight")
    return text_dates(out.select("actor", "date", F.round("smooth", 6).alias("smooth")))


@query("with c as (select o_orderpriority as source, cast(year(o_orderdate) as int) as year, count(*) as n from orders group by 1, 2) select *, round(n / sum(n) over (partition by source), 6) as share from c")
def activity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return timeseries.shares(counts, ["source"]).withColumn("share", F.round("share", 6))


@query("select o_orderpriority as source, " + ", ".join(f"count(*) filter (year(o_orderdate) = {y}) as \"{y}\"" for y in range(1995, 2002)) + " from orders group by all")
def share_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return timeseries.wide(counts, "source", "year", list(range(1995, 2002)), "n")


@query("with {DOCS} select doc_id from docs where day between date '2015-02-01' and date '2015-03-15' or day >= date '2017-01-01'")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.in_ranges(docs(spark, sf_dir), "day", [("2015-02-01", "2015-03-15"), ("2017-01-01", None), ("2016-05-01", "2016-01-01")]).select("doc_id")


@query(
    """with t as (select doc_id, source, lang, row_number() over (partition by source, lang order by md5('42|' || doc_id), doc_id) as turn from documents)
    select doc_id from t order by turn, md5('42|' || coalesce(source, 'UNKNOWN_SOURCE') || '|' || coalesce(lang, 'UNKNOWN_LANG')), source, lang limit 100"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(docs(spark, sf_dir).select("doc_id", "source", "lang"), 100, ["source", "lang"], "doc_id").select("doc_id")


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 50")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.simple(docs(spark, sf_dir).select("doc_id"), 50, "doc_id")


@query("select doc_id, substring(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 300) as excerpt from documents")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", sampling.excerpt(F.col("text")).alias("excerpt"))


TOK = "tok as (select doc_id, lang, source, unnest(t) as term, unnest(range(len(t))) as pos from (select *, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}''-]+') as t from documents)), content as (select * from tok where regexp_matches(term, '\\p{L}'))"
STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


@query(f"with {TOK} select lang, term, count(*) as n from content where term not in {STOP} group by all")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(tokenised(spark, sf_dir), ["lang"], STOP_WORDS)


@query(f"with {TOK}, c as (select lang, term, count(*) as n from content where term not in {STOP} group by all) select lang, term, n, cast(row_number() over (partition by lang order by n desc, term) as int) as rank from c qualify row_number() over (partition by lang order by n desc, term) <= 40")
def top_terms_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(terms.term_counts(tokenised(spark, sf_dir), ["lang"], STOP_WORDS), ["lang"], 40)


@query(f"with {TOK}, p as (select lang, term || ' ' || lead(term) over (partition by doc_id order by pos) as bigram from content where term not in {STOP}) select lang, bigram, count(*) as n from p where bigram is not null group by all")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.bigrams(tokenised(spark, sf_dir), ["doc_id"], ["lang"], STOP_WORDS)


PIECES = """with recursive p as (select doc_id, 0 as k, '' as piece, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as rest from documents
    union all select doc_id, k + cast(regexp_replace(left(rest, e), '^\\s+|\\s+$', '', 'g') <> '' as int), regexp_replace(left(rest, e), '^\\s+|\\s+$', '', 'g'), substring(rest, e + 1) from (select *, case when length(rest) <= {MOST} then length(rest)
      when contains(left(rest, {MOST}), chr(10)) then case when {MOST} - instr(reverse(left(rest, {MOST})), chr(10)) > 200 then {MOST} - instr(reverse(left(rest, {MOST})), chr(10)) else {MOST} end
      when contains(left(rest, {MOST}), ' ') and {MOST} - instr(reverse(left(rest, {MOST})), ' ') > 200 then {MOST} - instr(reverse(left(rest, {MOST})), ' ') else {MOST} end as e from p where rest <> ''))
    select doc_id, cast(k as bigint) as piece_id, piece from p where piece <> ''"""


@query(PIECES.replace("{MOST}", "8000"))
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.pieces(docs(spark, sf_dir), "doc_id")


@query(
    """with {DOCS}, {SENT}, {MATCH}, m as (select *, cast(len(ks) > 0 as int) as hit, max(sentence_id) over (partition by doc_id) as last from matched), a as (select doc_id, sentence_id as anc, last from m where hit = 1),
    cand as (select a.doc_id, a.anc, r, a.anc + case when r = 0 then 0 when r % 2 = 1 then (r + 1) // 2 else -(r // 2) end as i from a, unnest(range(0, 2 * a.last + 1)) u(r)),
    j as (select c.doc_id, c.anc, c.r, m.sentence, m.sentence_id, m.hit, m.ks, coalesce(sum(length(m.sentence)) over (partition by c.doc_id, c.anc order by c.r rows between unbounded preceding and 1 preceding), 0) as before from cand c join m on m.doc_id = c.doc_id and m.sentence_id = c.i),
    g as (select doc_id, anc, string_agg(sentence, '. ' order by r) as chunk, list(sentence_id order by sentence_id) filter (hit = 1) as members from j where before < 250 group by doc_id, anc),
    o as (select *, row_number() over (partition by doc_id, members order by anc) as k from g)
    select doc_id, cast(row_number() over (partition by doc_id order by anc) as int) as chunk_id, cast(anc as int) as anchor_id, chunk from o where k = 1"""
)
def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched(spark, sf_dir)
    return chunks.context_chunks(rows, "doc_id").select("doc_id", "chunk_id", F.col("anchor_id").cast("int").alias("anchor_id"), "chunk")


@query("select lang, text as chunk, min(doc_id) as doc_id from documents group by all")
def chunk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.distinct_chunks(docs(spark, sf_dir).select("lang", F.col("text").alias("chunk"), "doc_id"), ["lang"], ["doc_id"])


@query(
    """with e as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(cast(x as double)) as x from e group by all)
    select label, cast(pos as int) as pos, round(x / sqrt(sum(x * x) over (partition by label)), 6) as x from m"""
)
def actor_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.centroids(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    """with p as (select cast(label as varchar) as actor, avg(cast(embedding[1] as double)) as x, avg(cast(embedding[2] as double)) as y from embeddings group by all), u as (select actor, (x - min(x) over ()) / (max(x) over () - min(x) over ()) as u, (y - min(y) over ()) / (max(y) over () - min(y) over ()) as w from p)
    select a.actor, round(min(sqrt((a.u - b.u) * (a.u - b.u) + (a.w - b.w) * (a.w - b.w))), 6) as distance from u a join u b on a.actor <> b.actor group by all"""
)
def actor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = prefix_columns(table(spark, sf_dir, "embeddings")).groupBy("actor").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return vectors.nearest_neighbour(places, "actor").withColumn("distance", F.round("distance", 6))


REGIONS = [(1, -0.1, 0.1, -0.1, 0.1), (2, 0.0, 0.5, 0.0, 0.5), (3, 0.4, 0.2, 0.0, 1.0), (4, 5.0, 6.0, 5.0, 6.0), (5, None, 1.0, 0.0, 1.0)]


@query(
    "with r(area, x_lower, x_upper, y_lower, y_upper) as (values " + ", ".join(f"({a}, {'null' if b is None else b}, {c}, {d}, {e})" for a, b, c, d, e in REGIONS) + """), n as (select area, any_value(x_lower > x_upper or y_lower > y_upper) as bad, count(vec_id) as n_points
    from r left join embeddings on cast(embedding[1] as double) between x_lower and x_upper and cast(embedding[2] as double) between y_lower and y_upper where x_lower is not null group by area)
    select area, n_points, case when bad then 'invalid' when n_points = 0 then 'empty' else 'ok' end as status from n"""
)
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame(REGIONS, "area int, x_lower double, x_upper double, y_lower double, y_upper double")
    return vectors.region_counts(prefix_columns(table(spark, sf_dir, "embeddings")), regions).select("area", "n_points", "status")


@query("select round(min(a) - 0.1 * (max(a) - min(a)), 6) as x_low, round(max(a) + 0.1 * (max(a) - min(a)), 6) as x_high, round(min(b) - 0.1 * (max(b) - min(b)), 6) as y_low, round(max(b) + 0.1 * (max(b) - min(b)), 6) as y_high from (select cast(embedding[1] as double) as a, cast(embedding[2] as double) as b from embeddings)")
def map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.extent(prefix_columns(table(spark, sf_dir, "embeddings")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    """with recursive near as (select x.vec_id as a, y.vec_id as b from embeddings x cross join embeddings y where list_distance(cast(x.embedding as double[]), cast(y.embedding as double[])) <= 0.9), core as (select a as id from near group by a having count(*) >= 5),
    edges as (select a, b from near where a in (select id from core) and b in (select id from core)), reach as (select id as a, id as b from core union select r.a, e.b from reach r join edges e on r.b = e.a), labels as (select a as id, min(b) as label from reach group by a),
    border as (select near.a as id, min(label) as label from near join labels on labels.id = near.b group by near.a), named as (select vec_id, coalesce(labels.label, border.label) as label from embeddings left join labels on labels.id = vec_id left join border on border.id = vec_id),
    numbers as (select label, row_number() over (order by label) - 1 as cluster from named where label is not null group by label having count(*) >= 5) select vec_id, cast(coalesce(cluster, -1) as int) as cluster from named left join numbers using (label)"""
)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.density_clusters(table(spark, sf_dir, "embeddings"), "vec_id", epsilon=0.9)


@query(
    """with recursive e as (select vec_id, cast(label as varchar) as actor, cast(embedding as double[]) as v from embeddings), u as (select vec_id, unnest(v) as x, unnest(range(len(v))) as i from e),
    m as (select i, avg(x) as mean from u group by i), g as (select p.i, q.i as j, avg(p.x * q.x) as s from u p join u q using (vec_id) group by p.i, q.i),
    rows as (select g.i, list(s - a.mean * b.mean order by j) as r from g join m a on a.i = g.i join m b on b.i = g.j group by g.i), mat as (select list(r order by i) as a, count(*) as d from rows),
    it as (select 0 as k, list_transform(range(d), lambda i: cast(1.0 as double) / (i + 1)) as v, list_transform(range(d), lambda i: cast(case when i % 2 = 0 then 1.0 else -1.0 end as double) / (i + 1)) as w from mat
      union all select k + 1, v, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) from (select k, v, list_transform(list_zip(w, v), lambda z: z[1] - list_dot_product(v, w) * z[2]) as w
        from (select k, list_transform(y, lambda x: x / sqrt(list_dot_product(y, y))) as v, w from (select k, list_transform(mat.a, lambda r: list_dot_product(r, v)) as y, list_transform(mat.a, lambda r: list_dot_product(r, w)) as w from it, mat where k < 100)))),
    d as (select v, w from it where k = 100), c as (select actor, list(x order by i) as v from (select actor, i, avg(x) as x from e join u using (vec_id) group by actor, i) group by actor), n as (select actor, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from c)
    select 'chunk' as kind, vec_id, actor, round(list_dot_product(e.v, d.v), 4) as umap_1, round(list_dot_product(e.v, d.w), 4) as umap_2 from e, d union all select 'actor', null, actor, round(list_dot_product(n.v, d.v), 4), round(list_dot_product(n.v, d.w), 4) from n, d"""
)
def pca_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and, by the same model, the centroids of their actors."""
    rows = table(spark, sf_dir, "embeddings").withColumn("actor", F.col("label").cast("string"))
    chunks_, actors = vectors.projected(rows, vectors.centroids(rows, "actor"))
    return vectors.map_export(chunks_, actors, ["vec_id"]).withColumns({c: F.round(c, 4) for c in ("umap_1", "umap_2")})


@query(
    """with w as (select doc_id, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))) as h from documents),
    t as (select doc_id, cast(list_sum(list_transform(range(1, 8), lambda i: (instr('0123456789abcdef', substring(h, i, 1)) - 1) * 16 ** (7 - i))) as bigint) % 64 as place, sum(case when (instr('0123456789abcdef', substring(h, 8, 1)) - 1) % 2 = 0 then 1 else -1 end) as n from w group by all),
    r as (select place, ln(((select count(*) from documents) + 1) / (count(*) + 1)) as rarity from t group by place), x as (select doc_id, place, n * rarity as v from t join r using (place))
    select doc_id, place, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) + 0.0 as value from x where v <> 0"""
)
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each text's vector that are not zero."""
    out = vectors.text_vectors(docs(spark, sf_dir).select("doc_id", "text"), "text", 64)
    return out.select("doc_id", F.posexplode("embedding").alias("place", "value")).filter("value <> 0").select("doc_id", F.col("place").cast("long").alias("place"), (F.round("value", 6) + 0.0).alias("value"))


@query(
    """select conv_id, text0 || case when replies is null then '' else '\n--- \n\n\n' || replies end as thread_text, cast(n as int) as n_replies from (select conv_id, coalesce(any_value(text) filter (turn = 0), '') as text0,
      string_agg(coalesce(text, '') || ' \n--- \n\n\n', '' order by turn) filter (turn > 0) as replies, count(*) filter (turn > 0) as n from conversations group by conv_id)"""
)
def thread_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("message_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), "text")
    return standardize.threads(turns, group=["conv_id"]).select("conv_id", "thread_text", F.coalesce(F.size("replies"), F.lit(0)).cast("int").alias("n_replies"))


@query(
    "select page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) as article_title, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') as links, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as n_links, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as source from pages"
)
def web_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("source"), F.col("url").alias("article_link"), F.array(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("article_title"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("external_links")
    )
    return standardize.web(raw, keep=("page_id",)).select("page_id", "article_title", F.coalesce(F.array_join("links_in_text", " "), F.lit("")).alias("links"), F.coalesce(F.size("links_in_text"), F.lit(0)).cast("long").alias("n_links"), "source")


@query(
    """with b as (select doc_id, lang, regexp_replace(coalesce(source, ''), '[^\\p{L}\\p{N}]', '', 'g') as s from documents), c as (select doc_id, 'XX-' || case when length(s) > 0 then upper(s[1] || s[length(s) // 2 + 1] || s[length(s)]) else 'XXX' end || '-' || upper(lang[1]) as code from b)
    select doc_id, code || '-' || row_number() over (partition by code order by doc_id) as entry_id from c"""
)
def entry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.entry_ids(docs(spark, sf_dir), "XX", ["doc_id"], "source", "lang").select("doc_id", F.col("entry_ID").alias("entry_id"))


@query(
    "with m(source, actor) as (values ('src0', 'Alpha'), ('src1', 'Alpha'), ('src2', 'Beta')) select doc_id, coalesce(m.actor, d.source) as actor from documents d left join m using (source)"
)
def actor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("src0", "Alpha"), ("src1", "Alpha"), ("src2", "Beta")], "source string, actor string")
    return standardize.mapped_actor(docs(spark, sf_dir), mapping).select("doc_id", "actor")


@query("select doc_id as entry_ID, source as actor, lang as platform, split_part(text, '\n', 1) || '\n\n' || trim(text, ' ') as text from documents where length(trim(text)) > 0 and lang <> 'es'")
def reduced_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = docs(spark, sf_dir).select(F.col("doc_id").alias("entry_ID"), F.col("source").alias("actor"), F.col("lang").alias("platform"), F.substring_index("text", "\n", 1).alias("article_title"), F.col("text").alias("article_text"))
    return reduce.reduced(raw, "es").select("entry_ID", "actor", "platform", "text")


@query("with h as (select doc_id, count(*) over (partition by lang, source, text) as group_size, min(doc_id) over (partition by lang, source, text) as first_id, cast(row_number() over (partition by lang, source, text order by doc_id) as int) as occurrence from documents) select * from h where group_size > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.duplicate_rows(table(spark, sf_dir, "documents").drop("n_chars"), "doc_id").drop("hash")


@query("select source, count(*) as n, 'duplicate' as problem from documents group by source having count(*) > 1")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.key_problems(docs(spark, sf_dir), "source")


@query("select source, lang, count(*) as n_texts, strftime(min(day), '%Y-%m-%d') as first_date, strftime(max(day), '%Y-%m-%d') as last_date from (select *, date '2015-01-01' + cast(doc_id % 3865 as int) as day from documents) where source is not null and lang is not null group by all")
def contents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(profiling.contents(docs(spark, sf_dir), ["source", "lang"], "day"))


@query(
    """with c as (select lang, count(*) as n_country, sum(count(*)) over () as n_all from documents group by lang), m as (select d.lang, case when toxic = 1 then 'toxic' else 'other' end as theme, count(*) as n from labels l join documents d using (doc_id) group by all)
    select lang, theme, n, printf('%.2f%%', 100.0 * n / n_all) as of_corpus, printf('%.2f%%', 100.0 * n / n_country) as of_country from m join c using (lang)
    union all select 'ALL', theme, cast(sum(n) as bigint), printf('%.2f%%', 100.0 * sum(n) / max(n_all)), printf('%.2f%%', 100.0 * sum(n) / max(n_all)) from m join c using (lang) group by theme"""
)
def share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = docs(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").join(corpus.select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("toxic") == 1, "toxic").otherwise("other").alias("theme"))
    return profiling.share_table(labelled, corpus, "lang", "theme")


@query("select source, lang, min(doc_id) as first_row, count(*) as n from documents group by all")
def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.first_seen_pairs(docs(spark, sf_dir), ["source", "lang"], "doc_id")


@query("with r as (select concat(text, lang) as value, source as file, (row_number() over (partition by source order by doc_id) - 1) // 25 as chunk from documents) select value, count(*) as chunks from (select distinct value, file, chunk from r where length(value) between 1 and 13) group by value having count(*) > 1")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 25 rows, as a source of the small tables has few."""
    return profiling.sentinels(docs(spark, sf_dir), ["text", "lang"], "source", ["doc_id"], rows=25)


@query(
    "select 'lang' as field, count(lang) as n, round(100.0 * count(lang) / count(*), 2) as percent, min(lang) as example from documents union all select 'source', count(source), round(100.0 * count(source) / count(*), 2), min(source) from documents union all select 'n_chars', count(n_chars), round(100.0 * count(n_chars) / count(*), 2), min(cast(n_chars as varchar)) from documents"
)
def sidecar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.sidecar(docs(spark, sf_dir), ["lang", "source", "n_chars"])


@query("select lang, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from documents group by lang")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.composition(docs(spark, sf_dir), "lang")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as standardised, case when o_orderdate between timestamp '1996-01-01' and timestamp '1999-12-31' then 'INSIDE' else 'OUTSIDE' end as status from orders")
def date_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.functions.dates import parsed_date

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return text_dates(profiling.date_audit(rows, "raw", parsed_date(F.col("raw"), F.lit(True)), "1996-01-01", "1999-12-31").drop("raw"))


@query("select source, count(*) as n_before, count(*) filter (day < date '2016-01-01') as n_after from (select *, date '2015-01-01' + cast(doc_id % 3865 as int) as day from documents) group by rollup (source)")
def filter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.totals(docs(spark, sf_dir), "source", F.col("day") < F.lit("2016-01-01").cast("date"))


@query("select event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest from events group by all")
def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.latest(table(spark, sf_dir, "events"), ["event_type"], "ts").withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@query("select c_custkey, 'not mapped' as problem from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'not in data' from orders where o_custkey not in (select c_custkey from customer) union all select o_custkey, 'duplicate' from orders group by o_custkey having count(*) > 1")
def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.mapping_check(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("select event_type, u.key as key, case json_type(props, '$.' || u.key) when 'UBIGINT' then 'int' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' else 'other' end as type, count(*) as n from events, unnest(json_keys(props)) u(key) group by all")
def json_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.type_profile(profiling.json_types(table(spark, sf_dir, "events"), "props", ["event_type"]), ["event_type"])


@query("select array_to_string(list_sort(json_keys(props)), ',') as keys, count(*) as n from events group by all")
def json_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.key_sets(table(spark, sf_dir, "events"), "props")


@query(
    """with e as (select doc_id, text, unnest([{'label': case when quality = 1 then 'good' else 'bad' end, 's': 0, 'e': 12}, {'label': case when toxic = 1 then 'toxic' else 'clean' end, 's': 3, 'e': 20}]) as x from labels join documents using (doc_id))
    select doc_id, x.label as label, x.s as start_offset, x.e as end_offset, substring(text, x.s + 1, x.e - x.s) as span from e"""
)
def label_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.flattened(annotated(spark, sf_dir)).select("doc_id", "label", "start_offset", "end_offset", "span")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two marked spans each."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    entity = lambda k, flag, yes, no, a, b: F.struct(F.lit(k).cast("long").alias("id"), F.when(F.col(flag) == 1, yes).otherwise(no).alias("label"), F.lit(a).alias("start_offset"), F.lit(b).alias("end_offset"))
    return rows.select("doc_id", "text", F.array(entity(1, "quality", "good", "bad", 0, 12), entity(2, "toxic", "toxic", "clean", 3, 20)).alias("entities"))


@query("select doc_id, case when quality = 1 then 'fine' else 'bad' end as label, 10 as start_offset, 22 as end_offset from labels join documents using (doc_id) union all select doc_id, case when toxic = 1 then 'toxic' else 'clean' end, 13, 30 from labels join documents using (doc_id)")
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = annotated(spark, sf_dir).withColumnRenamed("doc_id", "link")
    new = old.select("link", F.concat(F.lit("-" * 10), F.col("text")).alias("text"))
    moved = annotation.transferred(new, old, "link", {"good": "fine"})
    return moved.select(F.col("link").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", "e.label", "e.start_offset", "e.end_offset")


@query("select distinct d.source as \"from\", case when toxic = 1 then 'toxic' else 'clean' end as \"to\" from labels join documents d using (doc_id)")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"))
    return annotation.bipartite(rows, "source", "label")[1]


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n from events group by all")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(
    """with {DOCS}, {SENT}, {MATCH}, x as (select doc_id, any_value(source) as source, any_value(day) as day from matched where len(ks) > 0 group by doc_id), c as (select source, last_day(day) as date, count(*) as k from x group by all),
    cal as (select last_day(d) as date from generate_series(timestamp '2015-01-01', timestamp '2025-12-31', interval 1 month) t(d)) select s.source, strftime(cal.date, '%Y-%m-%d') as date, coalesce(k, 0) as n from (select distinct source from x) s cross join cal left join c on c.source = s.source and c.date = cal.date"""
)
def theme_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: monthly matched texts per actor for one theme, over the whole calendar."""
    indexed = keywords.index(matched(spark, sf_dir), "doc_id", ["source", "day"])
    return text_dates(timeseries.period_counts(indexed, "day", ["source"], "2015-01-01", "2025-12-31"))


@query(TOP + """ select '{' || string_agg('"' || peak_id || '":["' || strftime(from_date, '%Y-%m-%d') || '","' || strftime(to_date, '%Y-%m-%d') || '"]', ',' order by cast(peak_id as varchar)) || '}' as peaks from ranked""")
def peak_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peak_list(top(spark, sf_dir))


@query(TOP + " select actors, string_agg(cast(peak_id as varchar), ',' order by peak_id) as peak_ids from ranked where year(to_date) = 1997 group by actors")
def peaks_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = peaks.ending_in(top(spark, sf_dir).withColumn("actors", F.array_join("actors", ",")), 1997, ["actors"])
    return found.withColumn("peak_ids", F.array_join(F.col("peak_ids").cast("array<string>"), ","))


@query(TOP + " select cast(peak_id as int) as old_id, cast(row_number() over (order by from_date) as int) as peak_id from ranked where peak_id % 2 = 1 and from_date >= date '1996-01-01' and to_date < date '2001-01-01'")
def approved_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = peaks.review_sheet(top(spark, sf_dir)).withColumn("include_in_visualization", F.when(F.col("peak_id") % 2 == 1, " YES ").otherwise("no"))
    return peaks.approved(sheet, "1996-01-01", "2001-01-01")[0].select("old_id", "peak_id")


@query(TOP + " select 'Denmark' as country, 'orders' as theme, cast(peak_id as int) as peak_id, count, n_texts_total, cast(actors_engaged as int) as actors_engaged from ranked")
def deliverable_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = top(spark, sf_dir).withColumn("country", F.lit("DK")).withColumn("theme", F.lit("orders"))
    return peaks.deliverable(named, {"DK": "Denmark"}, {"lgb": "LGB"}).drop("from_date", "to_date")


@query(f"with {TOK}, c as (select quality, term, count(*) as n from content join labels using (doc_id) where term not in {STOP} group by all) select quality, term, n, cast(row_number() over (partition by quality order by n desc, term) as int) as rank from c qualify row_number() over (partition by quality order by n desc, term) <= 25")
def top_terms_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tokenised(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return terms.top_terms(terms.term_counts(labelled, ["quality"], STOP_WORDS), ["quality"], 25)


@query(f"with {TOK} select lang, term, count(*) as n from content where regexp_matches(term, 'tion$|^th') group by all")
def excluded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.excluded_counts(tokenised(spark, sf_dir), ["lang"], ["tion$", "^th"])


@query(f"with {TOK}, c as (select lang, term, count(*) as n from content where term not in {STOP} group by all), t as (select * from c qualify row_number() over (partition by lang order by n desc, term) <= 30), s as (select term, cast(sum(n) as bigint) as n from t group by term) select term, n, cast(row_number() over (order by n desc, term) as int) as rank from s qualify row_number() over (order by n desc, term) <= 30")
def top_terms_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_by_language(terms.term_counts(tokenised(spark, sf_dir), ["lang"], STOP_WORDS), [], "lang", 30)


@query(TOP + ", d as (select *, date '2015-01-01' + cast(doc_id % 3865 as int) - interval 20 year as day from documents) select cast(peak_id as int) as peak_id, doc_id, case when lang = 'en' then 'english' else 'default' end as route from d join ranked on day between from_date and to_date where length(trim(text)) > 0")
def peak_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("day", F.add_months("day", -240))
    return terms.peak_texts(rows, rows, top(spark, sf_dir), "doc_id", "day", "lang").drop("text")


@query("select doc_id, array_to_string(list_concat(case when regexp_matches(text, '(?i)\\sthe(\\s|\\.|,)') then ['the'] else [] end, case when regexp_matches(text, '(?i)\\sund(\\s|\\.|,)') then ['und'] else [] end), ',') as matched_keywords from documents where regexp_matches(text, '(?i)\\s(the|und)(\\s|\\.|,)')")
def annotation_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(keywords.annotation_match(docs(spark, sf_dir).select("doc_id", "text"), ["und", "the"]).drop("text"))


#: Words of two pairs and of one of three; the first pair and the triple share a word.
PAIRS = [("the", "und"), ("the", "le", "der"), ("la", "le")]


@query(
    """with w as (select doc_id, list_sort(list_filter(['der', 'la', 'le', 'the', 'und', 'que'], lambda k: regexp_matches(text, '(?i)\\s' || k || '(\\s|\\.|,)'))) as ws from documents where text is not null),
    p as (select doc_id, ws, list_filter([['the', 'und'], ['the', 'le', 'der'], ['la', 'le']], lambda p: list_has_all(ws, p)) as whole, list_filter([['the', 'und'], ['the', 'le', 'der'], ['la', 'le']], lambda p: not list_has_all(ws, p)) as part from w where len(ws) > 0),
    l as (select doc_id, ws, list_filter(ws, lambda x: not list_contains(flatten(part), x)) as stays, flatten(whole) as back from p)
    select doc_id, array_to_string(list_concat(stays, list_filter(['the', 'und', 'le', 'der', 'la'], lambda x: list_contains(back, x) and not list_contains(stays, x))), ',') as pairs from l"""
)
def paired_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.annotation_match(docs(spark, sf_dir).select("doc_id", "text"), ["und", "the", "le", "der", "la", "que"])
    return found.select("doc_id", F.array_join(keywords.keyword_pairs(F.col("matched_keywords"), PAIRS), ",").alias("pairs"))


@query("select doc_id, coalesce(d.lang, '') as lang, x.name as super_label from documents d left join (values ('en', 'Germanic'), ('de', 'Germanic'), ('fr', 'Romance')) x(l, name) on d.lang = x.l")
def super_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("en", "Germanic"), ("de", "Germanic"), ("fr", "Romance")], "label string, super_label string")
    return annotation.super_labels(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), mapping).select("doc_id", F.coalesce("label", F.lit("")).alias("lang"), "super_label")


@query("with {DOCS} select doc_id from docs where day is null or day between date '2015-06-01' and date '2016-06-01'")
def dates_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.between_or_null(docs(spark, sf_dir), "day", "2015-06-01", "2016-06-01").select("doc_id")


@query("with p as (select o_orderpriority as source, strftime(o_orderdate, '%d/%m/%Y') as raw, strftime(o_orderdate, '%Y-%m-%d') as parsed from orders group by all), r as (select *, cast(row_number() over (partition by source order by raw, parsed) as int) as rank from p) select * from r where rank <= 5")
def date_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.functions.dates import parsed_date

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return profiling.date_examples(rows.withColumn("parsed", F.date_format(parsed_date(F.col("raw"), F.lit(True)), "yyyy-MM-dd")), ["source"], "raw", "parsed")


@query("select distinct lang, source from documents")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.source_list(docs(spark, sf_dir), ["lang", "source"], "source")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1995-04-01')")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders without a processed file, on keys of the given tables."""
    from parlance.sources.files import unprocessed_folders

    folders = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("dir"))
    done = table(spark, sf_dir, "orders").filter("o_orderdate < timestamp'1995-04-01'").select(F.col("o_custkey").cast("string").alias("dir"))
    return unprocessed_folders(folders, done).select(F.col("dir").cast("long").alias("c_custkey"))


@query("with n as (select case when label < 5 then 'low' else cast(label as varchar) end as name, avg(cast(embedding[1] as double)) as x, avg(cast(embedding[2] as double)) as y from embeddings where label <> 7 group by all) select name, round(x, 6) as x, round(y, 6) as y from n")
def merged_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(str(k), "low") for k in range(5)], "actor string, name string")
    out = vectors.merged_actors(prefix_columns(table(spark, sf_dir, "embeddings")), names, ["7"])
    return out.select("name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with {FOREST}, fl as (select *, quantile_cont(score, 0.75) filter (is_anomaly) over (partition by actor) - 1.5 * stddev_pop(score) filter (is_anomaly) over (partition by actor) as least from scored) select actor, strftime(date, '%Y-%m-%d') as date, round(score, 6) as score, is_anomaly and coalesce(round(score, 9) >= round(least, 9), false) as is_anomaly from fl")
def isolation_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(peaks.with_floor(_scored(spark, sf_dir), ["actor"], 1.5).select("actor", "date", F.round("score", 6).alias("score"), "is_anomaly"))
