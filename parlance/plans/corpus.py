"""Registered queries of reading, standardising, reducing, annotating and checking a corpus, on rows made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.columns import as_text, null_words
from parlance.functions.dates import MONTHS, parsed_date, relative_date, writes_day_first
from parlance.operators import annotation, chunks, keywords, profiling, reduce, sampling, standardize, terms, timeseries, vectors
from parlance.plans.queries import DOCS, MATCH, PIECES, SENT, STOP, STOP_WORDS, TOK, activity, annotated, docs, listed, matched, prefix_columns, query, split, table, text_dates, tokenised
from parlance.sources import files

#: The first line of a text, and a body of letters and spaces only.
LINE = "split_part(text, chr(10), 1)"


def first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def letters(c: str, n: int = 60) -> Column:
    return F.trim(F.regexp_replace(F.substring(F.coalesce(F.col(c), F.lit("")), 1, n), "[^A-Za-z ]", ""))


LETTERS = "trim(regexp_replace(substring(coalesce(text, ''), 1, 60), '[^A-Za-z ]', '', 'g'), ' ')"


def case(k: Column, *values: Column | str | None) -> Column:
    """The value whose number is ``k`` modulo their count."""
    out = None
    for i, v in enumerate(values):
        hit, value = k % len(values) == i, v if isinstance(v, Column) else F.lit(v)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


# files


PATH = """'/data/' || lang || '/' || ['websites', 'youtube', 'telegram', 'flashback'][doc_id % 4 + 1] || '/' || source || ['_SPIDER', '', '_archive'][doc_id % 3 + 1] || case when doc_id % 5 = 0 then '' else '_2024_0' || (doc_id % 9 + 1) || '_1' || (doc_id % 10) end || '.jl'"""
PLATFORM = "case when doc_id % 4 = 3 then 'Flashback' when doc_id % 3 = 0 then 'Website' when doc_id % 3 = 2 then 'Telegram' else ['Website', 'YouTube', 'Telegram'][doc_id % 4 + 1] end"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    stamp = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("_2024_0"), (k % 9 + 1).cast("string"), F.lit("_1"), (k % 10).cast("string")))
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), case(k, "websites", "youtube", "telegram", "flashback"), F.lit("/"), F.col("source"), case(k, "_SPIDER", "", "_archive"), stamp, F.lit(".jl"))
    return docs(spark, sf_dir).select("doc_id", "lang", "source", path.alias("path"))


@query(f"select doc_id, {PLATFORM} as platform, {PLATFORM} = 'Telegram' as is_chat from documents")
def path_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat, rest = files.routed(paths(spark, sf_dir))
    both = chat.withColumn("is_chat", F.lit(True)).union(rest.withColumn("is_chat", F.lit(False)))
    return both.select("doc_id", files.platform_of(F.col("path")).alias("platform"), "is_chat")


@query(
    f"""with p as (select distinct {PATH} as path from documents), x as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '_?\\d{{4}}_\\d{{2}}_\\d{{2}}', '') as kind, nullif(regexp_extract(path, '\\d{{4}}_\\d{{2}}_\\d{{2}}', 0), '') as stamp from p)
    select path from x qualify row_number() over (partition by dir, kind order by stamp is null, stamp desc, path desc) = 1"""
)
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.latest_snapshots(paths(spark, sf_dir).select("path").distinct())


@query(f"with p as (select regexp_extract({PATH}, '^(.*)/[^/]*$', 1) as dir, {PLATFORM} as platform from documents) select dir, count(*) as files, array_to_string(list_sort(list(distinct platform)), ',') as platforms from p group by dir having count(*) > 1 or count(distinct platform) > 1")
def folders_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(files.folder_report(paths(spark, sf_dir)))


@query("select doc_id, lang as country, ['Website', 'Video', null, null][doc_id % 4 + 1] as platform from documents")
def path_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.path_metadata(F.col("path"), {"websites": "Website", "youtube": "Video"})
    return paths(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("select lang as theme, array_to_string(list_sort(list(distinct source)), ', ') as terms, coalesce(array_to_string(list_sort(list(distinct source) filter (doc_id % 50 = 0)), ', '), '') as false_positives from documents group by lang")
def dictionary_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("lang").alias("theme"), F.col("source").alias("pattern"), "doc_id")
    return files.dictionary_report(rows, rows.filter("doc_id % 50 = 0"))


# standardising


@query("select o_orderkey as video_id, case when o_orderkey % 4 < 2 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 4 = 2 then 'soon' end as publication_date from orders")
def video_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(k.alias("video_id"), case(k, F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyy-MM-dd"), "soon", None).alias("publication_date"), *[F.lit("x").alias(c) for c in standardize.VIDEO_COLUMNS if c not in ("video_id", "publication_date")])
    return standardize.videos(raw).select("video_id", "publication_date")


@query(
    f"""with r as (select doc_id, lang, source, text, case when doc_id % 2 = 0 then 'Heading' else trim({LINE}, ' ') end as sub from documents)
    select doc_id, case when doc_id % 5 = 0 then null when doc_id % 7 = 0 then null when doc_id % 11 = 0 then 'nothing else' else source || ', ' || lang end as author, case when sub = '' then text when trim(text, ' ') = '' then sub when starts_with(ltrim(text, ' '), sub) then text else sub || chr(10) || text end as article_text,
      lang || ',' || lang || ',' || source as categories, source as references_text from r"""
)
def web_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw = F.col("doc_id"), docs(spark, sf_dir)
    raw = raw.select(
        "doc_id", "source", F.when(k % 5 == 0, F.array(F.lit("None"))).when(k % 7 == 0, F.array(F.lit(" No author "))).when(k % 11 == 0, F.array(F.lit("nothing else"))).otherwise(F.array(F.concat(F.col("source"), F.lit(" ")), F.lit(" "), F.col("lang"))).alias("author"), F.col("text").alias("article_text"), F.when(k % 2 == 0, F.lit(" Heading ")).otherwise(first_line()).alias("article_sub_title"),
        F.array("lang").alias("categories"), F.array("lang", "source").alias("themes_text"), F.array(F.lit(" "), F.concat(F.lit(" "), F.col("source")), F.lit("")).alias("references_text"),
    )
    return standardize.web(raw, keep=("doc_id",)).select("doc_id", "author", "article_text", F.array_join("article_categories", ",").alias("categories"), F.array_join(F.col("other_items")["references_text"], ",").alias("references_text"))


FORUM_DATE = "case turn when 0 then '2024-05-02 10:00' when 1 then '2024-05-01 11:30' else '2024-01-0' || (turn % 9 + 1) end"


@query(
    f"""with b as (select conv_id, turn, role, {FORUM_DATE} as d, regexp_replace(coalesce(text, '') || case when turn % 3 = 1 then ' --- so' || chr(10) || '---' || chr(10) || 'and more' else '' end, '^\\s+|\\s+$', '', 'g') as body from conversations where conv_id % 3 > 0),
    f as (select *, coalesce(min(turn) filter (body <> '') over (partition by conv_id), 0) as begins from b)
    select conv_id, count(*) as n_blocks, arg_min(d, turn) as publication_date, arg_min(role, turn) || ' van Dyk' as post_author, coalesce(string_agg(body, chr(10) || '---' || chr(10) || chr(10) order by turn) filter (turn >= begins), '') as thread_text, string_agg(d, ',' order by turn) as dates,
      string_agg(case when turn = 0 then 'POST' else 'COMMENT_' || turn end || ' p' || turn, ',' order by turn) as labels from f group by conv_id
    union all select conv_id, 0, null, null, 'Idag skrev ' || any_value(role) || ' --- inget mer --- POST:', null, null from conversations where conv_id % 3 = 0 and turn = 0 group by conv_id"""
)
def forum_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads written as blocks, with whole texts and lines of dashes in them; those of every third conversation don't parse."""
    turn = F.col("turn")
    day = F.when(turn == 0, F.lit("Idag 10:00")).when(turn == 1, F.lit("IGÅR 11:30")).otherwise(F.concat(F.lit("2024-01-0"), (turn % 9 + 1).cast("string")))
    body = F.concat(F.coalesce("text", F.lit("")), F.when(turn % 3 == 1, F.lit(" --- so\n---\nand more")).otherwise(F.lit("")))
    kind = F.when(turn == 0, F.lit("POST")).otherwise(F.lit("COMMENT"))
    block = F.concat(F.lit("---\n"), kind, F.lit(": \nAuthor: "), "role", F.lit(" van Dyk\nDate: "), day, F.lit(" \nTag: p"), turn.cast("string"), F.lit("\n---\n"), body, F.lit("\n\n\n"))
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", block.alias("block")).groupBy("conv_id")
    raw = raw.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda s: s["block"]), "").alias("blocks"), F.min_by("role", "turn").alias("role"))
    other = F.concat(F.lit("Idag skrev "), "role", F.lit(" --- inget mer --- POST:"))
    raw = raw.select("conv_id", F.when(F.col("conv_id") % 3 > 0, F.col("blocks")).otherwise(other).alias("thread_text"), F.lit("2024-05-02").alias("scrape_date"))
    listed_ = lambda f: F.when(F.col("replies").isNotNull(), F.array_join(F.transform("replies", f), ","))
    return standardize.forum(raw).select(
        "conv_id", F.coalesce(F.size("replies"), F.lit(0)).cast("long").alias("n_blocks"), "publication_date", "post_author", "thread_text", listed_(lambda r: r["date"]).alias("dates"), listed_(lambda r: F.concat_ws(" ", r["label"], r["tag"])).alias("labels")
    )


@query("with {DOCS} select doc_id, case doc_id % 4 when 0 then strftime(day, '%Y-%m-%d') || ' 08:15' when 1 then strftime(day - interval 1 day, '%Y-%m-%d') when 2 then '2024-01-01' end as date from docs")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", relative_date(case(F.col("doc_id"), "Idag 08:15", "igår", "2024-01-01", None), F.col("day")).alias("date"))


@query("select doc_id, case when doc_id % 3 > 0 then source end as post_categories, lang as links_in_text from documents")
def forum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(" "), F.concat(F.lit(" "), F.col("source")), F.lit("None"))).otherwise(F.array(F.lit("null")))
    out = standardize.forum_columns(docs(spark, sf_dir).select("doc_id", found.alias("categories"), F.col("lang").alias("external_links"), F.lit(None).cast("string").alias("image_links"), F.lit(None).cast("string").alias("post_HTML")))
    assert out.columns == ["doc_id", "post_categories", "links_in_text"]
    return listed(out)


@query("select 'Website' as platform, count(*) as n, count(text) as texts, 0 as messages, count(text) as filled from documents union all select 'Telegram', count(*), 0, count(text), 0 from conversations")
def platform_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = standardize.chat_columns(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("Message ID"), F.when(F.col("turn") >= 0, F.col("text")).alias(" Message text")))
    both = standardize.unioned({"Website": docs(spark, sf_dir).select("doc_id", "text"), "Telegram": chat})
    return both.groupBy("platform").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count("message_text").alias("messages"), F.count("doc_id").alias("filled"))


@query("with r as (select case when conv_id % 3 = 0 then '/x/_2024_01_02.csv' else '/x/ch' || (conv_id % 7) || '_2024_01_02.csv' end as path, role from conversations), o as (select role, count(*) as k from r where path like '/x/\\_%' escape '\\' group by role) select path, case when path like '/x/ch%' then regexp_extract(path, '(ch.)', 1) else (select role from o order by k desc, role limit 1) end as source, count(*) as n from r group by all")
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    path = F.when(k % 3 == 0, F.lit("/x/_2024_01_02.csv")).otherwise(F.concat(F.lit("/x/ch"), (k % 7).cast("string"), F.lit("_2024_01_02.csv")))
    rows = table(spark, sf_dir, "conversations").select(path.alias("path"), F.col("role").alias("to"))
    return standardize.channel(rows, "path").groupBy("path", "source").agg(F.count("*").alias("n"))


@query(
    """with recursive m as (select conv_id, turn as id, case when turn > 0 then (turn - 1) // 2 end as parent, coalesce(text, '') as text from conversations), t as (select conv_id, id, id as root, [id] as key, text from m where parent is null
    union all select m.conv_id, m.id, t.root, list_append(t.key, m.id), m.text from m join t on t.conv_id = m.conv_id and t.id = m.parent)
    select conv_id, root, arg_min(text, key) || case when count(*) > 1 then chr(10) || '--- ' || chr(10) || chr(10) || chr(10) || string_agg(text || ' ' || chr(10) || '--- ' || chr(10) || chr(10) || chr(10), '' order by key) filter (id <> root) else '' end as thread_text from t group by conv_id, root"""
)
def thread_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a tree: each turn has up to two that reply to it."""
    turn = F.col("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("message_id"), F.when(turn > 0, F.floor((turn - 1) / 2)).cast("long").alias("parent_id"), "text")
    return standardize.threads(turns, group=["conv_id"]).select("conv_id", "root", "thread_text")


@query(
    """with w as (select conv_id, max(turn) as last from conversations group by conv_id having count(*) = max(turn) + 1)
    select conv_id, last as root, last as n_below, string_agg(coalesce(text, '') || case when turn = last then '' else ' ' end || chr(10) || '--- ' || chr(10) || chr(10) || chr(10), '' order by turn desc) as thread_text from conversations join w using (conv_id) where last > 0 group by conv_id, last
    union all select conv_id, 0, 0, coalesce(text, '') from conversations join w using (conv_id) where last = 0"""
)
def late_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn replies to the next one, written later: all stand once, under the last."""
    rows = table(spark, sf_dir, "conversations")
    whole = rows.groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n")).filter("n = last + 1").select("conv_id", "last")
    turns = rows.join(whole, "conv_id").select("conv_id", F.col("turn").alias("message_id"), F.when(F.col("turn") < F.col("last"), F.col("turn") + 1).alias("parent_id"), "text")
    return standardize.threads(turns, group=["conv_id"]).select("conv_id", "root", F.coalesce(F.size("replies"), F.lit(0)).cast("long").alias("n_below"), "thread_text")


# reducing


@query("with {DOCS} select doc_id, case when doc_id % 3 = 2 then 'made-' || source when doc_id % 2 = 0 then source end as raw_date, case when doc_id % 3 = 2 then 'publication_date' when doc_id % 2 = 0 then 'timestamp' end as date_key from docs")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = docs(spark, sf_dir).select("doc_id", case(k, None, "  ", F.concat(F.lit("made-"), F.col("source"))).alias("publication_date"), case(k, F.col("source"), "").alias("timestamp"))
    return reduce.date_source(rows).select("doc_id", "raw_date", "date_key")


@query("select doc_id, case doc_id % 3 when 0 then lang || ' ' || source end as list_text, cast(n_chars as varchar) as number_text, case when lower(source) <> 'src1' then source end as word from documents")
def text_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("l", case(F.col("doc_id"), F.array("lang", "source"), F.expr("cast(array() as array<string>)"), F.lit(None).cast("array<string>")))
    return rows.select("doc_id", as_text(rows, "l").alias("list_text"), as_text(rows, "n_chars").alias("number_text"), null_words(F.concat(F.lit(" "), F.upper("source")), ("src1",)).alias("w")).select("doc_id", "list_text", "number_text", F.lower(F.trim("w")).alias("word"))


CLEAN = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: What a chat's text keeps of a body: all before the next line of dashes.
TO_DASHES = CLEAN.format("split_part(text || chr(10) || '---', chr(10) || '---', 1)")


@query(
    f"""select doc_id, case doc_id % 4 when 0 then case when {TO_DASHES} = '' then 'answer -- ' || lang else {TO_DASHES} || chr(10) || chr(10) || 'answer -- ' || lang end
      when 1 then {CLEAN.format("'POST: ' || lang || chr(10) || text || chr(10) || 'second ' || lang")} when 2 then case when {CLEAN.format("text")} = '' then lang else {CLEAN.format("text")} || chr(10) || chr(10) || lang end
      else 'He said --- and this is all important --- then left. ' || text end as body from documents where text is not null"""
)
def thread_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as chats, as forum threads, as chats with written line breaks, and as plain articles with dashes."""
    chat = F.concat(F.lit("Post_id: 3\nPost_text: "), "text", F.lit("\n---\nComment_id: 4\nComment_text: answer -- "), "lang", F.lit(" \n---\n"))
    forum = F.concat(F.lit("POST: "), "lang", F.lit("\n\n\n---\nPOST:\nAuthor: a b\nDate: x\n---\n"), "text", F.lit("\n\n\n---\nCOMMENT:\nAuthor: c\n---\nsecond "), "lang")
    written_out = F.concat(F.lit("Post_text: "), "text", F.lit("\\n---\\nComment_text: "), "lang", F.lit("\\n---\\n"))
    plain = F.concat(F.lit("He said --- and this is all important --- then left. "), "text")
    return docs(spark, sf_dir).filter("text is not null").select("doc_id", reduce.without_blocks(case(F.col("doc_id"), chat, forum, written_out, plain)).alias("body"))


@query(f"with {{DOCS}} select doc_id, source, 'doc/' || doc_id as link, nullif(trim({LINE}, ' '), '') as title, strftime(day, '%Y-%m-%d') as publication_date, array_to_string([nullif(trim({LINE}, ' '), ''), case when doc_id % 2 = 0 then lang end, nullif(trim(text, ' '), '')], chr(10) || chr(10)) as text from docs")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.annotation_columns(raw_articles(spark, sf_dir).drop("doc_id")).withColumn("doc_id", F.substring_index("link", "/", -1).cast("long"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the columns that websites have."""
    k = F.col("doc_id")
    return docs(spark, sf_dir).select(
        "doc_id", "source", F.concat(F.lit("doc/"), k.cast("string")).alias("article_link"), first_line().alias("article_title"), case(k, F.col("lang"), " ").alias("article_sub_title"), F.date_format("day", "yyyy-MM-dd").alias("publication_date"), F.col("text").alias("article_text")
    )


@query(
    f"""with {{DOCS}}, a as (select doc_id, source, day, array_to_string([nullif(trim({LINE}, ' '), ''), case when doc_id % 2 = 0 then lang end, nullif(trim(text, ' '), '')], chr(10) || chr(10)) as body from docs where day between date '2015-03-01' and date '2020-12-31'),
    m as (select *, regexp_matches(body, '(?i)\\sthe(\\s|\\.|,)') as a, regexp_matches(body, '(?i)\\sund(\\s|\\.|,)') as b from a)
    select doc_id, '---' || chr(10) || 'Link: doc/' || doc_id || chr(10) || 'Actor: ' || source || chr(10) || 'Matched keywords: ' || array_to_string(list_concat(case when a then ['the'] else [] end, case when b then ['und'] else [] end), ', ') || chr(10) || 'Publication date: ' || strftime(day, '%Y-%m-%d') || chr(10) || '---' || chr(10) || chr(10) || body as text from m where a or b"""
)
def annotation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotation.prepared(raw_articles(spark, sf_dir), ["und", "the"], start="2015-03-01", end="2020-12-31")
    return out.select(F.substring_index("link", "/", -1).cast("long").alias("doc_id"), "text")


@query("with {DOCS} select doc_id, case when doc_id % 3 > 0 then year(day) when doc_id % 2 = 0 then year(day) + 1 end as year from docs")
def activity_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("doc_id"), F.date_format("day", "yyyy-MM-dd'T'12:00:00")
    later = F.concat((F.year("day") + 1).cast("string"), F.lit("-01-31 00:00:00"))
    rows = docs(spark, sf_dir).select("doc_id", F.when(k % 3 > 0, day).alias("timestamp"), case(k, later, "unknown").alias("edit_date"))
    return reduce.activity_year(rows).select("doc_id", F.col("year").cast("long").alias("year"))


DATE_FORMS = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy", "EEE, dd MMM yyyy HH:mm:ss '+0000'", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy", "yyyyMMdd"]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date from orders where o_orderkey % 17 > 0 union all select o_orderkey, null from orders where o_orderkey % 17 = 0")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eight formats and in the months of seven languages; every seventeenth is none."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    word = lambda lang: F.element_at(F.array(*[F.lit(w) for w in MONTHS[lang].split()]), F.month(day))
    number, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    named = [F.concat_ws(" ", number, word(lang), year) for lang in ("fr", "it", "ro", "sv")] + [F.concat_ws(" ", F.concat(number, F.lit(".")), word("da"), year), F.concat(number, F.lit(" de "), word("es"), F.lit(" de "), year), F.concat(year, F.lit(". "), word("hu"), F.lit(" "), number, F.lit("."))]
    raw = F.when(k % 17 == 0, case(k, "soon", "32/13/2020", " ", None)).otherwise(case(k, *[F.date_format(day, f) for f in DATE_FORMS], *named))
    first = writes_day_first(F.lit("Paper"), F.lit("Website"), [("Paper", "Website")])
    return text_dates(table(spark, sf_dir, "orders").select("o_orderkey", parsed_date(raw, first).alias("date")))


# sentences and keywords


@query("with {DOCS}, {SENT} select doc_id, cast(sentence_id as bigint) as sentence_id from sent where doc_id % 5 > 0 and sentence_id % 4 > 0 and sentence <> 'nan'")
def usable_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split(spark, sf_dir).withColumn("day", F.when(F.col("doc_id") % 5 > 0, F.col("day"))).withColumn("sentence", F.when(F.col("sentence_id") % 4 == 0, F.lit("nan")).otherwise(F.col("sentence")))
    return keywords.usable(rows, "day").select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"))


@query("select doc_id, regexp_replace(text, case when lang = 'en' then '(?i)the' else '(?i)de' end, ' ', 'g') as masked from documents")
def actor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("actor", F.when(F.col("lang") == "en", F.lit("The")).otherwise(F.lit("DE")))
    return rows.select("doc_id", keywords.actor_masked("text", "actor").alias("masked"))


@query("select doc_id, case when doc_id % 2 = 0 then ': ' || split_part(text || chr(10) || '---', '---', 1) || chr(10) || ' x' else text end as searched from documents")
def chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = case(F.col("doc_id"), F.concat(F.lit("Post_id: 1 Post_text: "), "text", F.lit("\n--- other ---\nComment_text x---")), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", keywords.post_blocks(made).alias("searched"))


#: The dictionary of the most frequent words: short ones whole, seven letters by their end, longer ones by their start.
FREQUENT = 2000


@query(
    """with {DOCS}, {SENT}, f as (select w from (select unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from documents) group by w order by count(*) desc, w limit 2000),
    d as (select distinct case when length(w) >= 8 then left(w, 5) || '*' when length(w) = 7 then '*' || right(w, 5) else w end as k from f),
    t as (select doc_id, sentence_id, unnest(regexp_extract_all(sentence, '[\\p{L}\\p{N}_]+')) as w from sent),
    h as (select doc_id, sentence_id, k, w from t join d on d.k = lower(w) union all select doc_id, sentence_id, k, w from t join d on d.k = left(lower(w), 5) || '*' union all select doc_id, sentence_id, k, w from t join d on d.k = '*' || right(lower(w), 5) where length(w) >= 5),
    a as (select doc_id, sentence_id, array_to_string(list_sort(list(distinct k)), ',') as matched_keywords, array_to_string(list_transform(list_sort(list(distinct {'l': lower(w), 'w': w})), lambda z: z.w), ',') as matched_words from h group by all)
    select s.doc_id, cast(s.sentence_id as bigint) as sentence_id, matched_keywords, coalesce(matched_words, '') as matched_words, cast(matched_keywords is not null as int) as matched from sent s left join a using (doc_id, sentence_id)"""
)
def keyword_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences matched by a dictionary of two thousand patterns, made of the most frequent words of the texts."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("w").count()
    top = [r.w for r in words.orderBy(F.desc("count"), "w").limit(FREQUENT).collect()]
    made = sorted({w[:5] + "*" if len(w) >= 8 else "*" + w[-5:] if len(w) == 7 else w for w in top})
    found = keywords.match(split(spark, sf_dir).select("doc_id", "sentence_id", "sentence"), made)
    return listed(found.select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "matched_keywords", "matched_words", "matched"))


# periods


@query("with {DOCS} select doc_id from docs where day >= date '2015-01-01' and day < date '2020-08-01'")
def years_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.between(docs(spark, sf_dir), "day", "2015-01-01", "2020-08-01").select("doc_id")


@query("with {DOCS} select doc_id, strftime(day, '%Y-%m-%d') as day from docs where doc_id % 7 > 0 and day >= date '2015-03-01'")
def dated_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("day", F.when(F.col("doc_id") % 7 > 0, F.col("day")))
    return text_dates(timeseries.between_or_null(rows, "day", "2015-03-01", None, newest_first=True, drop_null=True).select("doc_id", "day"))


@query("with {DOCS} select doc_id from docs where day between date '2015-02-01' and date '2021-07-31' and source not like '%rc1%'")
def days_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.in_days(docs(spark, sf_dir), "day", "2015-02-01", "2021-07-31", "source", "RC1").select("doc_id")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("with {ACT}, r as (select actor, row_number() over (order by sum(weight) desc, actor) as place from wei group by actor) select strftime(date, '%Y-%m-%d') as date, cast(place as bigint) as place, cast(n as bigint) as n from dense join r using (actor)")
def actors_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = timeseries.engagement(activity(spark, sf_dir))
    order = timeseries.by_weight(series, "actor")
    out = timeseries.wide(series, "date", "actor", order, "n")
    cells = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("place"), F.col(a).alias("n")) for i, a in enumerate(order)])
    return text_dates(out.select("date", F.explode(cells).alias("c")).select("date", "c.*"))


# samples and terms


@query(
    f"""with r as (select doc_id, {CLEAN.format("coalesce(text, '')")} as body, {CLEAN.format(LINE)} as head from documents)
    select doc_id, substring(trim(regexp_replace(case when head <> '' and starts_with(body, head) then regexp_replace(substring(body, length(head) + 1), '^[\\n :\\-]+', '') else body end, '\\s+', ' ', 'g'), ' '), 1, 300) as excerpt from r"""
)
def titled_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = docs(spark, sf_dir).select("doc_id", first_line().alias("title"), "text")
    return docs(spark, sf_dir).select("doc_id").join(reduced, "doc_id").select("doc_id", sampling.excerpt(F.col("text"), F.col("title")).alias("excerpt"))


@query(PIECES.replace("{MOST}", "900"))
def short_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.pieces(docs(spark, sf_dir), "doc_id", most=900)


@query(f"with {TOK} select term, count(*) as n from content where term not in {STOP} group by term having count(*) > 1")
def terms_seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.repeated_terms(terms.term_counts(tokenised(spark, sf_dir), [], STOP_WORDS))


@query(
    f"""with {{DOCS}}, {{SENT}}, tok as (select doc_id, sentence_id, lang, unnest(t) as term, unnest(range(len(t))) as pos from (select *, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{M}}\\p{{N}}''-]+') as t from sent)), content as (select * from tok where regexp_matches(term, '\\p{{L}}') and term not in {STOP}),
    p as (select lang, term || ' ' || lead(term) over (partition by doc_id, sentence_id order by pos) as bigram from content) select lang, bigram, count(*) as n from p where bigram is not null group by all"""
)
def sentence_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.bigrams(terms.tokens(split(spark, sf_dir), ["doc_id", "sentence_id", "lang"], "sentence"), ["doc_id", "sentence_id"], ["lang"], STOP_WORDS)


# annotations


@query("select distinct lang as label, 'old' as list from documents union all select distinct source, 'new' from documents")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return annotation.label_lists(rows.select(F.col("lang").alias("text")).distinct(), rows.select(F.col("source").alias("text")).distinct())


@query("with e as (select d.source as a, case when toxic = 1 then 'toxic' else 'clean' end as b from labels join documents d using (doc_id)) select distinct a as id, 'actor' as kind from e union select distinct b, 'label' from e")
def bipartite_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"))
    return annotation.bipartite(rows, "source", "label")[0]


@query("select doc_id, substring(text, 1, 12) as span, 'good' as label from labels join documents using (doc_id) where quality = 1 union all select doc_id, substring(text, 1, 12), 'bad' from labels join documents using (doc_id) where quality <> 1 union all select doc_id, substring(text, 4, 17), case when toxic = 1 then 'toxic' else 'clean' end from labels join documents using (doc_id)")
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.flattened(annotated(spark, sf_dir)).select("doc_id", "span", "label")


# chunks and the map


@query(
    """with {DOCS}, {SENT}, {MATCH}, m as (select *, cast(len(ks) > 0 as int) as hit, max(sentence_id) over (partition by doc_id) as last from matched), a as (select doc_id, sentence_id as anc, source, day, last from m where hit = 1),
    cand as (select a.*, r, a.anc + case when r = 0 then 0 when r % 2 = 1 then (r + 1) // 2 else -(r // 2) end as i from a, unnest(range(0, 2 * a.last + 1)) u(r)),
    j as (select c.*, m.sentence_id, m.hit, m.ks, m.ws, coalesce(sum(length(m.sentence)) over (partition by c.doc_id, c.anc order by c.r rows between unbounded preceding and 1 preceding), 0) as before from cand c join m on m.doc_id = c.doc_id and m.sentence_id = c.i),
    g as (select doc_id, anc, any_value(source) as source, any_value(day) as day, list(sentence_id order by sentence_id) filter (hit = 1) as members from j where before < 250 group by doc_id, anc),
    o as (select * from g qualify row_number() over (partition by doc_id, members order by anc) = 1),
    w as (select doc_id, anc, kw, min(sentence_id * 10 + p) as f from (select j.doc_id, j.anc, j.sentence_id, unnest(ks) as kw, unnest(range(len(ks))) as p from j where before < 250 and hit = 1) group by all),
    k as (select doc_id, anc, string_agg(kw, ', ' order by f) as kws from w group by all),
    v as (select doc_id, anc, wd, min(sentence_id * 10000 + p) as f from (select j.doc_id, j.anc, j.sentence_id, unnest(string_split(ws, ',')) as wd, unnest(range(len(string_split(ws, ',')))) as p from j where before < 250 and hit = 1) group by all),
    u as (select doc_id, anc, string_agg(wd, ', ' order by f) as wds from v group by all)
    select doc_id, cast(row_number() over (partition by doc_id order by anc) as int) as chunk_id, source, strftime(day, '%Y-%m-%d') as day, kws as matched_keywords, wds as matched_words from o join k using (doc_id, anc) join u using (doc_id, anc)"""
)
def chunk_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.context_chunks(matched(spark, sf_dir), "doc_id", carry=["source", "day"])
    return text_dates(out.select("doc_id", "chunk_id", "source", "day", "matched_keywords", "matched_words"))


@query("with {DOCS} select vec_id from embeddings join docs on vec_id = doc_id where day between date '2015-06-01' and date '2016-12-31'")
def points_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "day")
    return vectors.of_days(prefix_columns(table(spark, sf_dir, "embeddings")), days, ["vec_id"], "day", "2015-06-01", "2016-12-31").select("vec_id")


@query("select doc_id, lang, case lang when 'en' then 15 when 'de' then 30 end as neighbours, cast(case lang when 'en' then 0.1 when 'de' then 0.25 end as double) as min_dist from documents")
def map_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([("en", 15, 0.1), ("de", 30, 0.25)], "lang string, neighbours int, min_dist double")
    return vectors.with_parameters(docs(spark, sf_dir).select("doc_id", "lang"), settings, ["lang"])


@query(
    """with c as (select vec_id, cast(label as varchar) as actor, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings) select 'chunk' as kind, vec_id, actor, round(x, 6) as umap_1, round(y, 6) as umap_2 from c
    union all select 'actor', null, actor, round(avg(x), 6), round(avg(y), 6) from c group by actor"""
)
def map_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = prefix_columns(table(spark, sf_dir, "embeddings")).withColumnsRenamed({"x": "umap_1", "y": "umap_2"})
    means = points.groupBy("actor").agg(F.avg("umap_1").alias("umap_1"), F.avg("umap_2").alias("umap_2"))
    out = vectors.map_export(points, means, ["vec_id"])
    return out.select("kind", "vec_id", "actor", F.round("umap_1", 6).alias("umap_1"), F.round("umap_2", 6).alias("umap_2"))


@query("select identifier, cast(row_number() over (order by starts_with(identifier, 'Influencer'), identifier) as int) as place from (select distinct case when c_custkey % 9 = 0 then 'Influencer ' else 'Actor ' end || c_mktsegment as identifier from customer)")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 9 == 0, "Influencer ").otherwise("Actor "), "c_mktsegment").alias("identifier")).distinct()
    ordered = vectors.display_order(named).agg(F.collect_list("identifier").alias("all"))  # actors are few
    return ordered.select(F.posexplode("all").alias("at", "identifier")).select("identifier", (F.col("at") + 1).alias("place"))


# checks


JSON = """'{"v": ' || ['1', '"x"', 'null', '2.5'][doc_id % 4 + 1] || ', "w": ' || ['"a"', 'null'][doc_id % 2 + 1] || case when doc_id % 3 = 0 then ', "z": [1]' else '' end || '}'"""
TYPED = "typed as (select doc_id, lang, source, 'v' as key, ['int', 'str', 'NA', 'float'][doc_id % 4 + 1] as type from documents union all select doc_id, lang, source, 'w', ['str', 'NA'][doc_id % 2 + 1] from documents union all select doc_id, lang, source, 'z', 'list' from documents where doc_id % 3 = 0)"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    made = F.concat(F.lit('{"v": '), case(k, "1", '"x"', "null", "2.5"), F.lit(', "w": '), case(k, '"a"', "null"), F.when(k % 3 == 0, F.lit(', "z": [1]')).otherwise(F.lit("")), F.lit("}"))
    return profiling.json_types(docs(spark, sf_dir).select("doc_id", "lang", "source", made.alias("json")), "json", ["doc_id", "lang", "source"])


@query(f"with {TYPED} select key, type, count(*) as n, 'wrong' as problem from typed where key = 'v' and type not in ('int', 'NA') group by all union all select 'z', null, null, 'unexpected' union all select 'y', null, null, 'missing'")
def type_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("v", ["int", "NA"]), ("w", ["str", "NA"]), ("y", ["int"])], "key string, types array<string>")
    wrong, unexpected, missing = profiling.type_deviations(profiling.type_profile(typed(spark, sf_dir)), expected)
    empty = [F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("n")]
    return wrong.select("key", "type", "n", F.lit("wrong").alias("problem")).union(unexpected.select("key", *empty, F.lit("unexpected"))).union(missing.select("key", *empty, F.lit("missing")))


@query(
    f"""with {TYPED}, t as (select * from typed where key = 'v'), p as (select key, type, lang as x from t group by all), s as (select key, type, source as x from t group by all), b as (select key, type, lang || '/' || source as x from t group by all),
    l as (select key, type, array_to_string(list_slice(list_sort(list(x)), 1, 3), ',') as v from p group by all), m as (select key, type, array_to_string(list_slice(list_sort(list(x)), 1, 3), ',') as v from s group by all), o as (select key, type, array_to_string(list_slice(list_sort(list(x)), 1, 3), ',') as v from b group by all)
    select key, type, count(*) as n, any_value(l.v) as platforms, any_value(m.v) as actors, any_value(o.v) as pairs from t join l using (key, type) join m using (key, type) join o using (key, type) group by key, type"""
)
def mismatch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).filter("key = 'v'").withColumnsRenamed({"lang": "platform", "source": "actor"})
    return listed(profiling.mismatch_context(rows, 3))


@query(f"with {TYPED} select doc_id, lang from typed where type = 'float' qualify row_number() over (partition by lang order by doc_id) <= 2")
def float_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.examples(typed(spark, sf_dir).filter("type = 'float'"), ["lang"], "doc_id").select("doc_id", "lang")


@query(f"with {TYPED} select lang, key, array_to_string(list_sort(list(distinct type)), ',') as types from typed where key = 'v' group by all having count(distinct type) > 1 union all select 'ALL', key, array_to_string(list_sort(list(distinct type)), ',') from typed where key = 'v' group by key")
def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of mixed types inside each language, and over all."""
    profile = profiling.type_profile(typed(spark, sf_dir), ["lang"])
    return profiling.type_mixes(profile, by=["lang"]).unionByName(profiling.type_mixes(profile).withColumn("lang", F.lit("ALL")))


@query("with {DOCS} select count(*) as records, strftime(max(day), '%Y-%m-%d') as last_scraped, year(min(day)) as first_year, year(max(day)) as last_year, (select string_agg(lang, '+' order by lang) from (select distinct lang from documents)) as type_label from docs")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = profiling.dataset_card(docs(spark, sf_dir), "day", "day", "lang")
    return text_dates(card.withColumn("first_year", F.col("first_year").cast("long")).withColumn("last_year", F.col("last_year").cast("long")))


@query("select 'lang' as field, 'string' as type, (select lang from documents where lang is not null order by doc_id limit 1) as first_value union all select 'n_chars', 'bigint', (select cast(n_chars as varchar) from documents where n_chars is not null order by doc_id limit 1)")
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.field_types(docs(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("long")), "doc_id", ["lang", "n_chars"])


@query("select doc_id, case source when 'src0' then 'Influencer 1' when 'src3' then 'Influencer 2' else source end as actor, source in ('src0', 'src3') as is_flagged from documents")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("src0", "Influencer 1", "TRUE "), ("src1", "Actor 1", "false"), ("src3", "Influencer 2", "true")], "actor string, identifier string, is_influencer string")
    return profiling.pseudonymised(docs(spark, sf_dir).select("doc_id", F.col("source").alias("actor")), known).select("doc_id", "actor", "is_flagged")


@query("with f as (select distinct o_custkey as c_custkey from orders where o_orderpriority = '1-URGENT') select c_custkey, 'flagged, not in data' as problem from f where c_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING') union all select c_custkey, 'flagged, not mapped' from f where c_custkey not in (select c_custkey from customer where c_mktsegment <> 'MACHINERY')")
def flagged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return profiling.flagged_check(people.filter("c_mktsegment <> 'BUILDING'"), people.filter("c_mktsegment <> 'MACHINERY'"), urgent, "c_custkey")


@query("select lang, count(distinct source) as n_sources, count(*) as n_rows, min(doc_id) as first_row from documents group by lang")
def nested_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = profiling.nested_audit(docs(spark, sf_dir).select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])
    return nested.select("lang", F.size("rows").cast("long").alias("n_sources"), F.expr("aggregate(rows, 0L, (n, x) -> n + size(x.rows))").alias("n_rows"), F.expr("array_min(transform(rows, x -> x.rows[0].doc_id))").alias("first_row"))
