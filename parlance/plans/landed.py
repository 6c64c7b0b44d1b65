"""Registered queries that write a table as files, in the shared folder, and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.plans.queries import docs, query, table, text_dates
from parlance.sources import files, shared


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select doc_id, lang, source, text, strftime(day, '%Y-%m-%d') as day from (select *, date '2015-01-01' + cast(doc_id % 3865 as int) as day from documents)")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "lines")
    files.write(docs(spark, sf_dir).select("doc_id", "lang", "source", "text", "day"), path, "json")
    return text_dates(files.read_jsonl(spark, path, "doc_id long, lang string, source string, text string, day date"))


def _broken(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Lines of JSON; of every seven documents one is no object, one breaks off and one is blank."""
    k = F.col("doc_id")
    line = F.to_json(F.struct("doc_id", "source"))
    line = F.when(k % 7 == 1, F.lit("[1, 2]")).when(k % 7 == 3, F.concat(F.lit('{"doc_id": '), k.cast("string"), F.lit(', "sou'))).when(k % 7 == 5, F.lit("  ")).otherwise(line)
    table(spark, sf_dir, "documents").select("source", line.alias("value")).write.partitionBy("source").text(path)


@query(
    """select 'kept' as policy, count(*) filter (doc_id % 7 <> 5) as n, count(*) filter (doc_id % 7 in (1, 3)) as bad from documents union all select 'skipped', count(*) filter (doc_id % 7 not in (1, 3, 5)), 0 from documents
    union all select 'valid', count(*) filter (doc_id % 7 not in (3, 5)), 0 from documents"""
)
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policies for broken lines leave: kept aside, skipped, and what counts as valid JSON."""
    path = _place(spark, "broken")
    _broken(spark, sf_dir, path)
    kept = files.read_jsonl(spark, path, "doc_id long, _corrupt_record string", "keep").select("doc_id", "_corrupt_record")
    number = F.col("doc_id").cast("string")
    kept = kept.agg(F.lit("kept").alias("policy"), F.count(F.coalesce(number, "_corrupt_record")).alias("n"), F.count(F.concat(F.coalesce(number, F.lit("")), "_corrupt_record")).alias("bad"))
    skipped = files.read_jsonl(spark, path, "doc_id long, source string", "skip").filter("doc_id is not null").agg(F.lit("skipped").alias("policy"), F.count("*").alias("n"), F.lit(0).cast("long").alias("bad"))
    return kept.unionByName(skipped).unionByName(spark.range(1).select(F.lit("valid").alias("policy"), F.lit(files.count_valid(spark, path)).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))


@query(
    """select source, count(*) filter (doc_id % 7 not in (1, 3, 5)) as n_rows, count(*) filter (doc_id % 7 in (1, 3)) as n_bad from documents group by source"""
)
def source_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and broken lines of each source's file; one source's failures stop no other."""
    path = _place(spark, "sources")
    _broken(spark, sf_dir, path)
    names = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]  # a file each
    rows, failed = files.read_logged(spark, {n: f"{path}/source={n}" for n in names}, T.StructType([T.StructField("doc_id", T.LongType())]))
    counts = rows.groupBy("source_name").agg(F.count("*").alias("n_rows")).join(failed, "source_name", "full")
    return counts.select(F.col("source_name").alias("source"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_lines", F.lit(0)).alias("n_bad"))


@query(
    """select 'post' as kind, conv_id as id, 0 as reply, nullif(text, '') as text from conversations where turn = 0 and conv_id % 9 <> 4 union all select 'reply', conv_id, turn, case when turn % 5 = 3 then null else nullif(text, '') end from conversations where turn > 0 and (conv_id + turn) % 9 <> 4"""
)
def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a pair of files, quoted; some lines have a field too many and go, some lack their last one."""
    place, turn, k = _place(spark, "chat"), F.col("turn"), F.col("conv_id")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, sf_dir, "conversations").withColumn("quoted", quoted)
    more = lambda hit: F.when(hit, F.lit(";one;too many")).otherwise(F.lit(""))
    posts = rows.filter(turn == 0).select(F.concat(k.cast("string"), F.lit(";"), "quoted", more(k % 9 == 4)).alias("value"))
    replies = rows.filter(turn > 0).select(F.concat(k.cast("string"), F.lit(";"), turn.cast("string"), F.when(turn % 5 == 3, F.lit("")).otherwise(F.concat(F.lit(";"), "quoted")), F.when((k + turn) % 9 == 4, F.when(turn % 5 == 3, F.lit(";;x")).otherwise(F.lit(";x"))).otherwise(F.lit(""))).alias("value"))
    for name, lines, head in (("posts", posts, "id;text"), ("replies", replies, "id;reply;text")):
        _with_header(lines, head, f"{place}/{name}")
    found, below = files.read_chat(spark, f"{place}/posts", f"{place}/replies", "id long, text string", "id long, reply long, text string")
    assert files.read_chat(spark, f"{place}/posts", f"{place}/none", "id long, text string", "id long")[1] is None
    return found.select(F.lit("post").alias("kind"), "id", F.lit(0).cast("long").alias("reply"), "text").unionByName(below.select(F.lit("reply").alias("kind"), "id", "reply", "text"))


def _with_header(lines: DataFrame, head: str, path: str) -> None:
    """Every part begins with the header, as a writer of separated files does."""

    def put(batches):
        import pyarrow as pa

        yield pa.record_batch([[head]], names=["value"])
        yield from batches

    lines.mapInArrow(put, "value string").write.text(path)


@query("select distinct lang as theme, lower(trim(source)) as pattern from documents where lang is not null and trim(source) <> ''")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of themes as a file, with upper case, spaces and blanks, and as it is loaded."""
    path = _place(spark, "dictionary")
    themes = docs(spark, sf_dir).filter("lang is not null").groupBy("lang").agg(F.concat(F.collect_set(F.concat(F.lit(" "), F.upper("source"), F.lit(" "))), F.array(F.lit("  "))).alias("words"))
    themes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "words")))).alias("value")).coalesce(1).write.text(path)  # one row for each theme
    return files.dictionary(spark, path).distinct()


@query("select lang, count(*) + count(*) filter (lang = 'fr') - count(*) filter (lang = 'en' and doc_id % 2 = 0) as n from documents where lang is not null group by lang")
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set by language, of which one part is replaced by half of itself and another appended to."""
    path = _place(spark, "parts")
    rows = docs(spark, sf_dir).filter("lang is not null").select("doc_id", "lang")
    files.write(rows, path, "parquet", ["lang"])
    files.write(rows.filter("lang = 'en' and doc_id % 2 = 1"), path, "parquet", ["lang"])
    files.write(rows.filter("lang = 'fr'"), path, "parquet", ["lang"], replace=False)
    return spark.read.schema("doc_id long, lang string").parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    """with {DOCS} select regexp_replace(source, '[^\\p{L}\\p{N}_-]+', '_', 'g') as actor, case when doc_id % 6 = 0 then 'no_date' else cast(year(day) as varchar) end as year, case when doc_id % 6 = 0 then 'no_date' else lpad(cast(month(day) as varchar), 2, '0') end as month, count(*) as n from docs group by all"""
)
def month_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "months")
    rows = docs(spark, sf_dir).withColumn("day", F.when(F.col("doc_id") % 6 > 0, F.col("day"))).withColumn("line", F.col("doc_id").cast("string"))
    files.dump_by_month(rows, path, "source", "day", "line")
    found = spark.read.schema("value string, actor string, year string, month string").text(path)
    return found.groupBy("actor", "year", "month").agg(F.count("*").alias("n"))


@query("with {DOCS}, p as (select lang, source, year(day) as y, min(day) as a, max(day) as b from docs group by all) select lang, source, cast(y as varchar) as peak, strftime(a, '%Y-%m-%d') as first_day, strftime(b, '%Y-%m-%d') as last_day from p")
def peak_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of periods for each language and source, a file each, and as it is read."""
    path, year = _place(spark, "peaks"), F.year("day").cast("string")
    days = docs(spark, sf_dir).groupBy("lang", "source", year.alias("peak")).agg(F.array(*[F.date_format(f("day"), "yyyy-MM-dd") for f in (F.min, F.max)]).alias("days"))
    objects = days.groupBy("lang", "source").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("peak", "days"))))).alias("json"))
    files.write_objects(objects, path, ["lang", "source"], "json")
    out = files.read_objects(spark, path, "array<string>")
    return out.select("lang", "source", F.col("key").alias("peak"), F.col("value")[0].alias("first_day"), F.col("value")[1].alias("last_day"))
