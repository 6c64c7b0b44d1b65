"""Registered queries that run as streams: they land a table in parts, stop, and go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import keywords, reduce, standardize
from parlance.plans.queries import TERMS, WRONG, docs, listed, query, table
from parlance.sources import shared
from parlance.streaming import ingest, periods
from parlance.streaming.ledger import Ledger


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("with {DOCS}, {SENT}, {MATCH} select doc_id, cast(sentence_id as bigint) as sentence_id, array_to_string(ks, ',') as matched_keywords, ws as matched_words from matched where len(ks) > 0")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles land in two parts, the second with a tenth of the first again; the stream ends after each and goes on with the next."""
    place = _place(spark, "ingest")
    k = F.col("doc_id")
    raw = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("e"), k.cast("string")).alias("entry_ID"), "source", F.col("text").alias("article_text"), F.date_format("day", "yyyy-MM-dd").alias("publication_date"))
    schema = "entry_ID string, source string, article_text string, publication_date string"

    def corpus(batch: DataFrame) -> DataFrame:
        rows = standardize.web(batch, keep=("entry_ID",)).withColumn("platform", F.lit("Website")).withColumn("actor", F.col("source"))
        found = keywords.match(keywords.sentences(reduce.reduced(rows)), TERMS, WRONG).filter("matched = 1")
        return listed(found.select("entry_ID", F.col("sentence_id").cast("long").alias("sentence_id"), "matched_keywords", "matched_words"))

    for part in (k % 2 == 0, (k % 2 == 1) | (k % 20 == 0)):
        raw.filter(part).drop("doc_id").write.mode("append").json(f"{place}/landing")
        ingest.ingest_once(spark, f"{place}/landing", schema, corpus, f"{place}/corpus", f"{place}/checkpoint", parts=spark.sparkContext.defaultParallelism).awaitTermination()
    out = Ledger(spark, f"{place}/corpus").read("entry_ID string, sentence_id long, matched_keywords string, matched_words string")
    return out.select(F.substring("entry_ID", 2, 20).cast("long").alias("doc_id"), "sentence_id", "matched_keywords", "matched_words")


@query(
    """with e as (select event_type as actor, ts, date_trunc('day', ts) as start, event_id % 11 = 0 or ts >= (select min(ts) + (max(ts) - min(ts)) / 2 from events) as second from events),
    w as (select actor, max(ts) as newest from e where not second group by actor),
    n as (select actor, start, count(*) filter (not second) as one, count(*) filter (second) as two, any_value(w.newest) as newest from e left join w using (actor) group by actor, start),
    j as (select *, coalesce(start + interval 1 day <= newest - interval 7 day, false) as closed from n)
    select actor, strftime(start, '%Y-%m-%d') as start, one + case when closed then 0 else two end as n, cast(not closed and one > 0 and two > 0 as int) as revisions, cast(case when closed then two else 0 end as bigint) as late from j"""
)
def stream_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in two parts, the second with rows of the first's days: some correct an open day, some come too late."""
    place = _place(spark, "periods")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    ends = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half")).first()
    second = (F.col("event_id") % 11 == 0) | (F.col("ts") >= F.lit(ends["half"]))
    for part in (~second, second):
        events.filter(part).write.mode("append").parquet(f"{place}/landing")
        rows = spark.readStream.schema(events.schema).parquet(f"{place}/landing")
        periods.follow(rows, "ts", "event_type", f"{place}/counts", f"{place}/checkpoint", parts=spark.sparkContext.defaultParallelism).awaitTermination()
    return periods.counts(spark, f"{place}/counts").withColumn("start", F.date_format("start", "yyyy-MM-dd"))
