"""Annotated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.dates import parsed_date
from parlance.operators.keywords import actor_masked, annotation_match, keyword_pairs, post_blocks, with_header
from parlance.operators.reduce import annotation_columns
from parlance.operators.timeseries import between_or_null, in_ranges


def flattened(df: DataFrame) -> DataFrame:
    """One row per label with the span of text it marks; texts without labels go."""
    each = df.filter(F.size("entities") > 0).withColumn("e", F.explode("entities"))
    return each.select(*[c for c in df.columns if c != "entities"], F.col("e.id").alias("label_id"), "e.label", "e.start_offset", "e.end_offset", F.expr("substring(text, e.start_offset + 1, e.end_offset - e.start_offset)").alias("span"))


def super_labels(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``super_label`` of each label, null if unmapped."""
    return df.join(F.broadcast(mapping), "label", "left")


def transferred(new: DataFrame, labelled: DataFrame, key: str = "link", renames: dict[str, str] | None = None) -> DataFrame:
    """Labels moved to texts that gained a header: offsets grow by the difference in length; texts without labels stay."""
    old = labelled.select(key, F.length("text").alias("__old"), "entities")
    named = F.lit(None).cast("string")
    for a, b in (renames or {}).items():
        named = F.when(F.col("__label") == a, b).otherwise(named)
    out = new.join(old, key, "left").withColumn("__shift", F.length("text") - F.col("__old"))
    label = lambda x: F.coalesce(*[F.when(x["label"] == a, F.lit(b)) for a, b in (renames or {}).items()], x["label"])
    moved = F.transform("entities", lambda x: F.struct(x["id"].alias("id"), label(x).alias("label"), (x["start_offset"] + F.col("__shift")).cast("int").alias("start_offset"), (x["end_offset"] + F.col("__shift")).cast("int").alias("end_offset")))
    empty = F.expr("cast(array() as array<struct<id:bigint,label:string,start_offset:int,end_offset:int>>)")
    return out.withColumn("entities", F.coalesce(moved, empty)).drop("__old", "__shift")


def bipartite(df: DataFrame, actor: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and distinct edges of actors and labels."""
    edges = df.select(F.col(actor).alias("from"), F.col(label).alias("to")).filter("`from` is not null and `to` is not null").distinct()
    nodes = edges.select(F.col("from").alias("id"), F.lit("actor").alias("kind")).union(edges.select(F.col("to"), F.lit("label"))).distinct()
    return nodes, edges


def prepared(df: DataFrame, keywords: list[str], pairs: list[tuple[str, str]] = (), start: str | None = None, end: str | None = None, ranges: list[tuple[str | None, str | None]] | None = None, chats: bool = False) -> DataFrame:
    """Rows for annotators: columns, dates, range, keywords (the actor's own name doesn't count, nor, in chats, what stands outside posts and comments), header. An empty result keeps its columns."""
    rows = annotation_columns(df).withColumn("date", parsed_date(F.col("publication_date")))
    rows = in_ranges(rows, "date", ranges) if ranges is not None else between_or_null(rows, "date", start, end, drop_null=bool(start or end))
    rows = rows.withColumn("__searched", post_blocks(F.col("text")) if chats else F.col("text"))
    found = annotation_match(rows.withColumn("__searched", actor_masked("__searched", "coalesce(source, '')")), keywords, "__searched").drop("__searched")
    if pairs:
        found = found.withColumn("matched_keywords", keyword_pairs(F.col("matched_keywords"), list(pairs))).filter(F.size("matched_keywords") > 0)
    return found.withColumn("text", with_header(F.col("link"), F.col("source"), F.col("matched_keywords") if keywords else None, F.col("date"), F.col("text")))


def label_lists(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new labels side by side."""
    return old.select(F.col("text").alias("label"), F.lit("old").alias("list")).union(new.select("text", F.lit("new")))
