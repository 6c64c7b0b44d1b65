"""The corpus in the columns that analysis needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.columns import as_text, existing, first_filled

REDUCED = ["entry_ID", "actor", "platform", "publication_date", "source", "link", "title", "text"]
CANDIDATES = {
    "publication_date": ["publication_date", "publication date", "timestamp", "edit_date"],
    "link": ["article_link", "video_link", "post_link", "url"],
    "title": ["article_title", "video_title", "post_title"],
    "text": ["article_text", "video_text", "thread_text", "message_text", "text"],
}


def without_blocks(text: Column) -> Column:
    """Bodies of a thread without its blocks of metadata; texts of neither form, and those of which nothing would be left, stay as they are.

    In a chat what follows ``Post_text:`` (the first) and each ``Comment_text:`` up to the next line of ``---`` is a body, and an empty
    line joins them. In a forum (``POST:`` or ``COMMENT:`` and ``---``) a block goes from two empty lines and ``---`` to the next
    line of ``---``. Line breaks may be written as ``\\n``: then all are taken so.
    """
    clean = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    holds = lambda *marks: F.greatest(*[text.contains(m) for m in marks])

    def cut(line: str) -> Column:
        bodies = lambda mark: F.regexp_extract_all(text, F.lit(rf"(?s){mark}:(?U:\s)(.*?)(?={line}---)"), F.lit(1))
        found = F.filter(F.transform(F.concat(F.slice(bodies("Post_text"), 1, 1), bodies("Comment_text")), clean), lambda x: x != "")
        left = clean(F.regexp_replace(text, f"(?s)(?:{line}){{3}}---{line}.*?{line}---{line}", "\n"))
        chat = F.when(F.size(found) > 0, F.array_join(found, "\n\n"))
        forum = F.when(left != "", left)
        return F.when(holds("Post_text:", "Comment_text:"), chat).when(holds("POST:", "COMMENT:") & text.contains("---"), forum)

    return F.coalesce(F.when(text.contains(r"\n---"), cut(r"\\n")).otherwise(cut("\n")), text)


def with_title(title: Column, text: Column) -> Column:
    """The title in front, if there are both."""
    t, x = F.trim(title), F.trim(text)
    return F.when((F.coalesce(t, F.lit("")) != "") & (F.coalesce(x, F.lit("")) != ""), F.concat_ws("\n\n", t, x)).otherwise(F.coalesce(F.nullif(x, F.lit("")), t))


def reduced(df: DataFrame, dropped_platform: str = "Flashback") -> DataFrame:
    """Eight columns in fixed order; rows of the dropped platform and rows without a text go."""
    rows = df.filter(F.coalesce(F.col("platform") != dropped_platform, F.lit(True)))
    texts = rows
    for c in {n for names in CANDIDATES.values() for n in names} & set(rows.columns):
        texts = texts.withColumn(c, as_text(rows, c))
    picked = {name: F.coalesce(*[F.col(f"`{n}`") for n in existing(texts, names)]) if existing(texts, names) else F.lit(None).cast("string") for name, names in CANDIDATES.items()}
    out = texts.select(*[F.col(c) if c in texts.columns else F.lit(None).cast("string").alias(c) for c in ("entry_ID", "actor", "platform", "source")], *[c.alias(f"__{n}") for n, c in picked.items()])
    out = out.withColumn("text", with_title(F.col("__title"), F.col("__text")))
    out = out.filter((F.length(F.coalesce("text", F.lit(""))) > 0) & (F.col("text") != "nan"))
    return out.select("entry_ID", "actor", "platform", F.col("__publication_date").alias("publication_date"), "source", F.col("__link").alias("link"), F.col("__title").alias("title"), "text")


def date_source(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The first date that is not blank, and the column it came from."""
    value, key = first_filled(df, names or CANDIDATES["publication_date"])
    return df.withColumn("raw_date", value).withColumn("date_key", key)


def annotation_columns(df: DataFrame) -> DataFrame:
    """Link, title, text, source and date for annotators, title and sub-title in front of the text."""
    value = lambda names: F.coalesce(*[F.nullif(F.trim(as_text(df, n)), F.lit("")) for n in existing(df, names)]) if existing(df, names) else F.lit(None).cast("string")
    title, sub, body = value(CANDIDATES["title"]), value(["article_sub_title"]), value(CANDIDATES["text"])
    return df.select(value(["source"]).alias("source"), value(CANDIDATES["link"]).alias("link"), title.alias("title"), value(CANDIDATES["publication_date"]).alias("publication_date"), F.concat_ws("\n\n", title, sub, body).alias("text"))


def activity_year(df: DataFrame, stamp: str = "timestamp", edited: str = "edit_date") -> DataFrame:
    """The year, in UTC, of a time stamp or else of its edit; null stays null."""
    return df.withColumn("year", F.year(F.coalesce(F.try_to_timestamp(F.col(stamp)), F.try_to_timestamp(F.col(edited)))))
