"""Raw rows of websites, videos, forums and chats in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import FALSE_AUTHORS, as_list, existing, filled_list, meaningful, null_words
from parlance.functions.dates import relative_date, video_date
from parlance.sources.shared import counted, dropped, written

WEB_COLUMNS = ["scrape_date", "source", "article_link", "article_title", "publication_date", "author", "article_text", "article_categories", "links_in_text", "embedded_media_links", "image_links", "other_items"]
VIDEO_COLUMNS = ["scrape_date", "video_title", "source", "publication_date", "video_link", "video_id", "video_text"]
POST_END, REPLY_END = "\n--- \n\n\n", " \n--- \n\n\n"


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; missing ones are an error that lists them."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def videos(df: DataFrame) -> DataFrame:
    return required(df, VIDEO_COLUMNS).withColumn("publication_date", video_date(F.col("publication_date")))


def with_subtitle(text: Column, subtitle: Column) -> Column:
    """The sub-title in front, unless the text begins with it; alone if there is no text."""
    sub, blank = F.trim(subtitle), F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(F.coalesce(sub, F.lit("")) == "", text).when(blank, sub).when(F.ltrim(text).startswith(sub), text).otherwise(F.concat_ws("\n", sub, text))


def _joined(df: DataFrame, name: str, separator: str) -> Column:
    c = F.col(name)
    return F.array_join(meaningful(c), separator) if dict(df.dtypes)[name].startswith("array") else c.cast("string")


def web(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Website rows in their fixed columns, missing ones null, others dropped but for those of ``keep``, which pass as they are.

    Categories and themes are one list, in this order, repeats included.
    """
    out = df
    for c in ("article_title", "article_sub_title", "author", "article_text", "publication_date", "source"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("article_title", _joined(out, "article_title", "\n")).withColumn("author", null_words(_joined(out, "author", ", "), FALSE_AUTHORS))
    out = out.withColumn("publication_date", null_words(F.col("publication_date").cast("string")))
    out = out.withColumn("article_text", with_subtitle(F.col("article_text"), F.col("article_sub_title")))
    lists = {c: as_list(out, c) for c in existing(out, ["categories", "themes_text", "external_links", "youtube_links", "links_in_text", "embedded_media_links", "article_categories", "image_links", "references_text"])}
    empty = F.expr("cast(array() as array<string>)")
    of = lambda c: lists.get(c, empty)
    out = out.withColumn("__categories", F.coalesce(filled_list(F.concat(of("categories"), of("themes_text"))), filled_list(of("article_categories"))))
    out = out.withColumn("__links", F.coalesce(filled_list(of("external_links")), filled_list(of("links_in_text")))).withColumn("__media", F.coalesce(filled_list(of("youtube_links")), filled_list(of("embedded_media_links"))))
    references = filled_list(meaningful(of("references_text")))
    kept = F.col("other_items") if "other_items" in df.columns else F.lit(None).cast("map<string,array<string>>")
    out = out.withColumn("__other", F.coalesce(F.when(references.isNotNull(), F.create_map(F.lit("references_text"), references)), kept)).withColumn("__images", filled_list(of("image_links")))
    renamed = {"article_categories": "__categories", "links_in_text": "__links", "embedded_media_links": "__media", "other_items": "__other", "image_links": "__images"}
    return out.select(*keep, *[(F.col(renamed[c]) if c in renamed else F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(c) for c in WEB_COLUMNS])


# The lines of a block of a forum thread, and what stands between the bodies of a thread.
FORUM_BLOCK = (
    r"(?dmsU)^\s*---\s*\n(POST|COMMENT)\s*:\s*\n"
    r"Author:[^\S\n]*(.*?)\s*\nDate:[^\S\n]*(.*?)\s*\nTag:[^\S\n]*(.*?)\s*\n---\s*\n"
    r"(.*?)(?=\n\s*\n\s*\n---\s*\n|\z)"
)
BETWEEN_BODIES = "\n---\n\n"


def forum(df: DataFrame) -> DataFrame:
    """Forum threads whose text is a row of blocks: ``replies`` (label, author, date, tag, text) and the joined ``thread_text``.

    A block names its kind, author, date and tag (each may be empty) in lines of their own between two lines of ``---``; its body ends at two
    empty lines before the next block. Rows that already have ``replies`` keep them and their text; rows that don't parse pass
    unchanged with null replies. A missing date or author is taken from the first block. Dates relative to the day of
    scraping are made whole, in replies that were there too; without a day of scraping they stay.
    """
    clean = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    whole = clean(F.col("thread_text"))
    part = lambda k: F.regexp_extract_all(whole, F.lit(FORUM_BLOCK), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("kind"), part(2).alias("author"), part(3).alias("date"), part(4).alias("tag"), part(5).alias("text"))
    dated = lambda c: relative_date(c, F.col("scrape_date"))
    block = lambda x, i: F.struct(
        F.when((x["kind"] == "POST") | (i == 0), F.lit("POST")).otherwise(F.concat(F.lit("COMMENT_"), i.cast("string"))).alias("label"), clean(x["author"]).alias("author"), dated(clean(x["date"])).alias("date"), clean(x["tag"]).alias("tag"), clean(x["text"]).alias("text")
    )
    parsed = filled_list(F.transform(zipped, block))
    known = F.lit(None)
    if "replies" in df.columns:
        known = filled_list(F.col("replies"))
        if "date" in df.schema["replies"].dataType.elementType.fieldNames():
            known = F.transform(known, lambda r: r.withField("date", dated(r["date"])))
    out = df.withColumn("__known", known.isNotNull()).withColumn("replies", F.coalesce(known, parsed) if "replies" in df.columns else parsed)
    first = F.try_element_at("replies", F.lit(1))
    bodies = F.transform("replies", lambda r: r["text"])
    # the bodies from the first that isn't empty on
    joined = F.aggregate(bodies, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(BETWEEN_BODIES), x)))
    out = out.withColumn("thread_text", F.when(F.col("__known") | F.col("replies").isNull(), F.col("thread_text")).otherwise(joined))
    for c, field in (("publication_date", "date"), ("post_author", "author")):
        found = F.when(~F.col("__known"), first[field])
        out = out.withColumn(c, F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), found, F.col(c)) if c in df.columns else found)
    return out.withColumn("publication_date", F.when(F.col("replies").isNotNull(), dated(F.col("publication_date"))).otherwise(F.col("publication_date"))).drop("__known")


def preorder(parents: DataFrame, nodes: DataFrame, g: list[str]) -> DataFrame:
    """``message_id, root, left`` of every node of a forest: nodes of a tree in depth-first order have falling ``left``.

    ``parents`` (message_id, parent_id) holds no circle; siblings stand by id. List ranking over the Euler tour: each node
    has an arc down and an arc up, each arc names the next one of the tour and counts the arcs down from itself to there.
    In a round every arc takes over the target of its target, so that distances double: a tree of n nodes takes
    log2(2n) rounds of narrow rows, however deep it is, and no row holds a path.
    """
    w = Window.partitionBy(*g, "parent_id").orderBy("message_id")
    linked = parents.withColumn("next", F.lead("message_id").over(w))
    first = parents.groupBy(*g, F.col("parent_id").alias("message_id")).agg(F.min("message_id").alias("first"))
    tour = nodes.select(*g, "message_id").join(linked, [*g, "message_id"], "left").join(first, [*g, "message_id"], "left")
    node, up = F.col("message_id"), lambda x: F.lit(x)
    down_arc = F.struct(up(False).alias("up"), F.coalesce("first", node).alias("to"), F.col("first").isNull().alias("to_up"), F.lit(1).cast("long").alias("left"), F.lit(None).cast("long").alias("root"))
    over = F.coalesce("next", "parent_id")
    up_arc = F.struct(up(True).alias("up"), over.alias("to"), F.when(over.isNotNull(), F.col("next").isNull()).alias("to_up"), F.lit(0).cast("long").alias("left"), F.when(over.isNull(), node).alias("root"))
    arcs, going = counted(tour.select(*g, "message_id", F.explode(F.array(down_arc, up_arc)).alias("arc")).select(*g, "message_id", "arc.*"), F.col("to").isNotNull(), "arcs")
    while going:
        target = arcs.select(*g, F.col("message_id").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("far"), F.col("to_up").alias("far_up"), F.col("left").alias("more"), F.col("root").alias("top"))
        jumped = arcs.filter(F.col("to").isNotNull()).join(target, [*g, "to", "to_up"])
        jumped = jumped.select(*g, "message_id", "up", F.col("far").alias("to"), F.col("far_up").alias("to_up"), (F.col("left") + F.col("more")).alias("left"), F.col("top").alias("root"))
        used = arcs
        arcs, going = counted(arcs.filter(F.col("to").isNull()).unionByName(jumped), F.col("to").isNotNull(), "arcs")
        dropped(used)
    return arcs.filter(~F.col("up")).select(*g, "message_id", "root", "left")


def threads(posts: DataFrame, replies: DataFrame | None = None, group: list[str] = ()) -> DataFrame:
    """Chat threads: each topmost post with all that stands below it, depth first.

    ``posts`` (message_id, parent_id, text), ``replies`` (parent_id, reply_id, text); ``group`` columns keep channels
    apart; rows whose id or group is null go. Under each post its archived replies come first (by reply_id), then the posts that reply to it (by
    message_id), each followed by its own. Posts without a known parent are roots; every post stands once, under its
    topmost ancestor, also if its parent was written later. In a circle of replies the post of the smallest
    id counts as one without a parent. Of posts that share an id the one of the smallest text stands, replies may repeat.
    """
    g = list(group)
    posts = posts.groupBy(*g, "message_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "parent_id")).alias("post")).select(*g, "message_id", "post.*")
    known = posts.select(*g, F.col("message_id").alias("parent_id"))
    parents = posts.join(known, [*g, "parent_id"], "left_semi").filter("parent_id <> message_id").select(*g, "message_id", "parent_id")
    places = preorder(_uncircled(parents, g), posts, g)
    entry = lambda archived, number, place: F.struct((-F.col("left")).alias("at"), F.lit(archived).alias("archived"), place.alias("place"), F.coalesce("text", F.lit("")).alias("text"), number.cast("long").alias("message_id")).alias("entry")
    rows = posts.join(places, [*g, "message_id"]).select(*g, "root", entry(False, F.col("message_id"), F.lit(0).cast("long")))
    if replies is not None:
        below = replies.select(*g, F.col("parent_id").alias("message_id"), F.col("reply_id").cast("long").alias("reply_id"), "text").join(places, [*g, "message_id"])
        rows = rows.unionByName(below.select(*g, "root", entry(True, F.col("reply_id"), F.coalesce("reply_id", F.lit(-(2**63))))))
    out = rows.groupBy(*g, "root").agg(F.array_sort(F.collect_list("entry")).alias("__all"))
    below = F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0)))
    texts = F.transform(below, lambda x: F.concat(x["text"], F.lit(REPLY_END)))
    first = F.element_at("__all", 1)["text"]
    nested = F.transform(below, lambda x: F.struct(x["message_id"].alias("message_id"), x["text"].alias("text"), x["archived"].alias("is_reply"), (~x["archived"]).alias("is_reply_via_post")))
    return out.select(*g, "root", F.when(F.size("__all") > 1, F.concat(first, F.lit(POST_END), F.array_join(texts, ""))).otherwise(first).alias("thread_text"), filled_list(nested).alias("replies"))


def _uncircled(parents: DataFrame, g: list[str]) -> DataFrame:
    """``parents`` without the link above the smallest post of each circle. Only links to later posts can close one.

    Every post walks upwards in doubling steps; after as many steps as there are links, those still walking stand on a circle.
    """
    if not parents.filter("parent_id > message_id").limit(1).count():
        return parents
    walk, step, most = written(parents.select(*g, "message_id", F.col("parent_id").alias("at"), F.least("message_id", "parent_id").alias("low")), "walk"), 1, parents.count()
    while step <= most:
        if not walk.filter("at is not null").limit(1).count():
            dropped(walk)
            return parents
        above = walk.select(*g, F.col("message_id").alias("at"), F.col("at").alias("next"), F.col("low").alias("lower"))
        walking = walk.filter("at is not null").join(above, [*g, "at"], "left").select(*g, "message_id", F.col("next").alias("at"), F.least("low", "lower").alias("low"))
        used, walk = walk, written(walk.filter("at is null").unionByName(walking), "walk")
        dropped(used)
        step *= 2
    on = walk.filter("at is not null").select(*g, F.col("at").alias("message_id")).distinct()
    cut = walk.join(on, [*g, "message_id"], "left_semi").filter("low = message_id").select(*g, "message_id")
    return parents.join(cut, [*g, "message_id"], "left_anti")


def source_name(path: Column, to: Column | None = None) -> Column:
    """The file's stem in front of ``_YYYY_MM_DD``."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:_?\d{4}_\d{2}_\d{2}[^/]*)?(?:\.[A-Za-z]+)?$", 1)
    return F.coalesce(F.nullif(stem, F.lit("")), to) if to is not None else stem


def channel(df: DataFrame, path: str, to: str = "to") -> DataFrame:
    """``source``: the file's stem; where a file has none, the most frequent ``to`` of its rows (ties: the first in order)."""
    counts = df.filter(F.col(to).isNotNull()).groupBy(path, to).count()
    often = counts.groupBy(path).agg(F.min_by(to, F.struct(-F.col("count"), F.col(to))).alias("__often"))
    return df.join(often, path, "left").withColumn("source", source_name(F.col(path), F.col("__often"))).drop("__often")


def mapped_actor(df: DataFrame, mapping: DataFrame, source: str = "source") -> DataFrame:
    """``actor`` by exact source; sources that the mapping doesn't know stay as they are."""
    small = mapping.select(F.col("source").alias("__source"), F.col("actor").alias("__actor"))
    return df.join(small, F.col(source) == F.col("__source"), "left").withColumn("actor", F.coalesce("__actor", source)).drop("__source", "__actor")


def entry_ids(df: DataFrame, country: str, order: list[str], actor: str = "actor", platform: str = "platform") -> DataFrame:
    """``{country}-{first, middle, last letter of the actor}-{platform's initial}-{running number}``; null and empty ones are UNKNOWN."""
    bare = F.regexp_replace(F.coalesce(F.col(actor), F.lit("")), r"[^\p{L}\p{N}]", "")
    letters = F.upper(F.concat(F.substring(bare, 1, 1), F.expr("substring(__bare, cast(length(__bare) div 2 as int) + 1, 1)"), F.substring(bare, -1, 1)))
    of = lambda c, found: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("UNKNOWN")).otherwise(found)
    code = F.concat_ws("-", F.lit(country), of(actor, F.when(F.length(bare) > 0, letters).otherwise(F.lit("XXX"))), of(platform, F.upper(F.substring(F.col(platform), 1, 1))))
    out = running_number(df.withColumn("__bare", bare).withColumn("__code", code), "__code", order)
    return out.withColumn("entry_ID", F.concat_ws("-", "__code", F.col("__number").cast("string"))).drop("__bare", "__code", "__number")


def running_number(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``__number`` of each row among those of equal ``by``, in order; rows of a frequent value are spread over many tasks.

    Rows are dealt by ranges of (by, order) and written, so that numbers inside a part and the counts of the parts before fit together.
    """
    parts = written(df.repartitionByRange(F.col(by), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("__part", by).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part", by).orderBy(*order))
    return parts.withColumn("__inside", inside).join(before, ["__part", by]).withColumn("__number", F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def unioned(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all platforms with ``platform``; keys that a platform lacks are null."""
    frames = [df.withColumn("platform", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def chat_columns(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores; null strings become empty for assembly."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return out.fillna("", [c for c, kind in out.dtypes if kind == "string"])


def cleaned_categories(c: Column) -> Column:
    """Strings that mean something; null if there are none."""
    return filled_list(F.filter(meaningful(c), lambda x: ~F.lower(x).isin("none", "null", "nothing else")))


#: Old and new names of forum columns, and columns that never hold anything.
FORUM_NAMES = {"categories": "post_categories", "external_links": "links_in_text"}
FORUM_DEAD = ("embedded_media_links", "image_links", "other_items", "post_HTML")


def forum_columns(df: DataFrame) -> DataFrame:
    """Forum rows under their new names (an old column goes where the new one is there), categories as a list, without dead columns."""
    out = df.drop(*FORUM_DEAD)
    for old, new in FORUM_NAMES.items():
        if old in out.columns:
            out = out.drop(old) if new in out.columns else out.withColumnRenamed(old, new)
    return out.withColumn("post_categories", cleaned_categories(as_list(out, "post_categories")) if "post_categories" in out.columns else F.lit(None).cast("array<string>"))
