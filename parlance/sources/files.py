"""Reading and writing corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What happens to lines that don't parse: the read fails, they are kept aside, they go.
POLICIES = {"reject": "FAILFAST", "keep": "PERMISSIVE", "skip": "DROPMALFORMED"}
#: Platforms by the ending of the file's stem, then by the names of the folders above it.
SUFFIXES = {"_SPIDER": "Website", "_YT": "YouTube", "_MANUAL": "Website", "_archive": "Telegram"}
FOLDERS = {"flashback": "Flashback", "websites": "Website", "website": "Website", "youtube": "YouTube", "telegram": "Telegram"}
STAMP = r"(\d{4})_(\d{2})_(\d{2})"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, policy: str = "reject") -> DataFrame:
    """Lines of JSON in an explicit schema; with ``keep`` the schema may name ``_corrupt_record`` for lines that don't parse."""
    return spark.read.schema(schema).option("mode", POLICIES[policy]).json(path)


def count_valid(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter("try_parse_json(value) is not null").count()


def read_chat(spark: SparkSession, posts: str, replies: str | None, post_schema: T.StructType | str, reply_schema: T.StructType | str) -> tuple[DataFrame, DataFrame | None]:
    """Posts and replies from files separated by semicolons; no replies if their file isn't named or isn't there.

    Lines with more fields than the header are bad and go, fields that a shorter line lacks are null, and so are empty ones. Quoted
    fields may hold semicolons, doubled quotes and line breaks.
    """

    def read(path: str, schema: T.StructType | str) -> DataFrame:
        named = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        whole = T.StructType([*named.fields, T.StructField("__odd", T.StringType())])
        rows = spark.read.schema(whole).csv(path, sep=";", header=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__odd", escape='"', emptyValue="")
        fields = F.regexp_count(F.regexp_replace("__odd", r'"(?:[^"]|"")*"', ""), F.lit(";")) + 1
        blank = lambda f: F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType == T.StringType() else F.col(f"`{f.name}`")
        return rows.filter(F.col("__odd").isNull() | (fields <= len(named.fields))).select(*map(blank, named.fields))

    return read(posts, post_schema), read(replies, reply_schema) if replies and there(spark, replies) else None


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any that its pattern names, exists."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place))


def platform_of(path: Column) -> Column:
    """Platform of a file by its name, else by the two folders above it (the forum beats the websites it stands among); null if unknown."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    parent, grand = (F.lower(F.element_at(F.split(path, "/"), -k)) for k in (2, 3))
    by_name = F.coalesce(*[F.when(stem.contains(s), F.lit(p)) for s, p in SUFFIXES.items()])
    by_folder = F.coalesce(*[F.when((parent == f) | (grand == f), F.lit(p)) for f, p in FOLDERS.items()])
    return F.when(by_folder == "Flashback", F.lit("Flashback")).otherwise(F.coalesce(by_name, by_folder))


def latest_snapshots(files: DataFrame) -> DataFrame:
    """Of each folder and kind (name without date) the newest file: dated before undated, then date, time of change, name.

    ``files`` has ``path`` and, optionally, ``modified``.
    """
    rows = files if "modified" in files.columns else files.withColumn("modified", F.lit(None).cast("timestamp"))
    stamp = F.regexp_extract("path", STAMP, 0)
    rows = rows.withColumn("__dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("__kind", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"_?" + STAMP, "")).withColumn("__stamp", F.nullif(stamp, F.lit("")))
    w = Window.partitionBy("__dir", "__kind").orderBy(F.col("__stamp").isNull(), F.desc("__stamp"), F.col("modified").desc_nulls_last(), F.desc("path"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*files.columns)


def folder_report(files: DataFrame) -> DataFrame:
    """Folders with more than one file or platform."""
    rows = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("platform", platform_of(F.col("path")))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("platform")).alias("platforms")).filter("files > 1 or size(platforms) > 1")


def unprocessed_folders(folders: DataFrame, processed: DataFrame, ignored: tuple[str, ...] = ("m4a_files", "transcribed", "memberlists")) -> DataFrame:
    left = folders
    for end in ignored:
        left = left.filter(~F.col("dir").endswith(end))
    return left.join(processed.select("dir").distinct(), "dir", "left_anti")


def read_all(readers: dict[str, callable]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Each source's frame; a source whose read fails is listed with its error, the others go on."""
    good, failed = {}, []
    for name, read in readers.items():
        try:
            good[name] = read()
        except Exception as error:  # one source's failure must not stop the others
            failed.append((name, str(error).splitlines()[0]))
    return good, failed


def read_logged(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of all sources with ``source_name``, and per source the lines that don't parse: how many, and the first of them.

    Nothing is read before an action, so failures are a table of their own and stop no other source.
    """
    lines = None
    for name, path in paths.items():
        one = spark.read.text(path).filter("trim(value) <> ''").withColumn("source_name", F.lit(name))
        lines = one if lines is None else lines.unionByName(one)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", whole, {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    failed = parsed.filter(bad).groupBy("source_name").agg(F.count("*").alias("n_lines"), F.min("value").alias("example"))
    return parsed.filter(~bad).select("source_name", *[F.col(f"r.`{f.name}`") for f in schema.fields]), failed


def routed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of chats and paths of all other platforms, which are loaded apart."""
    chat = F.coalesce(platform_of(F.col("path")) == "Telegram", F.lit(False))
    return files.filter(chat), files.filter(~chat)


def path_metadata(path: Column, methods: dict[str, str]) -> dict[str, Column]:
    """Country (third folder from the end) and platform (by the method's code in the second) of a file."""
    parts = F.split(path, "/")
    codes = F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])
    return {"country": F.try_element_at(parts, F.lit(-3)), "platform": F.try_element_at(codes, F.try_element_at(parts, F.lit(-2)))}


def dataset_paths(spark: SparkSession, root: str, pattern: str, excluded: list[str] = ()) -> DataFrame:
    """Files under a folder by name, without the excluded ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("modificationTime").alias("modified"))
    return files.filter(~F.element_at(F.split("path", "/"), -1).isin(*excluded)) if excluded else files


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``theme, pattern``: trimmed, in lower case, without blanks, from ``{theme: [pattern, ...]}``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("value"))
    each = rows.select(F.explode("value").alias("theme", "patterns")).select("theme", F.explode("patterns").alias("pattern"))
    return each.select("theme", F.lower(F.trim("pattern")).alias("pattern")).filter("pattern <> ''")


def literal_list(text: str) -> list[str]:
    """A comma-separated list."""
    return [w.strip() for w in text.split(",") if w.strip()]


def dictionary_report(terms: DataFrame, wrong: DataFrame) -> DataFrame:
    """Per theme the terms and the false positives, each joined."""
    joined = lambda df, name: df.groupBy("theme").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ", ").alias(name))
    return joined(terms, "terms").join(joined(wrong, "false_positives"), "theme", "left").fillna("", ["false_positives"])


def write(df: DataFrame, path: str, kind: str = "json", by: list[str] = (), replace: bool = True) -> None:
    """A partitioned data set; only the partitions that occur are replaced."""
    writer = df.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def write_objects(df: DataFrame, path: str, by: list[str], value: str, replace: bool = True) -> None:
    """One file for each group of ``by``, which holds its JSON object ``value``."""
    rows = df.select(*by, F.col(value).alias("value")).repartition(*by)
    rows.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects that ``write_objects`` wrote, as rows ``key, value`` beside their groups."""
    rows = spark.read.text(path, wholetext=True)
    groups = [c for c in rows.columns if c != "value"]
    return rows.select(*groups, F.explode(F.from_json("value", f"map<string,{schema}>")).alias("key", "value"))


def dump_by_month(df: DataFrame, path: str, actor: str, date: str, text: str) -> None:
    """Texts under actor, year and month, without a date under ``no_date``; names made safe for folders."""
    safe = F.regexp_replace(F.coalesce(F.col(actor), F.lit("unknown")), r"[^\p{L}\p{N}_-]+", "_")
    rows = df.select(safe.alias("actor"), F.coalesce(F.year(date).cast("string"), F.lit("no_date")).alias("year"), F.coalesce(F.lpad(F.month(date).cast("string"), 2, "0"), F.lit("no_date")).alias("month"), F.col(text).alias("value"))
    rows.write.mode("overwrite").partitionBy("actor", "year", "month").text(path)
