"""Vectors of chunks and actors: pooling, projection, clusters and the map."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.density import density_clusters
from parlance.operators.intervals import inside_boxes

__all__ = ["density_clusters"]


def hashed(word: str, size: int) -> tuple[int, int]:
    """Place and sign of a word, by the digits of its MD5."""
    digits = hashlib.md5(word.encode()).hexdigest()
    return int(digits[:7], 16) % size, 1 if int(digits[7], 16) % 2 == 0 else -1


#: Words that a task looks at together, unless one text has more.
TOGETHER = 1 << 16


def _placed(column: pa.ListArray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row of each part of lists of words, then of each of its words the row in the part, the place and the sign.

    Only the different words of a part become Python strings, and nothing is kept for the next one, so memory has a bound.
    """
    ends, lo = column.value_lengths().to_numpy().cumsum(), 0
    while lo < len(column):
        held = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, held + TOGETHER, "right")))
        part = column.slice(lo, hi - lo)
        coded = part.flatten().dictionary_encode()
        places = np.array([hashed(w, size) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
        yield lo, hi, np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy()), places[:, 0], places[:, 1]
        lo = hi


def text_vectors(df: DataFrame, text_col: str = "chunk", size: int = 256) -> DataFrame:
    """Rows with ``embedding``: signed counts of hashed words times the logarithm of their places' rarity, at length 1; another embedder can take this place.

    Words share ``size`` places, so the number of texts that use a place is a table of fixed size, however many words there are. A
    text without words (null too) has a vector of zeros.
    """
    worded = df.withColumn("__words", F.expr(f"regexp_extract_all(lower(coalesce({text_col}, '')), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)"))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = 0, np.zeros(size, np.int64)
        for batch in batches:
            for _, _, row, place, _ in _placed(batch.column(0), size):
                held += np.bincount(np.unique(row * size + place) % size, minlength=size)
            texts += batch.num_rows
        yield pa.record_batch([pa.array([*range(size), size]), pa.array([*held.tolist(), texts])], names=["place", "texts"])

    counts = {r["place"]: r["texts"] for r in worded.select("__words").mapInArrow(used, "place long, texts long").groupBy("place").agg(F.sum("texts").alias("texts")).collect()}  # size + 1 rows
    rarity = np.log((counts.get(size, 0) + 1) / (np.array([counts.get(b, 0) for b in range(size)]) + 1))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, place, sign in _placed(batch.column(batch.num_columns - 1), size):
                out = np.bincount(row * size + place, weights=sign, minlength=(hi - lo) * size).reshape(hi - lo, size) * rarity
                length = np.sqrt((out**2).sum(1, keepdims=True))
                out /= np.where(length > 0, length, 1)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * size, pa.int32()), pa.array(out.ravel()))
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns[:-1], vectors], names=[*batch.schema.names[:-1], "embedding"])

    return worded.mapInArrow(embed, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each actor at length 1 (a zero mean stays zero)."""
    means = df.filter(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return out.withColumn("centroid", F.when(norm(F.col("centroid")) > 0, F.expr("transform(centroid, x -> x / __n)".replace("__n", "sqrt(aggregate(centroid, 0D, (a, y) -> a + y * y))"))).otherwise(F.col("centroid")))


#: Steps of the orthogonal iteration.
STEPS = 100


def covariance(df: DataFrame, vector: str) -> np.ndarray:
    """Of the positions of all vectors. Every task adds up products of its own rows; what is collected has a row for each position, whatever the number of vectors."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.append(np.asarray(v, np.float64), 1.0) for v in batch.column(0).to_pylist()])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"i": group["i"][:1], "row": pa.array([np.sum(group["row"].to_pylist(), axis=0)], pa.list_(pa.float64()))})

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(products, "i long, row array<double>")
    found = rows.groupBy("i").applyInArrow(added, "i long, row array<double>").orderBy("i").collect()
    if not found:
        return np.zeros((0, 0))
    total = np.array([r["row"] for r in found])
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    return total[:-1, :-1] / n - np.outer(mean, mean)


def components(matrix: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The two leading directions of a symmetric matrix by orthogonal iteration from fixed vectors, so that their signs are fixed too."""
    d = len(matrix)
    a = 1.0 / np.arange(1, d + 1)
    b = a * np.where(np.arange(d) % 2 == 0, 1.0, -1.0)
    unit = lambda v: v / max(np.sqrt(v @ v), 1e-300)
    for _ in range(steps):
        a, b = unit(matrix @ a), matrix @ b
        b = unit(b - (a @ b) * a)
    return np.stack([a, b])


def projected(chunks: DataFrame, others: DataFrame, vector: str = "embedding", other_vector: str = "centroid") -> tuple[DataFrame, DataFrame]:
    """Two coordinates of chunks and, by the same model, of other vectors: principal components of the chunks. Null vectors have none."""
    directions = components(covariance(chunks, vector))

    def place(df: DataFrame, c: str) -> DataFrame:
        along = lambda d: F.aggregate(F.zip_with(F.col(c).cast("array<double>"), F.array(*[F.lit(float(x)) for x in d]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return df.withColumns({"umap_1": along(directions[0]), "umap_2": along(directions[1])})

    return place(chunks, vector), place(others, other_vector)


def region_counts(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points inside each closed rectangle; empty and inverted regions are reported, incomplete ones go, equal ones are one."""
    whole = regions.dropna(subset=["x_lower", "x_upper", "y_lower", "y_upper"]).distinct()
    columns = whole.columns
    held = inside_boxes(points.select("x", "y"), whole).groupBy(*columns).agg(F.count("*").alias("n_points"))
    every = whole.withColumn("n_points", F.lit(0).cast("long")).unionByName(held).groupBy(*columns).agg(F.max("n_points").alias("n_points"))
    return every.withColumn("status", F.when((F.col("x_lower") > F.col("x_upper")) | (F.col("y_lower") > F.col("y_upper")), "invalid").when(F.col("n_points") == 0, "empty").otherwise("ok"))


def merged_actors(points: DataFrame, names: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Actors under their display names, those of one name at their mean place."""
    renamed = points.join(F.broadcast(names), "actor", "left").withColumn("name", F.coalesce("name", "actor")).filter(~F.col("name").isin(*excluded) if excluded else F.lit(True))
    return renamed.groupBy("name").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def display_order(actors: DataFrame, marked: str = "Influencer") -> DataFrame:
    return actors.orderBy(F.col("identifier").startswith(marked), "identifier")


def extent(points: DataFrame, margin: float = 0.1) -> DataFrame:
    """Limits of the map, a tenth wider on each side."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return box.select(*[(F.col(a) + s * margin * (F.col(b) - F.col(c))).alias(n) for n, a, s, b, c in (("x_low", "x0", -1, "x1", "x0"), ("x_high", "x1", 1, "x1", "x0"), ("y_low", "y0", -1, "y1", "y0"), ("y_high", "y1", 1, "y1", "y0"))])


def map_export(points: DataFrame, actors: DataFrame, id_cols: list[str], actor: str = "actor") -> DataFrame:
    """Coordinates of chunks and actors in one table: ``kind``, the keys of chunks (null for actors), actor, place."""
    chunks = points.select(F.lit("chunk").alias("kind"), *id_cols, actor, "umap_1", "umap_2")
    return chunks.unionByName(actors.select(F.lit("actor").alias("kind"), actor, "umap_1", "umap_2"), allowMissingColumns=True)


def nearest_neighbour(points: DataFrame, id_col: str) -> DataFrame:
    """Distance of each actor to the nearest other in the map scaled to the unit square; actors are few, so one side is broadcast."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    unit = points.crossJoin(F.broadcast(box)).select(id_col, ((F.col("x") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))).alias("u"), ((F.col("y") - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0))).alias("w"))
    other = F.broadcast(unit.toDF("other", "ou", "ow"))
    met = unit.join(other, F.col(id_col) != F.col("other")).withColumn("d", F.sqrt((F.col("u") - F.col("ou")) ** 2 + (F.col("w") - F.col("ow")) ** 2))
    return met.groupBy(id_col).agg(F.min("d").alias("distance"))


def of_days(points: DataFrame, chunks: DataFrame, keys: list[str], date: str, start: str, end: str) -> DataFrame:
    """Points whose chunk, by text and number, lies in the inclusive range of days."""
    return points.join(chunks.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(*keys), keys, "left_semi")


def with_parameters(df: DataFrame, parameters: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside the settings of their country and theme, a small table."""
    return df.join(F.broadcast(parameters), by, "left")
