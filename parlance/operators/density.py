"""Density clusters of exact neighbours, without a row for each pair of neighbours.

Equal vectors are one point with a weight. A grid whose cells are no wider than ``epsilon`` across tells dense cells: all points
of one that holds ``min_samples`` are core and in one cluster, whatever stands around them, and nobody counts their neighbours.
Other points count theirs block by block: a matrix product in single precision tells pairs that are surely nearer or farther than
``epsilon``, the few between are measured. A block holds whole cells of near points as far as it can, and a pair of blocks meets only
if a point of one may have neighbours in the other. Clusters are joined group by group, where a group is a dense cell or a single core
point: two groups whose first points are near are linked at once, and only points of groups that are still apart are compared.
A pair of blocks hands on no more links than it has groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.shared import dropped, written

#: Most pivots that split the space, and rows and numbers of a block of points that is compared with another.
PIVOTS, BLOCK_ROWS, BLOCK_VALUES = 256, 1 << 15, 1 << 21
#: Blocks that there are at least if each has ``LEAST_ROWS`` rows, so that a few cores have work.
LEAST_BLOCKS, LEAST_ROWS = 8, 1000
#: Rows and columns of a matrix of pairs that is looked at at once, and pairs that are measured at once.
TILE_ROWS, TILE_COLUMNS, MEASURED = 512, 512, 1 << 15


def rows_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return np.asarray(flat, np.float64).reshape(len(vectors), len(flat) // max(1, len(vectors)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, some rows of ``x`` at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.sqrt(((x[lo : lo + step, None, :] - y[None, :, :]) ** 2).sum(2))
    return out


def near(x: np.ndarray, y: np.ndarray, epsilon: float, skip: Callable[[slice, slice], bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of ``x`` and ``y`` that are ``epsilon`` apart at most, tile by tile; tiles that ``skip`` names are not looked at.

    A product of rows (-2x, x.x, 1) and (y, 1, y.y), taken from one middle and in units of epsilon, is the squared distance up to a known error.
    """
    if not len(x) or not len(y):
        return
    with np.errstate(all="ignore"):  # what overflows is not a number and is measured
        middle, unit, slack = x.mean(0), epsilon if epsilon > 0 else 1.0, (x.shape[1] + 16) * 2.0**-22
        u, v = (x - middle) / unit, (y - middle) / unit
        p, q = (u * u).sum(1), (v * v).sum(1)
        a = np.concatenate((-2 * u, (1 - slack) * p[:, None], np.ones((len(u), 1))), 1).astype(np.float32)
        b = np.concatenate((v, np.ones((len(v), 1)), (1 - slack) * q[:, None]), 1).astype(np.float32)
        most = np.float32(1 if epsilon > 0 else 0)
        for lo in range(0, len(x), TILE_ROWS):
            for to in range(0, len(y), TILE_COLUMNS):
                i, j = slice(lo, min(lo + TILE_ROWS, len(x))), slice(to, min(to + TILE_COLUMNS, len(y)))
                if skip is not None and skip(i, j):
                    continue
                least = a[i] @ b[j].T
                m, n = np.nonzero(~(least > most))
                if not len(m):
                    continue
                found = least[m, n] <= most - 2 * slack * (p[i].max() + q[j].max())
                m, n, unsure = m + lo, n + to, np.flatnonzero(~found)
                for k in range(0, len(unsure), MEASURED):
                    part = unsure[k : k + MEASURED]
                    found[part] = np.sqrt(((x[m[part]] - y[n[part]]) ** 2).sum(1)) <= epsilon
                yield m[found], n[found]


def _keyed(points: DataFrame, epsilon: float) -> DataFrame:
    """``id, v, key, grid``: a digest of the vector and of its cell of the grid, null where a number is not finite."""

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.blake2b(x.tobytes(), digest_size=16).digest()
        width = lambda v: epsilon * (1 - 1e-9) / math.sqrt(max(1, len(v)))
        for batch in batches:
            rows = [np.asarray(v, np.float64) + 0.0 for v in batch.column("v").to_pylist()]  # one zero
            finite = [bool(np.isfinite(v).all()) for v in rows]
            keys = [digest(v) if ok else None for v, ok in zip(rows, finite, strict=True)]
            grid = [digest(np.floor(v / width(v))) if ok else None for v, ok in zip(rows, finite, strict=True)] if epsilon > 0 else keys
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(keys, pa.binary()), pa.array(grid, pa.binary())], names=["id", "v", "key", "grid"])

    return points.mapInArrow(stamp, "id long, v array<double>, key binary, grid binary")


class _Space:
    """Points by their nearest pivot, and the cells that may hold their neighbours: by the triangle inequality those whose pivot is no further than the cell's radius and ``epsilon``."""

    def __init__(self, points: DataFrame, epsilon: float):
        n = points.count()
        chosen = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, math.isqrt(n)))).select("v").collect()  # PIVOTS rows at most
        self.pivots = np.array([r["v"] for r in chosen], np.float64)
        far = self._mapped(points, lambda apart: [pa.array(apart.argmin(1)), pa.array(apart.min(1))], "cell long, far double")
        self.reach, held = np.full(len(self.pivots), -1.0), np.zeros(len(self.pivots), np.int64)
        for r in far.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect():  # one row for each pivot
            self.reach[r["cell"]], held[r["cell"]] = r["radius"] + epsilon * (1 + 1e-9) + 1e-12, r["n"]
        rows = max(1, min(BLOCK_ROWS, max(LEAST_ROWS, n // LEAST_BLOCKS), BLOCK_VALUES // max(1, self.pivots.shape[1])))
        # cells in the order of their distance from the first pivot fill blocks; a cell of more rows has blocks of its own
        self.first, self.parts, block, filled = np.zeros(len(held), np.int64), np.maximum(1, -(-held // rows)), 0, 0
        for c in np.argsort(distances(self.pivots, self.pivots[:1])[:, 0], kind="stable"):
            if filled and filled + held[c] > rows:
                block, filled = block + 1, 0
            self.first[c] = block
            block, filled = (block + self.parts[c], 0) if self.parts[c] > 1 else (block, filled + held[c])

    def _mapped(self, points: DataFrame, f, more: str) -> DataFrame:
        pivots, names = self.pivots, [x.split()[0] for x in more.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(lo, TILE_ROWS)
                    yield pa.record_batch([*part.columns, *f(distances(rows_of(part.column("v")), pivots))], names=[*part.schema.names, *names])

        return points.mapInArrow(run, ", ".join([*[f"{c} {kind}" for c, kind in points.dtypes], more]))

    def placed(self, points: DataFrame) -> DataFrame:
        """With the ``block`` of each point and the blocks ``visited`` that may hold its neighbours."""
        reach, first, parts = self.reach, self.first, self.parts

        def visits(apart: np.ndarray) -> list[pa.Array]:
            cells = [np.flatnonzero(row <= reach) for row in apart]
            return [pa.array(apart.argmin(1)), pa.array([np.unique(np.concatenate([first[c][parts[c] == 1], *[first[k] + np.arange(parts[k]) for k in c[parts[c] > 1]]])) for c in cells], pa.list_(pa.int64()))]

        numbers = lambda x: F.array(*[F.lit(int(k)) for k in x])
        at = F.col("cell").cast("int")
        own = F.get(numbers(first), at) + F.pmod(F.xxhash64("id"), F.get(numbers(parts), at))
        return self._mapped(points, visits, "cell long, visited array<bigint>").withColumn("block", own.cast("long")).drop("cell")

    @staticmethod
    def compared(home: DataFrame, guests: DataFrame, compare, schema: str) -> DataFrame:
        """``compare`` of each block of ``home`` points with each block of ``guests``, both as ``placed``, that has a visitor there."""
        right = guests.withColumn("i", F.explode("visited")).withColumn("j", F.col("block")).drop("visited", "block")
        met = right.groupBy("i").agg(F.collect_set("j").alias("met")).withColumnRenamed("i", "of")  # a row for each block
        left = home.join(met, F.col("block") == F.col("of")).withColumnRenamed("of", "i").withColumn("j", F.explode("met")).drop("visited", "block", "met")
        left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides may be of one table
        empty = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")]).empty_table()
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(lambda a, b: compare(a, b) if a.num_rows and b.num_rows else empty, schema)


def _joined(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number reachable from each of ``size`` numbers over the links (i, j)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _linked(home: pa.Table, guests: pa.Table, epsilon: float) -> pa.Table:
    """Rows (kind, a, b): ``link`` from a group to the least one it is joined with here, ``border`` from a point that isn't core to a group it is near."""
    x, y = rows_of(home["v"]), rows_of(guests["v"])
    own = home["core"].to_numpy()
    is_core = guests["core"].is_valid().to_numpy(zero_copy_only=False)
    theirs = guests["core"].fill_null(0).to_numpy()[is_core]
    groups = np.unique(np.concatenate((own, theirs)))
    label = np.arange(len(groups))
    if is_core.any():
        z, several = y[is_core], lambda c: np.bincount(c, minlength=len(groups))[c] > 1
        a, b = np.searchsorted(groups, own), np.searchsorted(groups, theirs)
        firsts = lambda c: np.sort(np.unique(c, return_index=True)[1])
        everything = np.arange(len(a)), np.arange(len(b))
        # first points of all groups, then what groups of several points have besides
        for r, c in ((firsts(a), firsts(b)), (everything[0][several(a)], everything[1]), (everything[0][~several(a)], everything[1][several(b)])):
            r, c = r[np.argsort(label[a[r]], kind="stable")], c[np.argsort(label[b[c]], kind="stable")]

            def together(i: slice, j: slice, r=r, c=c) -> bool:
                mine, other = label[a[r[i]]], label[b[c[j]]]
                return bool((mine == mine[0]).all() and (other == mine[0]).all())

            for m, n in near(x[r], z[c], epsilon, together):
                mine, other = a[r[m]], b[c[n]]
                if (label[mine] != label[other]).any():
                    label = _joined(len(groups), np.concatenate((np.arange(len(groups)), mine)), np.concatenate((label, other)))
    moved = np.flatnonzero(label != np.arange(len(groups)))
    ids, outside = guests["id"].to_numpy()[~is_core], y[~is_core]
    border = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *[np.stack((ids[n], own[m]), 1) for m, n in near(x, outside, epsilon)]]), axis=0)
    kinds = ["link"] * len(moved) + ["border"] * len(border)
    return pa.table({"kind": pa.array(kinds, pa.string()), "a": pa.array(np.concatenate((groups[moved], border[:, 0])), pa.int64()), "b": pa.array(np.concatenate((groups[label[moved]], border[:, 1])), pa.int64())})


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label``: the least node reachable. Each round takes over the least label next to a node, and that label's own."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").limit(1).count():
        lower = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        stepped = labels.join(lower, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", F.coalesce("least", "label")).alias("least"))
        jumped = stepped.join(stepped.select(F.col("id").alias("least"), F.col("least").alias("next")), "least", "left").select("id", F.least("least", F.coalesce("next", "least")).alias("now"), "label")
        used, labels = labels, written(jumped.select("id", F.col("now").alias("label"), (F.col("now") < F.col("label")).alias("moved")), "labels")
        dropped(used)
    dropped(edges)
    return labels.drop("moved")


def density_clusters(df: DataFrame, id_col: str, vector: str = "embedding", epsilon: float = 0.5, min_samples: int = 5, min_cluster_size: int = 5) -> DataFrame:
    """Clusters of points that are dense at ``epsilon``; noise is -1, rows without a vector or id are left out.

    Core are points with ``min_samples`` points at most ``epsilon`` away, themselves counted; core points that near are of one
    cluster, and border points follow their least core neighbour's. Clusters are numbered in the order of their least core point.
    Vectors with numbers that are not finite are noise.
    """
    points = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    keyed = _keyed(points, epsilon)
    single = written(keyed.filter("key is not null").groupBy("key").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id"), F.count("*").alias("w"), F.first("grid").alias("grid")), "single")
    if not single.limit(1).count():
        return points.select(F.col("id").alias(id_col), F.lit(-1).alias("cluster"))
    cells = single.groupBy("grid").agg(F.sum("w").alias("held"), F.min("id").alias("first"))
    placed = written(single.join(cells, "grid").select("id", "v", "w", F.when(F.col("held") >= min_samples, F.col("first")).alias("dense")), "placed")
    space = _Space(placed, epsilon)
    placed = written(space.placed(placed), "placed")

    def count(home: pa.Table, guests: pa.Table) -> pa.Table:
        weight, n = home["w"].to_numpy(), np.zeros(guests.num_rows, np.int64)
        for i, j in near(rows_of(home["v"]), rows_of(guests["v"]), epsilon):
            np.add.at(n, j, weight[i])
        return pa.table({"id": guests["id"].to_numpy()[n > 0], "n": n[n > 0]})

    ways = ["visited", "block"]
    neighbours = space.compared(placed.select("id", "v", "w", *ways), placed.filter("dense is null").select("id", "v", *ways), count, "id long, n long")
    enough = neighbours.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("id", F.lit(True).alias("enough"))
    cored = written(placed.join(enough, "id", "left").select("id", "v", F.coalesce("dense", F.when(F.col("enough"), F.col("id"))).alias("core"), *ways), "cored")
    met = written(space.compared(cored.filter("core is not null"), cored, lambda a, b: _linked(a, b, epsilon), "kind string, a long, b long"), "met")
    labels = _components(cored.filter("core is not null").select(F.col("core").alias("id")).distinct(), met.filter("kind = 'link'"))
    border = met.filter("kind = 'border'").join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("border"))
    own = cored.select("id", "core").join(labels.withColumnRenamed("id", "core"), "core", "left").join(border, "id", "left").select("id", F.coalesce("label", "border").alias("label"))
    of_key = single.select("key", F.col("id").alias("of")).join(own.withColumnRenamed("id", "of"), "of").select("key", "label")
    named = keyed.select("id", "key").join(of_key, "key", "left").select("id", "label")
    sizes = named.filter("label is not null").groupBy("label").count().filter(F.col("count") >= min_cluster_size)
    numbers = sizes.withColumn("cluster", F.row_number().over(Window.orderBy("label")) - 1)
    return named.join(numbers.select("label", "cluster"), "label", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
