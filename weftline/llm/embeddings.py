"""Embedding near-dedup with an inverted multi-index.

Equal vectors of a label are one class (a vector held by a third of all rows is one
row from then on). Two codebooks, one per half of the unit vector, are fitted by
k-means on a bounded sample of ``SAMPLE`` classes; their product is a grid of cells.
Every class lies in the cell of its nearest centroids and visits the cells that a
multi-sequence traversal meets first: cells in order of the sum of the two halves'
distances. How many is set on the sample, so that ``TARGET`` of its linked pairs (or,
with fewer than 200 of these, of made-up pairs at the threshold) are met. Candidates
are verified by exact cosine in double precision.

A cell's members and visitors are dealt into blocks of bounded size, so a dense cell
is many tasks. A block gives, per class, its number of linked vectors and the least
class of its local component, never the pairs. A pair met from one side only counts
for both.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors without a label; they are their own component. Vectors of
different length do not link. Equal rows link with each other (their cosine is 1).
A null vec_id gets a null component and is not kept, but counts as a link of others.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, ship, table

COSINE = 0.93
SAMPLE = 20_000
TARGET = 0.9999
MEMBERS, VISITORS = 1024, 4096
#: classes that a cell of a label should hold
FILL = 8


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of points; empty clusters keep their centroid."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[s : s + 1024], centres).argmin(axis=1) for s in range(0, len(x), 1024)])
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


class Grid:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, unit: np.ndarray, group: np.ndarray, k: int, cosine: float, target: float):
        self.half = max(1, unit.shape[1] // 2)
        k = max(1, min(k, len(unit) // 4 or 1))
        self.books = [kmeans(self._part(unit, h), k) for h in (0, 1)]
        self.k = k
        self.visits = self._enough(unit, group, cosine, target)

    def _part(self, x: np.ndarray, h: int) -> np.ndarray:
        return x[:, : self.half] if h == 0 else x[:, self.half :]

    def _far(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(self._part(unit, 0), self.books[0]), distances(self._part(unit, 1), self.books[1])

    def _enough(self, unit: np.ndarray, group: np.ndarray, cosine: float, target: float) -> int:
        asked = np.arange(min(len(unit), 2000))
        pairs = [(i, j) for i in asked for j in np.flatnonzero((unit @ unit[i] >= cosine) & (group == group[i])) if i != j]
        if len(pairs) >= 200:
            a, b = unit[[p[0] for p in pairs]], unit[[p[1] for p in pairs]]
        else:
            a = unit[asked]
            noise = np.random.default_rng(11).normal(size=a.shape)
            noise -= (noise * a).sum(axis=1, keepdims=True) * a
            b = cosine * a + np.sqrt(1 - cosine**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        ranks = []
        for s in range(0, len(a), 256):
            far, home = self._far(a[s : s + 256]), self._far(b[s : s + 256])
            each = np.arange(len(far[0]))
            own = far[0][each, home[0].argmin(axis=1)] + far[1][each, home[1].argmin(axis=1)]
            # cells nearer than the own one: for each centroid of one half, those of the other below what is left
            for first, second, limit in zip(far[0], np.sort(far[1], axis=1), own, strict=True):
                ranks.append(np.searchsorted(second, limit - first).sum())
        return int(np.quantile(np.array(ranks), target, method="higher")) + 2

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, visited cells in traversal order) of each vector.

        With both halves' centroids in order of distance, the cell (i, j) comes after the
        (i + 1) (j + 1) cells up to it, so the first v cells of the traversal are among
        those with (i + 1) (j + 1) <= v: about v log v of the v * v.
        """
        far = self._far(unit)
        v = min(self.visits, self.k * self.k)
        first = [np.argsort(f, axis=1, kind="stable")[:, : min(v, self.k)] for f in far]
        near = [np.take_along_axis(f, o, 1) for f, o in zip(far, first, strict=True)]
        width = first[0].shape[1]
        js = [np.arange(min(width, v // (i + 1))) for i in range(width)]
        i, j = np.repeat(np.arange(width), [len(x) for x in js]), np.concatenate(js)
        seen = np.empty((len(unit), v), np.int64)
        step = max(1, (1 << 22) // len(i))
        for s in range(0, len(unit), step):
            part = slice(s, s + step)
            order = np.argsort(near[0][part][:, i] + near[1][part][:, j], axis=1, kind="stable")[:, :v]
            seen[part] = np.take_along_axis(first[0][part], i[order], 1) * self.k + np.take_along_axis(first[1][part], j[order], 1)
        return first[0][:, 0] * self.k + first[1][:, 0], seen


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v.values.to_numpy(zero_copy_only=False)
    return out


def valid_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that can link."""
    own = rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0.0))


def _block(width: int, cosine: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        members, visitors = block[block["member"]], block[~block["member"]]
        if members.empty or visitors.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

        def vectors(part: pd.DataFrame) -> np.ndarray:
            x = np.zeros((len(part), width))
            for i, v in enumerate(part["vector"]):
                x[i, : len(v)] = v
            return x / np.abs(x).max(axis=1, keepdims=True)  # the scale does not matter, and squares stay finite

        h, v = vectors(members), vectors(visitors)
        close = v @ h.T / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(h, axis=1)[None, :]) >= cosine
        hid, vid = members["cid"].to_numpy(), visitors["cid"].to_numpy()
        close &= vid[:, None] != hid[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        hn, vn, home = members["n"].to_numpy(), visitors["n"].to_numpy(), visitors["home"].to_numpy()
        # whether the member has visited the visitor's home, as (member, cell) codes
        sizes = members["seen"].str.len().to_numpy()
        cells = np.concatenate(members["seen"].to_list()).astype(np.int64)
        span = int(max(cells.max(), home.max())) + 1
        one_sided = ~np.isin(j * span + home[i], np.repeat(np.arange(len(sizes)), sizes) * span + cells)
        nodes = np.concatenate([vid[i], hid[j[one_sided]]])
        links = np.concatenate([hn[j], vn[i[one_sided]]])
        names, at = np.unique(np.concatenate([vid[i], hid[j]]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        root = np.arange(len(names))
        while True:
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        which, inverse = np.unique(nodes, return_inverse=True)
        counted = dict(zip(which.tolist(), np.bincount(inverse, links).astype(np.int64).tolist(), strict=True))
        return pd.DataFrame({"node": names, "links": [counted.get(x, 0) for x in names.tolist()], "root": names[root]}).astype("int64")

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, label."""
    spark = rows.sparkSession
    ship(spark)
    own = rows.select("vec_id", F.col("label"), "embedding")
    valid = valid_rows(own)
    # a class is known by two hashes, so that rows are joined to it without their vectors
    key = [F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit(1), "vector", "label").alias("k2")]
    classes = valid.select("*", *key).groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("grp", F.xxhash64("label", F.size("vector"))).withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(classes, "emb-classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.countDistinct("grp").alias("groups")).first()
    if size["n"]:
        found = _linked(classes, size["n"], size["width"], size["groups"], cosine, target, sample)
        roots = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), "emb")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        classes = classes.join(links, classes["cid"] == links["node"], "left").drop("node").join(roots, F.col("cid") == roots["node"], "left")
        classes = classes.select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
        classes = materialise(classes, "emb-rooted")
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = classes.join(least, "root").select("k1", "k2", "n_links", "component_id")
        valid = valid.select("vec_id", "label", *key).join(classes, ["k1", "k2"])
        valid = valid.select("vec_id", "label", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    else:
        valid = valid.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) | ~F.coalesce(F.exists(vector, lambda x: F.coalesce(x != 0.0, F.lit(False))), F.lit(False))
    alone = own.where(F.col("label").isNull() | F.col("embedding").isNull() | bad).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = valid.unionByName(alone)
    return every.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "label")


def _linked(classes: DataFrame, n: int, width: int, groups: int, cosine: float, target: float, sample: int) -> DataFrame:
    """(node, links, root) rows of the blocks, written."""
    spark = classes.sparkSession
    taken = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vector", "grp").toArrow()
    unit = _matrix(taken.column("vector").combine_chunks(), width)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    grid = Grid(unit, taken.column("grp").to_numpy(), int(np.sqrt(n / (groups * FILL))) or 1, cosine, target)
    shared = spark.sparkContext.broadcast(grid)  # at most sample / 4 centroids a half

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for s in range(0, len(x), 1024):
                home, seen = shared.value.cells(x[s : s + 1024])
                part = batch.slice(s, 1024)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cid", "n", "grp", "vector")), pa.array(home.astype(np.int32)), pa.array(list(seen.astype(np.int32)), pa.list_(pa.int32()))], ["cid", "n", "grp", "vector", "home", "seen"])

    cells = materialise(classes.select("cid", "n", "grp", "vector").mapInArrow(placed, "cid bigint, n bigint, grp bigint, vector array<double>, home int, seen array<int>"), "emb-cells")
    # every class has visited its own cell last if the traversal did not meet it
    seen = F.when(F.array_contains("seen", F.col("home")), F.col("seen")).otherwise(F.concat("seen", F.array("home")))
    visits = cells.select("cid", "grp", F.explode(seen).alias("cell"))
    members = cells.groupBy("grp", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("ms"))
    counts = visits.join(members, ["grp", "cell"]).groupBy("grp", "cell", "ms").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("vs"))
    counts = materialise(counts, "emb-counts")
    m = cells.withColumn("cell", F.col("home")).join(counts, ["grp", "cell"])
    m = m.withColumn("mb", F.pmod(F.xxhash64("cid"), F.col("ms")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).withColumn("member", F.lit(True))
    v = cells.withColumn("cell", F.explode(seen)).join(counts, ["grp", "cell"])
    v = v.withColumn("vb", F.pmod(F.xxhash64("cid"), F.col("vs")).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("ms") - 1))).withColumn("member", F.lit(False))
    columns = ["grp", "cell", "mb", "vb", "member", "cid", "n", "home", "vector"]
    both = m.select(*columns, seen.alias("seen")).unionByName(v.select(*columns, F.array().cast("array<int>").alias("seen")))
    return materialise(both.groupBy("grp", "cell", "mb", "vb").applyInPandas(_block(width, cosine), "node long, links long, root long"), "emb-linked")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
