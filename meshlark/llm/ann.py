"""Approximate nearest neighbours by collision counting.

Vectors are normalised and projected on ``PROJECTIONS`` random directions.  A shard of
the rows keeps one sorted array of values for each direction.  A query looks into a
window around its own value in every array; a row collides once for each window that
holds it.  Rows with at least ``threshold`` collisions are verified with the exact
cosine in double precision.  ``SAMPLE`` rows of the shard, verified first, bound the distance
of the k-th neighbour; windows start for a part of it and grow by virtual rehashing
(``WIDEN``) until they are wide enough for the distance of the k-th best verified row,
and never beyond.  Where neighbours are close, few rows are verified; where the vectors
are spread evenly, projections tell near from far rows only faintly, and many are.

Queries are a stated set; they meet the rows in blocks: rows are dealt to shards and
queries to blocks of about ``BLOCK`` each by hash, and each (shard, block) is a task's
group, so a group's memory is bounded whatever the table's size.  The best k of each
group are merged by a grouped top-k.

Defined cases: vectors that are null, zero, empty, of another length than ``dimensions``
(the most frequent length if not given), or that hold null or non-finite components take
no part, as queries or as candidates; a query is never its own candidate; ties go to the
smaller id; equal vectors all count; rows with the same id are candidates each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS = 96
BLOCK = 8192
SAMPLE = 128
#: Windows reach WIDTH standard deviations of a projected distance to either side; a row at the
#: radius falls into a window with probability 0.68; it needs THRESHOLD of all windows.
WIDTH, THRESHOLD = 1.0, 0.63
#: Rounds of virtual rehashing: first radius, as a part of the sampled bound, and factor.
FIRST, WIDEN = 0.6, 1.25


def directions(d: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, m))


class ProjectionIndex:
    """Sorted projections of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.original = ids[order], vectors[order]
        self.norm = norms(self.original)
        self.axes = directions(vectors.shape[1], m)
        projected = (self.original / self.norm[:, None]) @ self.axes
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(projected, self.order.T, axis=0).T.copy()
        self.m = m
        self.some = np.sort(np.random.default_rng(11).permutation(len(ids))[:SAMPLE])
        self.verified = 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, nearest first."""
        n, length = len(self.ids), norms(query[None])[0]
        at = (query / length) @ self.axes
        counts, seen = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
        lo = np.array([np.searchsorted(self.values[j], at[j]) for j in range(self.m)])
        hi = lo.copy()
        found, cosines = self._verify(self.some, query_id, query, length, np.empty(0, np.int64), np.empty(0), k)
        seen[self.some] = True
        # distance of unit vectors at a cosine c: sqrt(2 - 2 c)
        far = lambda: np.sqrt(max(0.0, 2 - 2 * cosines[-1])) if len(found) == k else 2.0
        radius, need = FIRST * far(), THRESHOLD * self.m
        while not seen.all():
            whole = radius >= 2.0  # fewer than k rows so far: windows take in all
            parts = []
            for j in range(self.m):
                a = 0 if whole else np.searchsorted(self.values[j], at[j] - WIDTH * radius)
                b = n if whole else np.searchsorted(self.values[j], at[j] + WIDTH * radius, side="right")
                parts += [self.order[j, a : lo[j]], self.order[j, hi[j] : b]]
                lo[j], hi[j] = a, b
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            new = np.flatnonzero((counts >= need) & ~seen)
            seen[new] = True
            found, cosines = self._verify(new, query_id, query, length, found, cosines, k)
            if whole or (len(found) == k and far() <= radius):
                break
            radius = min(radius * WIDEN, far())
        self.verified += int(seen.sum())
        return self.ids[found], cosines

    def _verify(self, new: np.ndarray, query_id: int, query: np.ndarray, length: float, found: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of those found and the new rows."""
        new = new[self.ids[new] != query_id]
        if not len(new):
            return found, cosines
        found, cosines = np.concatenate((found, new)), np.concatenate((cosines, cosine(self.original[new], self.norm[new], query, length)))
        best = np.lexsort((self.ids[found], -cosines))[:k]
        return found[best], cosines[best]


def norms(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1)  # so that squares neither overflow nor vanish
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1))


def cosine(rows: np.ndarray, row_norms: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Cosines on the original vectors; each row is summed by itself, so equal rows get equal values."""
    return ((rows / row_norms[:, None]) * (query / length)).sum(axis=1)


def _search(k: int, m: int):
    def run(table: pa.Table) -> pa.Table:
        query = table.column("is_query").to_numpy()
        ids = table.column("id").to_numpy()
        lists = table.column("vector").combine_chunks()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        out: list[tuple[int, int, float]] = []
        if query.any() and not query.all():
            index = ProjectionIndex(ids[~query], vectors[~query], m)
            for i in np.flatnonzero(query):
                near, cosines = index.search(int(ids[i]), vectors[i], k)
                out += [(int(ids[i]), int(a), float(c)) for a, c in zip(near, cosines, strict=True)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, dimensions: int | None = None, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row that satisfies ``queries`` (a condition on the table's columns)."""
    component = F.col("vector")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    good = ~F.exists(component, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(component, lambda x: x != 0)
    own = own.where(good)
    counted = own.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("q")).orderBy(F.desc("n"), "d").collect()  # one row per length
    if dimensions is None:
        dimensions = counted[0]["d"] if counted else 0
    n, q = next(((r["n"], r["q"]) for r in counted if r["d"] == dimensions), (0, 0))
    own = own.where(F.size("vector") == dimensions)
    shards, blocks = max(1, -(-n // block)), max(1, -(-q // block))
    shard = F.pmod(F.xxhash64("id", "vector"), F.lit(shards))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    rows = own.select("id", "vector", F.lit(False).alias("is_query"), shard.alias("shard"), every(blocks).alias("block"))
    asked = own.where("asked").dropDuplicates(["id"]).select("id", "vector", F.lit(True).alias("is_query"), every(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    found = rows.unionByName(asked).groupBy("shard", "block").applyInArrow(_search(k, projections), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

