"""Centroid clustering by ball k-means over integer vectors, exact in every comparison.

A cluster is a ball: its centroid and the largest distance of a member. Only balls whose centroids are nearer
than twice its radius can take members from it (its neighbours). A member nearer to its centroid than half the
way to the nearest neighbour is in the stable core; the others lie in rings, and one between the half ways to
the i-th and the next neighbour is compared with the first i neighbours only.

Vectors and their clusters are a table below the shared folder, written anew each round; a round is one pass
that gives each vector its cluster and, in further rows, each task's sums and radii by cluster. Only those
(k rows a task, added up in Spark) and the k centroids reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import drop_since, mark, materialise

#: Components up to this size are held as doubles: all sums of squared differences stay exact integers.
EXACT = 2**21
#: Components beyond this, far past what a long could give a distance for, count as this; squared distances then fit decimal(38,0).
LIMIT = 2**57
LARGEST = 2**63 - 1
CLUSTERS = "cluster int, n bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
SCHEMA = "vec_id {id}, v array<bigint>, cluster int, distance bigint, number int, n bigint, radius decimal(38,0), inertia decimal(38,0), sums array<decimal(38,0)>"


def integer_vectors(rows: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors with dims components, none null or not finite: floor(scale * x) as longs."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(scale))
        edge = float(LIMIT)
        return F.when(scaled >= edge, F.lit(LIMIT)).when(scaled <= -edge, F.lit(-LIMIT)).otherwise(F.floor(scaled).cast("long"))

    kept = rows.select(F.col(id_col).alias("vec_id"), wide.alias("w")).where((F.size("w") == dims) & fine)
    return kept.select("vec_id", F.transform("w", whole).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of salt:id, in that order; rows of one id by their components."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r["v"] for r in first.collect()], dtype=object)


def suited(values: np.ndarray) -> np.ndarray:
    """Doubles where those are exact, else Python's integers."""
    small = not values.size or (values.max() <= EXACT and values.min() >= -EXACT)
    return values.astype(np.float64 if small else object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    d = x - y
    return (d * d).sum(-1)


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every ball its neighbours and their squared distances, nearest first: those nearer than twice the radius.

    radii are squared. A neighbour at just twice the radius counts, as a tie may go to the smaller number.
    """
    out = []
    for i, c in enumerate(centroids):
        gaps = squared(centroids, c)
        near = np.array([j for j in range(len(centroids)) if j != i and gaps[j] <= 4 * radii[i]], int)
        near = near[np.argsort(gaps[near], kind="stable")]
        out.append((near, gaps[near]))
    return out


class Distances:
    """Squared distances of rows to centroids by their norms and products; every term is a whole number, so exact."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray) -> None:
        self.x, self.centroids = x, centroids
        self.norms, self.theirs = (x * x).sum(1), (centroids * centroids).sum(1)

    def to(self, j: int, rows: np.ndarray) -> np.ndarray:
        return self.norms[rows] + self.theirs[j] - 2 * self.x[rows].dot(self.centroids[j])

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance; ties to the smaller number."""
        every = self.norms[:, None] + self.theirs[None, :] - 2 * self.x.dot(self.centroids.T)
        number = every.argmin(1)
        return number.astype(np.int32), every[np.arange(len(number)), number]

    def from_balls(self, was: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """As nearest(), for rows that were in the balls named in was: the core stays, rings meet their neighbours."""
        number, best = was.astype(np.int32), np.zeros(len(was), self.x.dtype)
        for i in np.unique(was):
            rows = np.flatnonzero(was == i)
            own = self.to(i, rows)
            best[rows] = own
            for j, gap in zip(*near[i]):
                ring = rows[(4 * own >= gap).astype(bool)]  # past half the way to this neighbour
                if not len(ring):
                    break  # and to none further away
                d = self.to(j, ring)
                moves = (d < best[ring]).astype(bool) | ((d == best[ring]).astype(bool) & (j < number[ring]))
                number[ring[moves]], best[ring[moves]] = j, d[moves]
        return number, best


def components(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def one_round(vectors: DataFrame, centroids: np.ndarray, radii: list[int] | None) -> DataFrame:
    """Rows (vec_id, v, cluster, distance), and rows (number, n, radius, inertia, sums) by task and cluster, one table.

    radii are upper bounds of the squared distances of the clusters' members to the centroids given; without them
    there are no clusters yet and every vector meets every centroid.
    """
    k, dims = centroids.shape
    kind = dict(vectors.dtypes)["vec_id"]
    near = neighbours(centroids, radii) if radii is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, inertia = [0] * k, [0] * k, [0] * k
        sums = np.zeros((k, dims), object)
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = components(batch, dims)
            x, at = suited(values), suited(centroids)
            if x.dtype != at.dtype:
                x, at = values.astype(object), centroids
            space = Distances(x, at)
            if near is None:
                number, distance = space.nearest()
            else:
                was = batch.column(batch.schema.get_field_index("cluster")).to_numpy(zero_copy_only=False)
                number, distance = space.from_balls(was, near)
            for i in np.unique(number):
                mine = number == i
                n[i] += int(mine.sum())
                radius[i] = max(radius[i], int(distance[mine].max()))
                inertia[i] += sum(map(int, distance[mine])) if x.dtype == object else int(distance[mine].astype(np.int64).sum())
                sums[i] += np.array([int(s) for s in x[mine].sum(0)], object)
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            types = ids.type
            shown = pa.array([min(int(d), LARGEST) for d in distance] if x.dtype == object else distance.astype(np.int64), pa.int64())
            yield rows(types, len(number), [ids, batch.column(batch.schema.get_field_index("v")), pa.array(number), shown])
        held = [i for i in range(k) if n[i]]
        if held:
            big = pa.decimal128(38)
            yield rows(
                types,
                len(held),
                [None] * 4
                + [
                    pa.array(held, pa.int32()),
                    pa.array([n[i] for i in held], pa.int64()),
                    pa.array([radius[i] for i in held], big),
                    pa.array([min(inertia[i], LARGEST) for i in held], big),  # past a long it is given as the largest
                    pa.array([list(sums[i]) for i in held], pa.list_(big)),
                ],
            )

    return vectors.mapInArrow(run, SCHEMA.format(id=kind))


def rows(ids: pa.DataType, length: int, columns: list[pa.Array | None]) -> pa.RecordBatch:
    """A batch of the round's table; columns not given are null."""
    big = pa.decimal128(38)
    types = [ids, pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32(), pa.int64(), big, big, pa.list_(big)]
    names = ["vec_id", "v", "cluster", "distance", "number", "n", "radius", "inertia", "sums"]
    columns = [*columns, *[None] * (len(types) - len(columns))]
    return pa.RecordBatch.from_arrays([pa.nulls(length, t) if c is None else c for c, t in zip(columns, types)], names=names)


def totals(state: DataFrame, dims: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """Of every cluster with members: their number, largest and added-up squared distance, and sums by component."""
    parts = state.where("number is not null")
    big = "decimal(38,0)"
    added = [F.sum(F.col("sums")[i]).cast(big).alias(f"s{i}") for i in range(dims)]
    found = parts.groupBy("number").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").cast(big).alias("inertia"), *added)
    return {r["number"]: (r["n"], int(r["radius"]), int(r["inertia"]), [int(r[f"s{i}"]) for i in range(dims)]) for r in found.collect()}


def moved(centroids: np.ndarray, found: dict[int, tuple[int, int, int, list[int]]]) -> tuple[np.ndarray, list[int]]:
    """New centroids (floor of the mean; empty clusters stay) and upper bounds of their squared radii.

    A member lay within the old radius r, and the centroid moved by s, so it lies within r + s; rounded up.
    """
    out, radii = centroids.copy(), [0] * len(centroids)
    for i, (n, radius, _, sums) in found.items():
        out[i] = [s // n for s in sums]
        shift = int(squared(out[i], centroids[i]))
        radii[i] = (isqrt_up(radius) + isqrt_up(shift)) ** 2
    return out, radii


def isqrt_up(x: int) -> int:
    root = math.isqrt(x)
    return root + (root * root < x)


def ball_kmeans(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Assignments (id_col, cluster, distance) of every kept vector, and clusters (cluster, n, cluster_inertia, inertia, centroid), k rows at most.

    Kept are vectors with dims components, none null or not finite; a component x is the integer floor(scale * x).
    The first centroids are the k vectors with the least sha256 of salt:id (a null id as the empty string); rows
    repeated with one id are all clustered and may all be seeds. Fewer vectors than k make fewer clusters. Ties go
    to the smaller number, an empty cluster keeps its centroid. An empty table, or one without a kept vector, gives
    two empty results. Other columns are ignored. Squared distances past a long are given as the largest long.
    """
    spark, place = vectors.sparkSession, mark()
    state = materialise(integer_vectors(vectors, dims, scale, id_col, vector_col), "ball-vectors")
    centroids = seeds(state, k, salt)
    if not len(centroids):
        nothing = state.select(F.col("vec_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing, spark.createDataFrame([], CLUSTERS)
    radii: list[int] | None = None
    for round_ in range(rounds + 1):
        kept = state if radii is None else state.where("number is null").select("vec_id", "v", "cluster")
        state = materialise(one_round(kept, centroids, radii), f"ball-round-{round_}")
        drop_since(spark, place)
        found = totals(state, dims)
        if round_ < rounds:
            centroids, radii = moved(centroids, found)
    out = state.where("number is null").select(F.col("vec_id").alias(id_col), "cluster", "distance")
    members = [found.get(i, (0, 0, 0, [])) for i in range(len(centroids))]
    inertia = min(sum(m[2] for m in members), LARGEST)
    clusters = [(i, m[0], min(m[2], LARGEST), inertia, [int(x) for x in c]) for i, (m, c) in enumerate(zip(members, centroids))]
    return out, spark.createDataFrame(clusters, CLUSTERS)


def digest(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assignments with the inertia of their cluster and of all, and the centroid's sha256. clusters has k rows, so it is broadcast."""
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    table = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
