"""Exact k-means rounds by Shallot search: bounded vectors, remembered second centroids, shrinking balls.

Each vector keeps its centroid and the second nearest, an upper bound of its distance to the one and a lower bound of
its distance to all others. After centroids have moved the bounds move with them; where the upper one stays below the
lower one, or below half the way to the nearest other centroid, nothing is computed. For the rest the distances to both
remembered centroids are taken, and the search starts from the closer one: other centroids are visited by their distance
from it, and end where that exceeds the distance to the start plus the distance to the second nearest so far, a ball
that shrinks while closer ones are found. Bounds are doubles, widened by more than their rounding; whatever they let
through is compared by exact integer distances, so ties go to the smaller number.

Vectors and their state stay in partitions: a round is one pass without a shuffle. Each task adds one row with what its
moved vectors change in the centroids' sums; those rows (centroids times dimensions) are summed on Spark and sent to the
driver. A round's table is persisted until the next one is there; lost parts are computed again from the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .vectors import integers, usable

#: Bounds are widened by this share; doubles round by far less.
_SLACK = 1e-9
_STATE = "vec_id long, vector binary, own int, second int, upper double, lower double, moved array<long>"


def _squared(rows: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    gap = rows - centroids[which]
    return np.einsum("ij,ij->i", gap, gap)


class Round:
    """What one round's tasks need: the centroids, how far they are apart, and how far the last update moved them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        apart = np.sqrt([_squared(centroids, centroids, np.full(k, j)) for j in range(k)]) * (1 - _SLACK)
        np.fill_diagonal(apart, -1.0)
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]  # of each centroid the others, nearest first
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        shift = np.zeros(k) if before is None else np.sqrt(_squared(centroids, before, np.arange(k))) * (1 + _SLACK)
        self.shift = shift
        self.others = np.array([np.delete(shift, j).max(initial=0.0) for j in range(k)])

    def assign(self, rows: np.ndarray, own: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Update the four arrays of state; returns how many exact distances it took. `upper` is infinite at first."""
        upper += self.shift[own]
        lower -= self.others[own]
        lower *= np.where(lower > 0, 1 - _SLACK, 1 + _SLACK)
        todo = np.flatnonzero(upper >= np.maximum(lower, self.half[own]))
        taken = len(todo)
        if not taken:
            return 0
        first = _squared(rows[todo], self.centroids, own[todo])
        upper[todo] = np.sqrt(first) * (1 + _SLACK)
        if len(self.centroids) == 1:
            return taken
        rest = upper[todo] >= np.maximum(lower[todo], self.half[own[todo]])
        todo, first = todo[rest], first[rest]
        x, a, b = rows[todo], own[todo].astype(np.int64), second[todo].astype(np.int64)
        other = _squared(x, self.centroids, b)
        taken += len(todo)
        swap = (other < first) | ((other == first) & (b < a))
        best, best_d = np.where(swap, b, a), np.where(swap, other, first)
        next_, next_d = np.where(swap, a, b), np.where(swap, first, other)
        start, start_d, left_out = best.copy(), np.sqrt(best_d), next_.copy()
        alive = np.arange(len(todo))
        for rank in range(self.near.shape[1]):
            ball = (start_d[alive] + np.sqrt(next_d[alive])) * (1 + _SLACK)
            alive = alive[self.apart[start[alive], rank] <= ball]
            if not len(alive):
                break
            at = alive[self.near[start[alive], rank] != left_out[alive]]
            j = self.near[start[at], rank]
            d = _squared(x[at], self.centroids, j)
            taken += len(at)
            wins = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
            w, v = at[wins], ~wins & (d < next_d[at])
            next_[w], next_d[w], best[w], best_d[w] = best[w], best_d[w], j[wins], d[wins]
            next_[at[v]], next_d[at[v]] = j[v], d[v]
        own[todo], second[todo] = best, next_
        upper[todo], lower[todo] = np.sqrt(best_d) * (1 + _SLACK), np.sqrt(next_d) * (1 - _SLACK)
        return taken


def _started(dims: int, scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = integers(batch.column("vector"), dims, scale).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, 1 % k, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n)), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "vector", "own", "second", "upper", "lower", "moved"],
            )

    return run


def _state(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
    was = batch.column("own").to_numpy()
    return rows, was, [np.maximum(was, 0), *(batch.column(c).to_numpy().copy() for c in ("second", "upper", "lower"))]


def _moved(step: Round, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(step.centroids)
        change = np.zeros((k, dims + 1), np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            rows, was, state = _state(batch, dims)
            step.assign(rows, *state)
            went = np.flatnonzero(state[0] != was)
            each = np.column_stack((rows[went], np.ones(len(went), np.int64)))
            np.add.at(change, state[0][went], each)
            left = was[went] >= 0
            np.subtract.at(change, was[went][left], each[left])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *map(pa.array, state), batch.column("moved")], schema=schema)
        if schema is not None:
            blank = [pa.nulls(1, f.type) for f in schema][:-1]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([change.ravel().tolist()], schema.field("moved").type)], schema=schema)

    return run


def _final(step: Round, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _, state = _state(batch, dims)
            step.assign(rows, *state)
            distance = _squared(rows, step.centroids, state[0])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(state[0]), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def fit_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> tuple[np.ndarray, DataFrame | None]:
    """Final centroids (k x dims integers) and (vec_id, cluster, distance) of each usable row of (vec_id, embedding)."""
    kept = vectors.where(usable(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id IS NOT NULL").orderBy(key, "vector").limit(k).collect()
    centroids = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dims, scale)
    if not len(centroids):
        return centroids, None
    state = kept.mapInArrow(_started(dims, scale, len(centroids)), _STATE)
    held: list[DataFrame] = []
    sums, before = np.zeros((len(centroids), dims + 1), object), None
    for _ in range(rounds):
        step = Round(centroids, before)
        state = state.where("moved IS NULL").mapInArrow(_moved(step, dims), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
        changes = state.where("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
        for r in changes.collect():
            sums.flat[r["at"]] += int(r.x)
        held.append(state)
        if len(held) > 1:
            held.pop(0).unpersist()
        before, centroids = centroids, centroids.copy()
        for j in np.flatnonzero(sums[:, dims]):
            centroids[j] = [int(x) // int(sums[j, dims]) for x in sums[j, :dims]]
    done = written(state.where("moved IS NULL").mapInArrow(_final(Round(centroids, before), dims), "vec_id long, cluster int, distance long"), "clusters")
    for x in held:
        x.unpersist()
    return centroids, done


def shallot_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable row of (vec_id, embedding).

    Components become floor(scale * x). Rows whose vector is null, has null or non-finite components or has not `dims`
    components are left out; components so large that distances don't fit a long are an error. Centroids start as the
    rows with the least SHA-256 of `salt` and vec_id, fewer than `k` where there are fewer rows. Rows without vec_id
    start none but are clustered; rows that repeat an id count each. Equal centroids and equal distances go to the
    smaller number; empty clusters keep their centroid. No usable rows give an empty result. Other columns are ignored.
    """
    centroids, found = fit_clusters(vectors, k, rounds, dims, scale, salt)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    own = {r.cluster: r.x for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = F.lit(sum(own.values())).cast("long")
    return found.select("vec_id", "cluster", "distance", at([own.get(j, 0) for j in range(len(centroids))]).cast("long").alias("cluster_inertia"), inertia.alias("inertia"), at(digests).alias("centroid_sha256"))
