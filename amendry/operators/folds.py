"""Fits that leave out one project each, all at once: a pass over the rows gives every fold's loss and gradient.

The folds share rows, so they share the work: vectors are packed into matrices of a megabyte once, dealt to all cores, and
kept between the passes; a task multiplies its rows with the weights of all folds (a matrix product),
leaves out each row's own fold, and sends back one row of sums a fold; those are added on Spark, by fold. The driver
holds weights and a few gradients of `block` folds and takes one step of each (L-BFGS with backtracking); a fold that
has converged drops out of the next pass. So jobs grow with the steps, not with the projects. Scales of the features
come from one pass of sums by project: a fold's are the total less its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amendry.functions import vectors as V
from amendry.functions.text import project_of
from amendry.plans.scratch import written

_SUMS = "project_id string, sums array<double>"
_PACKED = "projects array<string>, at binary, x binary, y binary"
#: Bytes of vectors in one packed row, and in one task of a pass.
_ROW, _TASK = 1 << 20, 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _added(partial: DataFrame) -> DataFrame:
    """Sums of equal-length arrays by project; a task holds one project's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["project_id", "sums"])
        for batch in batches:
            for project, row in zip(batch.column("project_id").to_pylist(), _matrix(batch.column("sums"))):
                if project != now:
                    if total is not None:
                        yield out()
                    now, total = project, np.zeros(len(row))
                total = total + row
        if total is not None:
            yield out()

    return partial.repartition("project_id").sortWithinPartitions("project_id").mapInArrow(run, _SUMS)


def _moments(rows: DataFrame, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """(project_id, [rows, sums, sums of squares]) of the vectors in `columns`, stacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], names=["project_id", "sums"])
        for batch in batches:
            projects, at = np.unique(np.asarray(batch.column("project_id").to_pylist(), object), return_inverse=True)
            for c in columns:
                x = _matrix(batch.column(c))
                sums = np.zeros((len(projects), 1 + 2 * x.shape[1]))
                np.add.at(sums, at, np.hstack((np.ones((len(x), 1)), x, x * x)))
                for p, s in zip(projects, sums):
                    held[p] = held[p] + s if p in held else s
            if len(held) > most:
                yield out()
                held = {}
        yield out()

    return written(_added(rows.select("project_id", *columns).mapInArrow(run, _SUMS)), "moments")


def _blocks(rows: DataFrame, centre: np.ndarray, n: int) -> DataFrame:
    """The `n` rows (project_id, x, y) less `centre`, as matrices: each pass reads bytes instead of arrays of numbers."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * 8 * len(centre) // _TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _ROW // (8 * max(1, len(centre))))
        for batch in batches:
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                names, at = np.unique(np.asarray(part.column("project_id").to_pylist(), object), return_inverse=True)
                x, y = _matrix(part.column("x")) - centre, np.asarray(part.column("y"), float)
                made = [pa.array([names.tolist()], pa.list_(pa.string())), *(pa.array([b.tobytes()], pa.binary()) for b in (at.astype(np.int32), x, y))]
                yield pa.RecordBatch.from_arrays(made, names=["projects", "at", "x", "y"])

    return rows.mapInArrow(run, _PACKED).repartition(tasks)


@dataclass
class Fold:
    """One fold's state: scaled weights and bias, the last gradient, and recent steps."""

    project: str
    scale: np.ndarray
    train: int
    point: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    first: float = 0.0
    direction: np.ndarray | None = None
    rate: float = 1.0
    steps: int = 0
    own: tuple[float, float, float] = (0.0, 0.0, 0.0)
    history: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.rate * self.direction

    def _turn(self) -> None:
        g, alphas = self.gradient.copy(), []
        for s, y in reversed(self.history):
            alphas.append(s @ g / (y @ s))
            g -= alphas[-1] * y
        if self.history:
            s, y = self.history[-1]
            g *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.history, reversed(alphas)):
            g += (a - y @ g / (y @ s)) * s
        self.direction, self.rate = -g, 1.0 if self.history else 1.0 / max(1.0, np.linalg.norm(g))

    def take(self, value: float, gradient: np.ndarray, own: tuple[float, float, float], tol: float, most: int) -> bool:
        """Accept or shorten the trial step; whether the fold is done."""
        point = self.trial()
        if self.direction is not None and not value <= self.value + 1e-4 * self.rate * (self.gradient @ self.direction):
            self.rate /= 2
            self.steps += 1
            return self.rate < 1e-12 or self.steps >= most
        if self.gradient is not None:
            s, y = point - self.point, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.history = [*self.history[-9:], (s, y)]
        self.point, self.value, self.gradient, self.own = point, value, gradient, own
        self.first = self.first or float(np.linalg.norm(gradient))
        self.steps += 1
        if np.linalg.norm(gradient) <= tol * max(self.first, 1e-300) or self.steps >= most:
            return True
        self._turn()
        return False


def _passes(blocks: DataFrame, active: list[Fold], intercept: bool) -> dict[str, np.ndarray]:
    """By fold: loss and gradient over the other projects' rows; rows, hits and loss of its own."""
    place = {f.project: i for i, f in enumerate(active)}
    inverse = np.array([np.divide(1.0, f.scale, out=np.zeros_like(f.scale), where=f.scale > 0) for f in active]).T
    points = np.array([f.trial() for f in active]).T
    weights, bias = points[:-1] * inverse, points[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), len(weights) + 5))
        for projects, at, x, y in (row for batch in batches for row in zip(*(batch.column(c) for c in ("projects", "at", "x", "y")))):
            y = np.frombuffer(y.as_buffer())
            x = np.frombuffer(x.as_buffer()).reshape(len(y), -1)
            at = np.array([place.get(p, -1) for p in projects.as_py()])[np.frombuffer(at.as_buffer(), np.int32)]
            margin = (x @ weights + bias) * y[:, None]
            loss = np.maximum(-margin, 0) + np.log1p(np.exp(-np.abs(margin)))
            pull = -y[:, None] * np.exp(-np.maximum(margin, 0)) / (1 + np.exp(-np.abs(margin)))
            held = np.flatnonzero(at >= 0)
            mine = at[held]
            np.add.at(total[:, -3:], mine, np.column_stack((np.ones(len(held)), margin[held, mine] > 0, loss[held, mine])))
            loss[held, mine] = pull[held, mine] = 0.0
            total[:, 0] += loss.sum(0)
            total[:, 1:-4] += (x.T @ pull).T
            total[:, -4] += pull.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["project_id", "sums"])

    found = {r.project_id: np.array(r.sums) for r in _added(blocks.mapInArrow(run, _SUMS)).collect()}
    for f in active:
        found[f.project][1:-4] *= inverse[:, place[f.project]]
        if not intercept:
            found[f.project][-4] = 0.0
    return found


def fit_folds(df: DataFrame, kind: str = "pairwise", c: float = 1.0, max_iter: int = 2000, only: Sequence[str] | None = None, tol: float = 1e-6, block: int = 256) -> Iterator[Fold]:
    """The fitted folds; see `lopo`."""
    df = df.withColumn("project_id", project_of("project_id"))
    if kind == "bt":
        rows = df.select("project_id", V.minus("better", "worse").alias("x"), F.lit(1.0).alias("y"))
        moments, copies = _moments(df, ("better", "worse")), 2
    else:
        rows = df.select("project_id", F.col("features").alias("x"), (2 * F.col("label") - 1).cast("double").alias("y"))
        moments, copies = _moments(df, ("features",)), 1
    sizes = {r.project_id: r.n for r in moments.select("project_id", F.get("sums", F.lit(0)).alias("n")).collect()}
    if unknown := set(only or ()) - set(sizes):
        raise ValueError(f"unknown projects: {sorted(unknown)}")
    if len(sizes) < 2:
        raise ValueError("leave-one-project-out needs two projects")
    total = np.array(_added(moments.withColumn("project_id", F.lit("all"))).first().sums)
    d = (len(total) - 1) // 2
    centre = np.zeros(d) if kind == "bt" else total[1 : d + 1] / total[0]
    wanted = [p for p in sorted(sizes, key=lambda p: (-sizes[p], p)) if only is None or p in set(only)]
    blocks = _blocks(rows, centre, sum(map(int, sizes.values())) // copies).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for k in range(0, len(wanted), block):
            names = wanted[k : k + block]
            active = []
            for r in moments.where(F.col("project_id").isin(names)).collect():
                rest = total - np.array(r.sums)
                mean = rest[1 : d + 1] / rest[0]
                spread = rest[d + 1 :] / rest[0] - mean**2
                scale = np.sqrt(np.where(spread > 1e-12 * np.maximum(rest[d + 1 :] / rest[0], 1e-300), spread, 0.0))
                active.append(Fold(r.project_id, scale, round(rest[0]) // copies, np.zeros(d + 1)))
            while active:
                found = _passes(blocks, active, kind != "bt")
                going = []
                for f in active:
                    sums, at = found[f.project], f.trial()
                    gradient = c * copies * sums[1:-3] + np.append(at[:-1], 0.0)
                    if f.take(c * copies * sums[0] + at[:-1] @ at[:-1] / 2, gradient, tuple(sums[-3:]), tol, max_iter):
                        yield f
                    else:
                        going.append(f)
                active = going
    finally:
        blocks.unpersist()


def lopo(df: DataFrame, kind: str = "pairwise", c: float = 1.0, max_iter: int = 2000, only: Sequence[str] | None = None, tol: float = 1e-6, block: int = 256) -> DataFrame:
    """(project_id, n, accuracy, log_loss, train_samples, objective, gradient_share, steps): each project held against a
    model fitted on all others.

    kind "pairwise" has features and label, "bt" better and worse. Minimises c * sum of log losses + |w|^2 / 2 over
    features scaled by the fold's deviations (of a bt fold those of both sides, and every pair in both directions).
    `only` names the folds to fit; a name that no row has is an error, and so are fewer than two projects. Rows without
    a project are one project. gradient_share certifies the optimum: the norm of the gradient at the returned weights
    over that at zero, at most `tol` unless `max_iter` steps came first. Features that don't vary take no part.
    """
    rows = []
    for f in fit_folds(df, kind, c, max_iter, only, tol, block):
        n, hits, loss = map(float, f.own)
        rows.append((f.project, round(n), hits / n, loss / n, f.train, float(f.value), float(np.linalg.norm(f.gradient) / max(f.first, 1e-300)), f.steps))
    return df.sparkSession.createDataFrame(rows, "project_id string, n long, accuracy double, log_loss double, train_samples long, objective double, gradient_share double, steps int")
