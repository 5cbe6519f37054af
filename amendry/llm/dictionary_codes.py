"""Product codes of vectors, with part distances looked up by per-dimension value dictionaries.

Components are integers, so a dimension has few distinct values beside its rows. For the rows at hand each dimension
gets a dictionary of its distinct integers, and a table of the squared differences of each to the matching component of
all entries; a part's distances to its codebook are then rows gathered from its dimensions' tables and added. All of it
is exact. A task holds the dictionaries of one Arrow batch, so memory doesn't grow with the range of the values.

Codebooks (entries times dimensions) travel in the tasks' closures; each round sends back one row of counts and sums
for each entry, summed on Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .vectors import attach_totals, integers, usable


def nearest_entries(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and squared distance, a column for each part.

    `rows` are n x dims integers, `books` parts x entries x width."""
    parts, entries, width = books.shape
    code, error = np.zeros((len(rows), parts), np.int64), np.zeros((len(rows), parts), np.int64)
    for p in range(parts):
        distance = np.zeros((len(rows), entries), np.int64)
        for j in range(width):
            values, at = np.unique(rows[:, p * width + j], return_inverse=True)
            distance += ((values[:, None] - books[p, :, j]) ** 2)[at]
        code[:, p] = distance.argmin(axis=1)
        error[:, p] = distance[np.arange(len(rows)), code[:, p]]
    return code, error


def _sums(books: np.ndarray, scale: int):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = integers(batch.column("vector"), parts * width, scale)
            code, _ = nearest_entries(rows, books)
            for p in range(parts):
                np.add.at(number[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], rows[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(number)
        columns = [pa.array(part), pa.array(entry), pa.array(number[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray, scale: int):
    parts, _, width = books.shape
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest_entries(integers(batch.column("vector"), parts * width, scale), books)
            text = ["".join(x) for x in digits[code].tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(vectors: DataFrame, dims: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """parts x entries x width integers: the first rows by vec_id, moved `rounds` times to the floor of their parts' mean.

    `vectors` are (vec_id, vector). The driver gets the first `entries` rows and, a round, one row for each entry."""
    first = vectors.where("vec_id IS NOT NULL").select("vec_id", "vector").orderBy("vec_id", "vector").limit(entries).collect()
    start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dims, scale)
    width = dims // parts
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        found = vectors.select("vector").mapInArrow(_sums(books, scale), "part long, entry long, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(width)]
        moved = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            moved[r.part, r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
        books = moved
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, dims: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of each usable row of (vec_id, embedding, label).

    Components become floor(scale * x). Rows whose vector is null, has null or non-finite components, or has not `dims`
    components, are left out; components so large that distances don't fit a long are an error. Rows without vec_id are
    coded but start no entry; rows that repeat an id count each. Fewer rows than `entries` make smaller codebooks; no
    rows give an empty result. Other columns are ignored. Null labels share one sum.
    """
    if dims % parts or entries > 256:
        raise ValueError("parts must divide dims, and an index has two hex digits")
    kept = vectors.where(usable(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    books = fit_codebooks(kept, dims, parts, entries, rounds, scale)
    label = kept.schema["label"].dataType.simpleString()
    if not books.size:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, code string, error long, label_error long, codebooks_sha256 string, label {label}")
    scored = written(kept.mapInArrow(_coded(books, scale), f"vec_id long, label {label}, code string, error long"), "codes")
    totals = scored.groupBy("label").agg(F.sum("error").alias("label_error"))
    return attach_totals(scored, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"), "label")


def decode_vectors(codes: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """The vector that each code stands for: the entries' components over `scale`, as doubles."""
    parts = books.shape[0]
    tables = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in books[p].tolist())) for p in range(parts)]
    index = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("decoded", F.concat(*(F.element_at(t, i + 1) for t, i in zip(tables, index))))
