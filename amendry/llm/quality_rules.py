"""Quality rules: base counts of each text, and lines that too many documents of one host share.

Method: cross-document line frequency. Lines are normalised (blanks collapsed, trimmed, lower case) and hashed;
each host's documents that hold a line are counted; lines above the limit are removed and documents that lose
most of their words are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import covered, mix, per_text, slices, text_bytes, word_grams, words_of

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BASE_SCHEMA = (
    "doc_id long, host string, version long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
)


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _repeated_words(hashes: np.ndarray, doc: np.ndarray, n: int = 5) -> np.ndarray:
    """Mask of words in n-word windows that their own text holds more than once."""
    grams = word_grams(hashes, n)
    if not len(grams):
        return np.zeros(len(hashes), bool)
    with np.errstate(over="ignore"):
        key = mix(grams ^ mix(doc[: len(grams)].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :])
    order = np.argsort(key[at], kind="stable")
    ranked = key[at][order]
    same = ranked[1:] == ranked[:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(at) else np.zeros(0, bool)
    starts = at[order[again]]
    return covered(starts, np.full(len(starts), n), len(hashes))


def _base_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = text_bytes(batch.column("text"))
        words = words_of(texts)
        first = words.first
        hashes = words.hashes()
        length = words.end - words.start
        marks = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int32)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[words.data], dtype=np.int32)))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "host": batch.column("host"),
                "version": batch.column("version"),
                "n_words": words.count,
                "word_chars": per_text(marks[words.end] - marks[words.start], first) if len(length) else words.count,
                "n_symbols": per_text(symbols[words.end] - symbols[words.start], first) if len(length) else words.count,
                "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
                "n_repeat_words": per_text(_repeated_words(hashes, words.doc), first),
            }
        )


def _version() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text (null: none), with its host and
    version (a hash of the text)."""
    df = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"), _version().alias("version"))
    return df.mapInArrow(_base_counts, _BASE_SCHEMA)


def _normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def line_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, line, n_docs): how many documents of each host hold a normalised line; line is its 64-bit hash.

    Rows that share a doc_id are one document; rows without one don't count. The distinct count goes over (host, line,
    document) first, so that no task gathers the documents of a line.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: _normalised(x))
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.explode(hashes).alias("line"))
        .groupBy("host", "line")
        .agg(F.count_distinct("doc_id").alias("n_docs"))
    )


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, version, place, line, words): a row for each line with a word, repeats included."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), _version().alias("version"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .select("doc_id", "host", "version", "place", _normalised(F.col("line")).alias("line"))
        .where("line <> ''")
        .select("doc_id", "host", "version", "place", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))
    )


def line_frequency_rules(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = 50,
    min_left: float = 0.4,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    salts: int = 32,
) -> DataFrame:
    """Base counts, the base rule and the verdict of cross-document line frequency for each document.

    A line that more than `max_docs` documents of one host hold is removed; a document keeps its place when at
    least `min_left` of its words remain. Hosts that are null share one group; documents without lines lose nothing.
    Null texts count as empty and fail the base rule. A task holds some 25 to 35 bytes for each byte of its longest text. Rows that repeat a doc_id are one document in the counts of
    lines; each of them loses the lines of its own text, and all appear. Rows without doc_id neither count nor lose lines.

    The first shuffle has a row for each line of each document, repeats in a task combined; counts are then combined
    before their shuffle, so a line in every document costs one row a task there. On the way back the
    frequent lines, of which there are at most lines / max_docs, are copied to `salts` keys so that the rows of a
    very common line spread over as many tasks.
    """
    frequent = (
        line_documents(docs, host)
        .where(F.col("n_docs") > max_docs)
        .select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    lost = (
        host_lines(docs, host)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(frequent, ["host", "line", "salt"])
        .groupBy("doc_id", "host", "version")
        .agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"), F.count_distinct("place").alias("n_removed_lines"))
    )
    # Rows that repeat one wholly were summed together.
    lost = lost.select("doc_id", "host", "version", F.expr("words * n_removed_lines div rows").alias("n_removed_words"), "n_removed_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        base_counts(docs, host)
        .withColumn("host", F.coalesce("host", F.lit("")))
        .join(lost, ["doc_id", "host", "version"], "left")
        .drop("host", "version")
        .fillna(0, ["n_removed_words", "n_removed_lines"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= min_left * F.col("n_words")))
    )
