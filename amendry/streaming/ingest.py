"""Continuous ingest of mined pairs, and scoring of hunks as they arrive, with state by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from amendry.functions import text as T
from amendry.operators.curation import KEY
from amendry.operators.scoring import VERDICTS, hunk_stats, score_pairwise

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _digest(keys: Sequence[str]) -> Column:
    """128 bits of the keys; nulls differ from empty texts."""
    return F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))


def unique_rows(stream: DataFrame, watermark: str = "1 day", keys: Sequence[str] = KEY, time: str = "created_at") -> DataFrame:
    """Each key once for all time; rows later than the watermark are dropped, and counted in the query's progress.

    The state is one digest a key and never expires, since a key may come again at any time.
    """
    return stream.withWatermark(time, watermark).withColumn("_key", _digest(keys)).dropDuplicates(["_key"])


def unique_within_watermark(stream: DataFrame, watermark: str = "1 day", keys: Sequence[str] = KEY, time: str = "created_at") -> DataFrame:
    """Each key once within the watermark, after which its state goes; rows later than it are dropped and counted."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_append_new(stream: DataFrame, path: str, checkpoint: str, watermark: str = "1 day", keys: Sequence[str] = KEY, time: str = "created_at", existing: DataFrame | None = None) -> StreamingQuery:
    """Start the ingest into the Parquet table at `path`, a table that only this query writes; `spark.read` sees whole
    batches of it, each once, also after a restart from `checkpoint`.

    What is known is kept as state by key, so a batch reads the state of its own keys and nothing of the table. Keys of
    `existing`, rows from before the stream, count as known; they are joined again in every batch. Sessions without a
    state store of their own choosing get RocksDB, whose checkpoints hold changes only.
    """
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)
    rows = unique_rows(stream, watermark, keys, time)
    if existing is not None:
        rows = rows.join(existing.select(_digest(keys).alias("_key")).distinct(), "_key", "left_anti")
    return rows.drop("_key").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


class LateRows(StreamingQueryListener):
    """Counts rows that came after the watermark, for each batch of the queries it hears of.

    `spark.streams.addListener(late)` before the query starts; `late.table(spark)` is (query, batch_id, late_rows).
    """

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if late := sum(s.numRowsDroppedByWatermark for s in p.stateOperators):
            self.counts[str(p.id), p.batchId] = late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k, n) for k, n in sorted(self.counts.items())], "query string, batch_id long, late_rows long")


def scored_hunks(stream: DataFrame, weights: Column) -> DataFrame:
    """Usable hunks with both scores, margin and verdict, row by row."""
    df = stream.where(T.usable_pair("source_text", "edited_text"))
    df = score_pairwise(df, weights, "src", "a", "src", ("len_src", "len_a", "len_src")).withColumnRenamed("score_a", "score_edit").withColumnRenamed("score_b", "score_base")
    margin = F.col("score_edit") - F.col("score_base")
    return df.withColumn("margin", margin).withColumn("verdict", T.verdict("margin"))


def stream_check(stream: DataFrame, weights: Column, file: str = "file", order: str = "line_no", flagged: bool = False) -> DataFrame:
    """The batch check on a stream: scored hunks with previews and `index`, each hunk's number in its file.

    The number of a file's hunks so far is state by file and goes on after a restart. Within a batch hunks are numbered
    by `order`, over batches as they come. `flagged` leaves out preferred edits, which count in the index.
    """
    df = scored_hunks(stream, weights).withColumn("source_preview", T.preview("source_text")).withColumn("edited_preview", T.preview("edited_text"))
    schema = StructType([*df.schema.fields, StructField("index", IntegerType())])

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames)).sort_values(order, kind="stable")  # one file's hunks of one batch
        seen = state.get[0] if state.exists else 0
        state.update((seen + len(own),))
        yield own.assign(index=range(seen + 1, seen + len(own) + 1))

    out = df.groupBy(file).applyInPandasWithState(number, schema, "seen long", "append", GroupStateTimeout.NoTimeout)
    return out.where("verdict <> 'preferred_edit'") if flagged else out


def stream_summary(stream: DataFrame, weights: Column, file: str = "file") -> DataFrame:
    """By file the statistics of `hunk_stats` and a count for each verdict, over all batches so far; for the output modes
    update and complete."""
    df = scored_hunks(stream, weights)
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return hunk_stats(df, file, total=False, more=counts)
