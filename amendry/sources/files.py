"""Readers and writers of JSON lines, texts, manifests, reports and activations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from amendry import schemas
from amendry.plans.scratch import written


def _schema(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, limit: int = -1) -> DataFrame:
    """One row for each line that isn't blank; `limit` keeps the first lines of the file order."""
    df = spark.read.schema(_schema(schema)).json(path)
    if limit < 0:
        return df
    fields = _schema(schema)
    lines = read_numbered_lines(spark, path).where(F.trim("value") != "").orderBy("file", "line_no").limit(limit)
    return lines.select(F.from_json("value", fields).alias("r")).select("r.*")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, value) of files of any size, read in splits.

    Rows of a split have ascending ids; a line's number is its id less the split's first, after the lines of the file's
    earlier splits, which are counted by split and summed over the splits of each file. Lines end at line feeds.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value").withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_at")) - F.col("_lines")
    found = lines.join(splits.withColumn("_before", before), ["file", "_at"])
    return found.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Adds each row's place in the order of a column (ties in any order): rows are dealt to ranges of the column, ranges
    counted, and places are counted on from the ranges before. Only the counts of ranges meet in one task."""
    ranged = written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.withColumn("_before", F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).drop("_rows")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + start + F.col("_before")
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, place).drop("_range", "_before")  # a row a partition


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_split(df: DataFrame, path: str) -> None:
    """One folder of JSON lines for each split."""
    df.write.partitionBy("split").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_revisions(spark: SparkSession, path: str, project_id: str, ref: str) -> DataFrame:
    """Texts of a folder as one revision of a project."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"\A.*?" + path.rstrip("/").split("/")[-1] + "/", "")
    return df.select(F.lit(project_id).alias("project_id"), name.alias("path"), F.lit(ref).alias("ref"), F.col("value").alias("text"))


def read_candidates_dir(spark: SparkSession, path: str) -> DataFrame:
    """One candidate for each file that isn't hidden, numbered in order of names."""
    df = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return numbered(df, "name", "cand_index").select("name", "text", "cand_index")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def read_hard_eval(spark: SparkSession, path: str) -> DataFrame:
    """Items with the number of their line."""
    lines = read_numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select("line_no", F.from_json("value", _schema(schemas.HARD_EVAL)).alias("r")).select("line_no", "r.*")


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    """Activation vectors; pairs of unequal length are an error."""
    df = spark.read.schema(schemas.ACTIVATIONS).parquet(path)
    return df.where(F.when(F.size("draft") != F.size("revised"), F.raise_error(F.concat(F.lit("unequal vectors of "), "pair_id")).cast("boolean")).otherwise(True))


def collect_reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports of many files, one row each, with the file's name as `source`."""
    rows = spark.read.schema(schemas.FOLD_REPORT).option("multiLine", True).json(path)
    return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"))
