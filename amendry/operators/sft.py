"""Supervised pairs: chat rows, prompts, holdouts, balanced limits, statistics, cleaned generations."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from amendry.functions import text as T
from amendry.operators.mining import latest


def chat_rows(pairs: DataFrame, instruction: str) -> DataFrame:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("user", F.concat(F.lit(instruction + "\n\n"), "draft")), turn("assistant", F.col("revised")))
    return pairs.select("id", "project_id", messages.alias("messages"))


def draft_of(message: Column | str) -> Column:
    """What follows the first blank line of a user turn, or all of it."""
    text = F.col(message) if isinstance(message, str) else message
    at = F.locate("\n\n", text)
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text)


def prompt(draft: Column | str, norms: Column | str | None, task: str) -> Column:
    """The task and draft, after the norms where given."""
    text = F.col(draft) if isinstance(draft, str) else draft
    if norms is None:
        return F.concat(F.lit(task + "\n\n"), text)
    rules = F.lit(norms) if isinstance(norms, str) else norms
    return F.concat(rules, F.lit("\n\n" + task + "\n\n"), text)


def sft_holdout(pairs: DataFrame, holdout: DataFrame, seed: int = 7) -> DataFrame:
    """Every pair with split "holdout" or "train"; train rows have their place in a seeded order.

    A holdout project without pairs is an error.
    """
    if unknown := [r[0] for r in missing_keys(holdout, pairs, "project_id").orderBy("project_id").limit(5).collect()]:
        raise ValueError(f"unknown holdout projects: {unknown}")
    names = holdout.select("project_id").distinct().withColumn("_held", F.lit(True))
    df = pairs.join(names, "project_id", "left")
    return df.withColumn("split", F.when(F.col("_held"), "holdout").otherwise("train")).withColumn("order_key", F.xxhash64("id", F.lit(seed))).drop("_held")


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def sft_rows(chat: DataFrame, limit: int = 0) -> DataFrame:
    df = chat.where(F.size("messages") > 0)
    df = df.orderBy("id").limit(limit) if limit > 0 else df
    return df.select("messages")


def length_window(df: DataFrame, low: int = 0, high: int = 0, text: str = "draft") -> DataFrame:
    n = F.length(text)
    return df.where((n >= low) & ((n <= high) if high else F.lit(True)))


def round_robin(df: DataFrame, limit: int, project: str = "project_id", order: str = "line_no") -> DataFrame:
    """The first row of every project, then the second, and so on, until `limit`; all rows for 0."""
    depth = F.row_number().over(Window.partitionBy(project).orderBy(order))
    df = df.withColumn("depth", depth)
    return df.orderBy("depth", project).limit(limit) if limit > 0 else df


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two short texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def edit_similarity(a: str, b: str) -> Column:
    """1 - Levenshtein distance / longer length; native, and not the same measure as `char_similarity`."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def pair_stats(pairs: DataFrame, similarity: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Per project and (project null) overall: rows, mean and 10, 50 and 90 % points of the length ratio.

    With `similarity` (`char_similarity` or `edit_similarity`) the same of the likeness of draft and revised.
    """
    ratio = T.length_ratio(F.col("revised"), F.col("draft"))
    df = pairs.select("project_id", ratio.alias("r"), *([similarity("draft", "revised").alias("s")] if similarity else []))
    points = lambda c, lead: [F.percentile(c, F.lit(q / 100)).alias(f"{lead}{q}") for q in (10, 50, 90)]
    more = [F.avg("s").alias("mean_similarity"), *points("s", "s")] if similarity else []
    return df.rollup("project_id").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_ratio"), *points("r", "p"), *more)


def load_generations(gens: DataFrame) -> DataFrame:
    """The last generation of each (mode, id), cleaned of thinking blocks and talk about the task."""
    return latest(gens, ["mode", "id"], "line_no").withColumn("generated", T.clean_generation("generated"))
