"""Scores of edits from given linear weights: pairwise, absolute, verdicts, best of N, convergence.

Weights travel as a literal array (hundreds of numbers), so scoring is a projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amendry.functions import text as T
from amendry.functions import vectors as V


def literal_weights(weights: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(w)) for w in weights))


def pair_probability(weights: Column, source: str, a: str, b: str, lens: Sequence[str], bias: float = 0.0) -> Column:
    return V.sigmoid(V.dot(weights, V.preference_features(source, a, b, *lens)) + bias)


def score_pairwise(df: DataFrame, weights: Column, source: str = "src", a: str = "a", b: str = "b", lens: Sequence[str] = ("len_src", "len_a", "len_b"), symmetric: bool = True) -> DataFrame:
    """score_a and score_b from the probabilities of both orders (p_ab: a wins when first), or of one order."""
    ls, la, lb = lens
    df = df.withColumn("p_ab", pair_probability(weights, source, a, b, (ls, la, lb)))
    if not symmetric:
        return df.withColumn("score_a", F.col("p_ab")).withColumn("score_b", 1 - F.col("p_ab"))
    df = df.withColumn("p_ba", pair_probability(weights, source, b, a, (ls, lb, la)))
    return df.withColumn("score_a", (F.col("p_ab") + 1 - F.col("p_ba")) / 2).withColumn("score_b", (1 - F.col("p_ab") + F.col("p_ba")) / 2)


def score_bt(weights: Column, source: str, candidate: str, len_source: str, len_candidate: str, bias: float = 0.0) -> Column:
    """Absolute score of a candidate; comparable within one source only."""
    return V.dot(weights, V.pointwise_features(source, candidate, len_source, len_candidate)) + bias


def pair_metrics(df: DataFrame, margin: str = "margin") -> DataFrame:
    m = F.col(margin)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((m > 0).cast("double")).alias("pair_accuracy"), F.avg(V.softplus_of_minus(m)).alias("pair_loss"), F.avg(m).alias("mean_margin"))


def winner(score_a: str = "score_a", score_b: str = "score_b") -> Column:
    return F.when(F.col(score_b) > F.col(score_a), "B").otherwise("A")


def with_verdicts(df: DataFrame, file: str = "file", order: str = "line_no", edit: str = "score_edit", base: str = "score_base") -> DataFrame:
    """margin, verdict and the hunk's number in its file."""
    number = F.row_number().over(Window.partitionBy(file).orderBy(order))
    df = df.withColumn("margin", F.col(edit) - F.col(base))
    return df.withColumn("verdict", T.verdict("margin")).withColumn("index", number)


def only_flagged(df: DataFrame) -> DataFrame:
    return df.where("verdict <> 'preferred_edit'")


def hunk_stats(df: DataFrame, file: str = "file", total: bool = True, more: list[Column] | None = None) -> DataFrame:
    """Statistics of each file and, as the row with file null, of all; one shuffle. `more` are further aggregates."""
    group = df.rollup(file) if total else df.groupBy(file)
    return group.agg(
        F.count(F.lit(1)).alias("n"), F.avg("margin").alias("mean_margin"), F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin"),
        F.avg("score_edit").alias("mean_edit"), F.avg("score_base").alias("mean_base"), F.min("score_edit").alias("min_edit"), F.max("score_edit").alias("max_edit"),
        F.avg((F.col("margin") > 0).cast("double")).alias("win_rate"), *(more or []),
    )


VERDICTS = ("preferred_edit", "uncertain", "preferred_base", "reject_edit")


def verdict_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def check(hunks: DataFrame, weights: Column, flagged: bool = False) -> DataFrame:
    """Usable hunks with both scores, margin, verdict and previews; the base text takes the source's place."""
    df = hunks.where(T.usable_pair("source_text", "edited_text"))
    df = score_pairwise(df, weights, "src", "a", "src", ("len_src", "len_a", "len_src")).withColumnRenamed("score_a", "score_edit").withColumnRenamed("score_b", "score_base")
    df = with_verdicts(df).withColumn("source_preview", T.preview("source_text")).withColumn("edited_preview", T.preview("edited_text"))
    return only_flagged(df) if flagged else df


def with_source(df: DataFrame, item: str = "item", index: str = "cand_index", score: str = "score", source_score: str = "source_score") -> DataFrame:
    """The candidates and, as candidate 0 of each item, its source with the source's own score; `is_source` marks it."""
    columns = [F.col(c) if c in (item, source_score) else F.lit(0).cast(df.schema[c].dataType).alias(c) if c == index else F.col(source_score).alias(c) if c == score else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    own = df.groupBy(item).agg(F.min(source_score).alias(source_score)).select(*columns, F.lit(True).alias("is_source"))
    return df.withColumn("is_source", F.lit(False)).unionByName(own)


def best_of_n(df: DataFrame, item: str = "item", index: str = "cand_index", score: str = "score", source_score: str = "source_score", min_margin: float | None = None) -> DataFrame:
    """Rank of each candidate by (-score, index), its margin over the source, and whether the item's best is accepted."""
    own = Window.partitionBy(item)
    margin = F.col(score) - F.col(source_score)
    df = df.withColumn("rank", F.row_number().over(own.orderBy(F.desc(score), index))).withColumn("margin", margin)
    accepted = F.lit(True) if min_margin is None else F.max("margin").over(own) >= min_margin
    return df.withColumn("accepted", accepted)


def converged_pair(df: DataFrame, eps: float = 0.08, revised: str = "score_a", current: str = "score_b") -> DataFrame:
    return df.withColumn("converged", F.abs(F.col(revised) - F.col(current)) <= eps)


def converged_bt(df: DataFrame, min_improvement: float = 0.5, revised: str = "score_revised", current: str = "score_current") -> DataFrame:
    return df.withColumn("improvement", F.col(revised) - F.col(current)).withColumn("converged", F.col("improvement") < min_improvement)
