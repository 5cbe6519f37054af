"""From examples to curated, split preference pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amendry.functions import text as T

KEY = ("project_id", "source_text", "edited_text", "source_reference")


def first_by(df: DataFrame, keys: Sequence[Column | str], *order: Column | str) -> DataFrame:
    """The first row of each key. Keys are shuffled as a digest, with the whole key beside it."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns)))
    rank = F.row_number().over(Window.partitionBy(digest).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert_by_id(df: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last row of each id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_result") == "accepted")


def _digest(keys: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(k), F.lit("\u0002")) for k in keys)), 256)


def append_new(df: DataFrame, existing: DataFrame, keys: Sequence[str] = KEY, order: str = "line_no") -> DataFrame:
    """Rows of `df` whose key is new, once each; nulls in a key are equal to each other."""
    fresh = first_by(df, keys, order).withColumn("_key", _digest(keys))
    return fresh.join(existing.select(_digest(keys).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def build_dpo(examples: DataFrame, rejected: str = "source", prompt: str = T.DEFAULT_PROMPT) -> DataFrame:
    """Accepted examples as (prompt, input, chosen, rejected), the first of each (source, edited) in order of time."""
    df = accepted(examples).where("source_text <> '' AND edited_text <> ''")
    df = first_by(df, ["source_text", "edited_text"], "created_at", "id").withColumn("rejected", T.rejected_text(rejected, F.col("source_text"), F.col("edited_text")))
    return df.where(F.col("rejected") != F.col("edited_text")).select(
        "id", F.lit(prompt).alias("prompt"), T.input_text(F.col("source_text"), F.col("source_reference")).alias("input"),
        F.col("edited_text").alias("chosen"), "rejected", "project_id", "source_reference", "created_at", F.lit(rejected).alias("rejected_mode"),
    )


def prepared(df: DataFrame, *texts: str) -> DataFrame:
    """Adds `_made`: each text stripped, without its reference block, as filled lines and without white space.

    Exploding a struct of one row keeps the optimizer from copying these expressions into every rule.
    """
    plain = F.explode(F.array(F.struct(*(T.strip_reference(t).alias(t) for t in texts))))
    df = df.withColumn("_plain", plain)
    made = F.struct(*(F.struct(F.col(f"_plain.{t}").alias("plain"), F.length(T.strip(t)).alias("size"), T.filled_lines(F.col(f"_plain.{t}")).alias("lines"), T.normalize(t).alias("dense")).alias(t) for t in texts))
    return df.withColumn("_made", F.explode(F.array(made))).drop("_plain")


def _bad_ratio(low: float = 0.15, high: float = 6.0) -> Column:
    size = lambda x: F.greatest(F.length(x), F.lit(1))
    base = size(T.normalize(F.col("_made.input.plain")))
    return reduce(lambda a, b: a | b, [(r > high) | (r < low) for r in (size(F.col(f"_made.{t}.dense")) / base for t in ("chosen", "rejected"))])


def reject_reason(
    min_chars: int = 5, max_chars: int = 2500, script: str = T.TARGET_SCRIPT, exclude: Sequence[str] = (), drop_citation_only: bool = False
) -> Column:
    """The first rule that a row (input, chosen, rejected, source_reference) breaks, or null; after `prepared`."""
    texts = ("input", "chosen", "rejected")
    either = lambda part, f: reduce(lambda a, b: a | b, [f(F.col(f"_made.{t}.{part}")) for t in texts])
    blob = F.concat_ws("\n", *texts, F.coalesce(F.col("source_reference"), F.lit("")))
    rules = [
        ("bad_length", either("size", lambda n: ~n.between(min_chars, max_chars))),
        ("same_choice", F.col("_made.chosen.dense") == F.col("_made.rejected.dense")),
        ("citation_or_bib_only", T.is_citation_only("chosen", "rejected") if drop_citation_only else F.lit(False)),
        ("user_exclude_pattern", reduce(lambda a, b: a | b, [blob.rlike(p) for p in exclude], F.lit(False))),
        ("placeholder_note", blob.rlike(T.PLACEHOLDER)),
        ("directive_only", either("lines", T.lines_are_directives)),
        ("short_fragment", either("lines", lambda x: T.lines_are_fragment(x, script))),
        ("no_japanese_target", ~F.col("chosen").rlike(script) & ~F.col("rejected").rlike(script)),
        ("non_paragraph", either("plain", lambda t: ~T.plain_has_language(t, script))),
        ("bad_length_ratio", _bad_ratio()),
    ]
    case = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        case = case.when(rule, name)
    return case


def with_reason(dpo: DataFrame, project: str | None = None, **options) -> DataFrame:
    """Each row with its `reason`: of another project, rejected by a rule, a later duplicate, or null for kept rows."""
    other = (F.col("project_id") != project) if project else F.lit(False)
    df = prepared(dpo, "input", "chosen", "rejected")
    df = df.withColumn("reason", F.when(other, "project_id_mismatch").otherwise(reject_reason(**options)))
    key = F.md5(F.concat_ws("\u0001", *(F.col(f"_made.{t}.dense") for t in ("input", "chosen", "rejected"))))
    df = df.withColumn("_key", key).drop("_made")
    rank = F.row_number().over(Window.partitionBy("_key", F.col("reason").isNull()).orderBy("created_at", "id"))
    return df.withColumn("_rank", rank).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_rank") > 1), "duplicate").otherwise(F.col("reason"))).drop("_rank", "_key")


def curated(dpo: DataFrame, **options) -> DataFrame:
    return with_reason(dpo, **options).where("reason IS NULL").drop("reason")


def curate_report(dpo: DataFrame, **options) -> DataFrame:
    return with_reason(dpo, **options).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def build_pref(dpo: DataFrame, swap: bool = True, strip_reference: bool = False) -> DataFrame:
    """(source, candidate_a, candidate_b, label): the chosen text first, and the swapped twin."""
    source = T.strip_reference("input") if strip_reference else F.col("input")

    def side(order: str, a: str, b: str, label: int, suffix: str) -> Column:
        return F.struct(F.concat("id", F.lit(suffix)).alias("id"), F.col(a).alias("candidate_a"), F.col(b).alias("candidate_b"), F.lit(label).alias("label"), F.lit(order).alias("pair_order"))

    sides = [side("chosen_first", "chosen", "rejected", 1, "")] + [side("rejected_first", "rejected", "chosen", 0, "-swap")] * swap
    return dpo.select(F.col("id").alias("base_id"), source.alias("source_text"), "project_id", "created_at", F.explode(F.array(*sides)).alias("side")).select("base_id", "source_text", "project_id", "created_at", "side.*")


def split_counts(ruled: DataFrame, swap: bool = True, key: str = "id", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(project_id, part, n) of rows `with_reason`, in one pass: pairs of each split, and dropped rows of each reason."""
    kept = F.col("reason").isNull()
    part = F.coalesce("reason", T.choose_split(T.bucket(key), train, valid))
    return ruled.groupBy("project_id", part.alias("part")).agg(F.sum(F.when(kept, 2 if swap else 1).otherwise(1)).alias("n"))


def merge_counts(merged: DataFrame, tag: str = "section_pair_mined", labels: str = "labels") -> DataFrame:
    """Rows of a merged table, and those with the tag."""
    return merged.agg(F.count(F.lit(1)).alias("n_merged"), F.count_if(F.coalesce(F.array_contains(labels, tag), F.lit(False))).alias("n_tagged"))


def hash_split(pref: DataFrame, key: str = "base_id", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """The split of each row by a hash of its key, so twins stay together."""
    return pref.withColumn("score", T.bucket(key)).withColumn("split", T.choose_split(F.col("score"), train, valid))


def unique_pairs(pref: DataFrame) -> DataFrame:
    return pref.where((F.coalesce("pair_order", F.lit("chosen_first")) == "chosen_first") & (F.col("label") == 1))


def merge_pref(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, the first of each (source, a, b, label); rows of `first` come before those of `second`."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return first_by(both, ["source_text", "candidate_a", "candidate_b", "label"], "_part", "id").drop("_part")


def revision_pairs(dpo: DataFrame) -> DataFrame:
    """(draft, revised) without reference blocks; empty and equal ones go."""
    draft, revised = T.strip_reference("rejected", both=False), T.strip_reference("chosen", both=False)
    df = dpo.select("id", "project_id", draft.alias("draft"), revised.alias("revised"))
    return df.where("draft <> '' AND revised <> '' AND draft <> revised")


def distinct_texts(pref: DataFrame) -> DataFrame:
    return pref.select(F.explode(F.array("source_text", "candidate_a", "candidate_b")).alias("text")).distinct()
