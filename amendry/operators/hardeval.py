"""Ranked-candidate evaluation sets: controlled degradations, windows, selection, validation, human ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amendry.functions import hooks
from amendry.functions import text as T
from amendry.operators.curation import first_by
from amendry.plans.scratch import written

# The order of candidates by definition.
GOLD_RANK = ("human", "deg-join", "deg-split", "base", "deg-reverse")


def degradations(df: DataFrame, text: str = "edited_text") -> DataFrame:
    return df.withColumn("deg_join", T.degrade_join(text)).withColumn("deg_split", T.degrade_split(text)).withColumn("deg_reverse", T.degrade_reverse(text))


def candidate_set(df: DataFrame, base: str = "base_text", human: str = "human_text") -> DataFrame:
    """Adds `candidates` in gold order; items of which two degradations or texts are equal when stripped go."""
    # Heading and paragraphs are taken apart once for all three. Exploding a single struct keeps the optimizer from
    # copying expressions into what reads them.
    own = df.columns
    head, body = T.heading_and_body(human)
    df = df.withColumn("_human", F.explode(F.array(F.struct(head.alias("head"), body.alias("body"))))).withColumn("_parts", F.explode(F.array(T.paragraphs(F.col("_human.body")))))
    head, lines = F.col("_human.head"), F.filter(T.split_lines("_human.body"), lambda x: T.strip(x) != "")
    joined = {"deg-join": F.array_join("_parts", "\n"), "deg-split": F.array_join(lines, "\n\n"), "deg-reverse": F.array_join(F.reverse("_parts"), "\n\n")}
    made = {c: T.with_heading(head, x) for c, x in joined.items()}
    columns = {"human": human, "base": base} | {c: "_" + c.replace("-", "_") for c in made}
    maker = {"human": ("human", "real-edit"), "base": ("copy", "identity")}
    make = lambda c: F.struct(F.lit(c).alias("id"), F.col(columns[c]).alias("text"), F.lit(maker.get(c, ("script", c))[0]).alias("generator"), F.lit(maker.get(c, ("script", c))[1]).alias("prompt_tag"))
    once = F.explode(F.array(F.struct(*(x.alias(columns[c]) for c, x in made.items()))))
    df = df.withColumn("_made", once).select(*own, "_made.*")
    df = df.withColumn("_seen", F.explode(F.array(F.array(*(T.strip(columns[c]) for c in GOLD_RANK)))))
    # Human and base may be equal; each degradation must be unlike all others.
    alone = [F.size(F.array_remove("_seen", F.get("_seen", F.lit(i)))) == len(GOLD_RANK) - 1 for i, c in enumerate(GOLD_RANK) if c in made]
    df = df.where(alone[0] & alone[1] & alone[2]).withColumn("candidates", F.array(*map(make, GOLD_RANK)))
    return df.drop("_seen", *(columns[c] for c in made))


def best_section(pairs: DataFrame, min_paragraphs: int = 3) -> DataFrame:
    """Per section the pair whose paragraph count changes most, then the shortest edit, then the first."""
    usable = ~T.has_markers("source_text") & ~T.has_markers("edited_text")
    df = pairs.where(usable & (F.col("paragraph_count_source") >= min_paragraphs) & (F.col("paragraph_count_edited") >= min_paragraphs))
    delta = F.abs(F.col("paragraph_count_edited") - F.col("paragraph_count_source"))
    return first_by(df, ["project_id", "path", "section_key"], F.desc(delta), F.length("edited_text"), "line_no")


def expand_windows(df: DataFrame, n: int = 3, min_mean: int = 20, pieces: Callable[[Column], Column] | None = None) -> DataFrame:
    """The whole section and every window of n paragraphs at the same start on both sides; human_paragraphs counts those
    of the human text.

    `pieces` counts the tokens of a text, as an expression to which blanks between paragraphs add nothing: each heading
    and paragraph is counted once, windows add them up as base_tokens and human_tokens.
    """
    sides = {x: F.concat(T.trim_ends(x), F.lit("\n")) for x in ("source_text", "edited_text")}
    df = df.where(~T.has_markers("source_text") & ~T.has_markers("edited_text")).withColumns(sides)
    parts = {}
    for side in ("source", "edited"):
        head, body = T.heading_and_body(f"{side}_text")
        parts |= {f"_head_{side}": head, f"_parts_{side}": T.paragraphs(body)}
    df = df.withColumns(parts)
    if pieces:
        df = df.withColumns({f"_tokens_{s}": F.transform(F.concat(F.array(f"_head_{s}"), f"_parts_{s}"), pieces) for s in ("source", "edited")})
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    tokens = lambda side, i: F.get(F.col(f"_tokens_{side}"), F.lit(0)) + total(F.slice(F.col(f"_tokens_{side}"), i + 2, n))
    counts = lambda f: [f(side).alias(f"{name}_tokens") for side, name in (("source", "base"), ("edited", "human"))] if pieces else []
    mean = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)) / F.size(c)
    fewest = F.least(F.size("_parts_source"), F.size("_parts_edited"))
    fine = (fewest >= n) & (mean(F.col("_parts_source")) >= min_mean) & (mean(F.col("_parts_edited")) >= min_mean)
    whole = F.struct(F.lit("section").alias("unit"), F.lit(0).alias("window_start"), F.col("paragraph_count_edited").cast("int").alias("window_paragraphs"), F.col("source_text").alias("base_text"), F.col("edited_text").alias("human_text"), F.size("_parts_edited").alias("human_paragraphs"), *counts(lambda side: total(F.col(f"_tokens_{side}"))))
    cut = lambda side, i: T.window(F.col(f"_head_{side}"), F.col(f"_parts_{side}"), i, n)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(fewest - n, F.lit(0))),
        lambda i: F.struct(F.lit("window").alias("unit"), i.alias("window_start"), F.lit(n).alias("window_paragraphs"), cut("source", i).alias("base_text"), cut("edited", i).alias("human_text"), F.lit(n).alias("human_paragraphs"), *counts(lambda side: tokens(side, i))),
    )
    rows = F.when(F.coalesce(fine, F.lit(False)), F.concat(F.array(whole), windows)).otherwise(F.array(whole))
    return df.withColumn("_w", F.explode(rows)).select(*[c for c in df.columns if not c.startswith("_")], "_w.*")


def _order(text: str | None = None, length: str | None = None) -> Column:
    """Largest change of paragraphs first, then whole sections, then short bases, then by line_no."""
    delta = F.abs(F.col("paragraph_count_edited") - F.col("paragraph_count_source"))
    size = F.col(length) if length else F.length(text)
    return F.struct((-delta).alias("a"), (F.col("unit") != "section").cast("int").alias("b"), size.alias("c"), F.col("line_no").cast("long").alias("d"))


def greedy_pick(pool: DataFrame, n_items: int = 24, per_project: int = 8, n: int = 3, length: str | None = None) -> DataFrame:
    """Items in order of (section change, whole sections first, base length), spread over projects and sections.

    A choice depends only on earlier choices of its own section (same window key, or a window that starts less than n
    paragraphs from a chosen one), so each section is folded by itself, then projects are capped and the best kept.
    Of items with one unit and window key all but the first clash with whatever the first clashes with, or with it, so
    a combining aggregation leaves one of each before the fold: its arrays grow with the windows of the longest section.
    `length` names a column with the length of base_text, if the text itself isn't there.
    """
    df = pool.withColumn("_order", _order("base_text", length))
    item = F.struct("_order", "unit", "window_start", "window_paragraphs")
    first = df.groupBy("project_id", "section_key", "unit", "window_start", "window_paragraphs").agg(F.min("_order").alias("_order"))
    sections = first.groupBy("project_id", "section_key").agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(
            taken,
            lambda t: ((t["window_start"] == x["window_start"]) & (t["window_paragraphs"] == x["window_paragraphs"]))
            | ((t["unit"] == "window") & (x["unit"] == "window") & (F.abs(t["window_start"] - x["window_start"]) < n)),
        )
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    taken = F.aggregate("_items", F.slice(F.col("_items"), 1, 0), step)
    chosen = sections.select("project_id", "section_key", F.explode(taken).alias("_t")).select("project_id", "section_key", F.col("_t._order.d").alias("line_no"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("_order"))
    df = df.join(chosen, ["project_id", "section_key", "line_no"]).withColumn("_rank", rank).where(F.col("_rank") <= per_project)
    return df.orderBy("_order").limit(n_items).drop("_order", "_rank")


ITEM = ["project_id", "path", "section_key", "unit", "window_start"]


def build_hard_eval(
    pairs: DataFrame, n_items: int = 24, per_project: int = 8, n: int = 3, min_paragraphs: int = 3, max_tokens: int = 512,
    count: Callable[[str, str], int] | None = None, pieces: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Items with candidates, picked from all windows of the best sections that pass every rule.

    Before the pick go windows whose human body has too few paragraphs, items of which a candidate and the base have
    more than `max_tokens`, and those of which degradations coincide. Tokens are counted by `pieces` (see
    `expand_windows`), or by a user's `count` of base and candidate. Ties are broken by a digest of the item's keys.
    Only keys and sizes are kept for the pick; texts are made again for the sections of the items picked.
    """
    best = written(best_section(pairs, min_paragraphs), "best")

    def items(sections: DataFrame) -> DataFrame:
        pool = expand_windows(sections, n, pieces=pieces).where(F.col("human_paragraphs") >= min_paragraphs)
        if pieces:
            pool = pool.where((2 * F.col("base_tokens") <= max_tokens) & (F.col("base_tokens") + F.col("human_tokens") <= max_tokens)).drop("base_tokens", "human_tokens")
        pool = candidate_set(pool.drop("human_paragraphs"))
        return pool if pieces else hooks.fits_tokens(pool, max_tokens, count)

    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *ITEM)), 1, 15), 16, 10).cast("long")
    pool = items(best).select(*ITEM, "window_paragraphs", "paragraph_count_source", "paragraph_count_edited", F.length("base_text").alias("base_length"), digest.alias("line_no"))
    picked = greedy_pick(written(pool, "pool"), n_items, per_project, n, length="base_length")
    picked = written(picked.select(*ITEM, F.col("line_no").alias("_tie")), "picked")
    chosen = best.join(picked.select("project_id", "path", "section_key").distinct(), ["project_id", "path", "section_key"], "left_semi")
    return items(chosen).join(picked, ITEM).withColumn("line_no", F.col("_tie")).drop("_tie").orderBy(_order("base_text"))


def validate(items: DataFrame) -> DataFrame:
    """The first error of each labelled item, or null."""
    ids = F.transform("candidates", lambda c: c["id"])
    labelled = F.col("status") == "labeled"
    permutation = (F.size("human.rank") == F.size(ids)) & (F.size(F.array_except(F.col("human.rank"), ids)) == 0) & (F.size(F.array_except(ids, F.col("human.rank"))) == 0)
    error = (
        F.when(F.size("candidates") < 2, "few_candidates")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_ids")
        .when(F.coalesce(F.col("human.best_id"), F.lit("")) == "", "no_best")
        .when(~F.array_contains(ids, F.col("human.best_id")), "unknown_best")
        .when(~F.coalesce(permutation, F.lit(False)), "bad_rank")
        .when(T.strip(F.coalesce("base_text", F.lit(""))) == "", "blank_base")
    )
    return items.withColumn("error", F.when(labelled, error))


def rank_pairs(items: DataFrame, rank: str = "rank", item: str = "id") -> DataFrame:
    """(item, better, worse) of all i < j of a best-first list."""
    pairs = F.flatten(F.transform(rank, lambda a, i: F.transform(F.slice(F.col(rank), i + 2, F.size(rank)), lambda b: F.struct(a.alias("better"), b.alias("worse")))))
    return items.select(item, F.explode(pairs).alias("p")).select(item, "p.*")


def three_way(items: DataFrame, model_texts: DataFrame) -> DataFrame:
    """Items with (human, model, copy) candidates; `missing` marks those without a model text."""
    human = F.filter("candidates", lambda c: c["id"] == "human")
    df = items.join(model_texts.select("id", F.col("text").alias("_model")), "id", "left")
    make = lambda c, text: F.struct(F.lit(c).alias("id"), text.alias("text"))
    out = df.withColumn("candidates", F.array(make("human", F.get(human, F.lit(0))["text"]), make("model", F.col("_model")), make("copy", F.col("base_text"))))
    return out.withColumn("missing", F.col("_model").isNull()).drop("_model")


def parse_ranked_preview(df: DataFrame, text: str = "text") -> DataFrame:
    """(item, position, cand, body) of `## item` headings with `### `cand` (generator)` headings under them; per row, no shuffle."""
    item_head, cand_head = r"\A## (he-\S+)\s*\z", r"\A### (?:Candidate: )?`([^`]+)`.*\z"
    lines = F.transform(T.split_lines(text), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"), F.regexp_extract(x, item_head, 1).alias("item"), F.regexp_extract(x, cand_head, 1).alias("cand")))
    df = df.select(T.split_lines(text).alias("_lines"), F.filter(lines, lambda s: (s["item"] != "") | (s["cand"] != "")).alias("_heads"))
    stop = lambda i: F.coalesce(F.get(F.col("_heads"), i + 1)["at"], F.size("_lines") + 1)
    item = lambda i: F.element_at(F.filter(F.transform(F.slice(F.col("_heads"), 1, i + 1), lambda h: h["item"]), lambda x: x != ""), -1)
    begun = lambda i: F.array_max(F.transform(F.filter(F.slice(F.col("_heads"), 1, i + 1), lambda h: h["item"] != ""), lambda h: h["at"]))
    place = lambda i: F.size(F.filter(F.slice(F.col("_heads"), 1, i + 1), lambda h: (h["cand"] != "") & (h["at"] > begun(i))))
    found = F.transform("_heads", lambda h, i: F.struct(h["cand"].alias("cand"), F.when(begun(i).isNotNull(), item(i)).alias("item"), place(i).alias("position"), T.strip(F.array_join(F.slice(F.col("_lines"), h["at"] + 1, stop(i) - h["at"] - 1), "\n")).alias("body")))
    return df.select(F.explode(F.filter(found, lambda f: (f["cand"] != "") & f["item"].isNotNull())).alias("f")).select("f.item", "f.position", "f.cand", "f.body")


def apply_ranks(items: DataFrame, preview: DataFrame) -> DataFrame:
    """Items with best_id and rank from the preview, and the first disagreement in `error` (then nothing is applied)."""
    ranks = preview.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("position", "cand", "body"))).alias("_p"))
    df = items.join(ranks.withColumnRenamed("item", "_item"), F.col("id") == F.col("_item"), "full_outer")
    rank = F.transform("_p", lambda x: x["cand"])
    ids = F.transform("candidates", lambda c: c["id"])
    bodies = F.map_from_arrays(ids, F.transform("candidates", lambda c: T.strip(c["text"])))
    error = (
        F.when(F.col("_item").isNull(), "not_in_preview").when(F.col("id").isNull(), "unknown_item")
        .when(F.sort_array(rank) != F.sort_array(ids), "candidates_differ")
        .when(F.exists("_p", lambda x: F.element_at(bodies, x["cand"]) != x["body"]), "body_changed")
    )
    out = df.withColumn("error", error).withColumn("rank", F.when(F.col("error").isNull(), rank)).withColumn("best_id", F.get("rank", F.lit(0)))
    return out.select(F.coalesce("id", "_item").alias("id"), "best_id", "rank", "error")
