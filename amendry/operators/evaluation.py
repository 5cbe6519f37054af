"""Evaluation of scorers: ranked candidates, margins, folds, generations, and linear probes of activations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    own = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(own.orderBy(value)) + (ties - 1) / 2


def spearman(df: DataFrame, item: str, a: str, b: str, name: str = "spearman") -> DataFrame:
    """Rank correlation within each item; null where a side is constant."""
    ranked = df.withColumn("_a", average_rank(a, item)).withColumn("_b", average_rank(b, item))
    size = F.stddev_pop("_a") * F.stddev_pop("_b")
    return ranked.groupBy(item).agg(F.try_divide(F.covar_pop("_a", "_b"), F.nullif(size, F.lit(0.0))).alias(name))


def score_hard_eval(cands: DataFrame, item: str = "item") -> DataFrame:
    """Per item: top-1 hit, strictly agreeing pairs, pairs, and rank correlation of score and length.

    `cands` has a row for each candidate with its gold_rank from 1, score, index and length.
    """
    a, b = cands.alias("a"), cands.alias("b")
    pairs = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col("a.gold_rank") < F.col("b.gold_rank")))
    agree = pairs.groupBy(F.col(f"a.{item}").alias(item)).agg(F.count_if(F.col("a.score") > F.col("b.score")).alias("pairwise_agree"), F.count(F.lit(1)).alias("pairwise_total"))
    best = cands.groupBy(item).agg(F.min_by("cand", "gold_rank").alias("best_human"), F.max_by("cand", F.struct("score", (-F.col("gold_rank")).alias("r"))).alias("best_model"))
    return best.join(agree, item).join(spearman(cands, item, "score", "length"), item).withColumn("top1_hit", F.col("best_human") == F.col("best_model"))


def hard_eval_totals(items: DataFrame) -> DataFrame:
    """One row over the items of `score_hard_eval`: top-1 and pairwise accuracy with their counts, and the mean correlation."""
    hits, agree, total = F.count_if("top1_hit"), F.sum("pairwise_agree"), F.sum("pairwise_total")
    return items.agg(
        F.count(F.lit(1)).alias("n_labeled"), hits.alias("top1_hits"), F.try_divide(hits, F.count(F.lit(1))).alias("top1_accuracy"), agree.alias("pairwise_agree"),
        total.alias("pairwise_total"), F.try_divide(agree, total).alias("pairwise_accuracy"), F.avg("spearman").alias("mean_spearman"),
    )


def margin_stats(scores: DataFrame, item: str = "item") -> DataFrame:
    """Per pair of candidates (a before b by gold rank): n, win rate, mean, median, least and largest s(a) - s(b)."""
    a, b = scores.alias("a"), scores.alias("b")
    pairs = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col("a.cand") < F.col("b.cand")))
    m = F.col("a.score") - F.col("b.score")
    return pairs.groupBy(F.col("a.cand").alias("cand_a"), F.col("b.cand").alias("cand_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((m > 0).cast("double")).alias("win_rate"), F.avg(m).alias("mean_margin"), F.median(m).alias("median_margin"), F.min(m).alias("min_margin"), F.max(m).alias("max_margin")
    )


def relative_position(scores: DataFrame, item: str = "item", least_span: float = 1e-3) -> DataFrame:
    """(model - copy) / (human - copy) of each item whose human text is far enough above the copy, the three margins, and
    the names in order of their scores. Items that lack one of the three take no part."""
    wide = scores.groupBy(item).pivot("cand", ["human", "model", "copy"]).agg(F.first("score")).where("human IS NOT NULL AND model IS NOT NULL AND copy IS NOT NULL")
    span = F.col("human") - F.col("copy")
    names = F.array_sort(F.array(*(F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(("human", "model", "copy")))))
    df = wide.select(item, F.transform(names, lambda x: x["name"]).alias("order"), (F.col("human") - F.col("model")).alias("human_model"), (F.col("model") - F.col("copy")).alias("model_copy"), span.alias("human_copy"))
    return df.withColumn("position", F.when(F.col("human_copy") > least_span, F.col("model_copy") / F.col("human_copy")))


def position_summary(positions: DataFrame) -> DataFrame:
    """Items, mean and median position, and the share of positions between copy and human."""
    p = F.col("position")
    return positions.agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_position"), F.median(p).alias("median_position"), F.avg(F.when(p.isNotNull(), ((p > 0) & (p < 1)).cast("double"))).alias("between_0_1"))


def classification_report(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Accuracy, log loss and per-class precision, recall, F1 and support of binary predictions, in one aggregation."""
    guess, y = (F.col(p) >= 0.5).cast("int"), F.col(label)
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    cells = {f"n{a}{b}": F.count_if((y == a) & (guess == b)) for a in (0, 1) for b in (0, 1)}
    df = df.agg(F.count(F.lit(1)).alias("n"), F.avg((y == guess).cast("double")).alias("accuracy"), F.avg(-F.log(F.when(y == 1, clipped).otherwise(1 - clipped))).alias("log_loss"), *(v.alias(k) for k, v in cells.items()))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    for c in (0, 1):
        hit, called, real = F.col(f"n{c}{c}"), F.col(f"n0{c}") + F.col(f"n1{c}"), F.col(f"n{c}0") + F.col(f"n{c}1")
        df = df.withColumns({f"precision_{c}": ratio(hit, called), f"recall_{c}": ratio(hit, real), f"support_{c}": real, f"f1_{c}": ratio(2 * hit, called + real)})
    df = df.withColumn("macro_f1", (F.col("f1_0") + F.col("f1_1")) / 2)
    weighted = (F.col("f1_0") * F.col("support_0") + F.col("f1_1") * F.col("support_1")) / F.col("n")
    return df.withColumn("weighted_f1", weighted).drop(*cells)


def fold_summary(folds: DataFrame, *by: str) -> DataFrame:
    """Micro (weighted by rows) and macro means over folds."""
    n = F.col("n")
    return folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), (F.sum(F.col("accuracy") * n) / F.sum(n)).alias("micro_accuracy"), F.avg("accuracy").alias("macro_accuracy"),
        (F.sum(F.col("log_loss") * n) / F.sum(n)).alias("micro_log_loss"), F.avg("log_loss").alias("macro_log_loss"),
    )


def weak_folds(folds: DataFrame, model: str = "model", most: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(model).orderBy("accuracy", "project_id"))
    return folds.withColumn("weakness", rank).where(F.col("weakness") <= most)


def encoder_compare(reports: DataFrame, most: int = 3) -> DataFrame:
    """The last report of each model by its source, with its weakest folds, best micro accuracy first.

    `reports` has embedding_model, source, micro_accuracy, macro_accuracy, micro_log_loss and folds.
    """
    last = F.row_number().over(Window.partitionBy("embedding_model").orderBy(F.desc("source")))
    folds = F.array_sort(F.transform("folds", lambda f: F.struct(f["accuracy"].alias("accuracy"), f["project_id"].alias("project_id"))))
    df = reports.withColumn("_last", last).where("_last = 1").withColumn("weak_folds", F.slice(folds, 1, most))
    return df.select(F.col("embedding_model").alias("model"), "source", "micro_accuracy", "macro_accuracy", "micro_log_loss", "weak_folds").orderBy(F.desc("micro_accuracy"), "model")


def mode_summary(gens: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Per mode, over the ids that all modes have: n, mean score and mean length ratio of `generated` to `draft`."""
    ratio = F.length("generated") / F.greatest(F.length("draft"), F.lit(1))
    df = gens.where(F.col("mode").isin(*modes)).join(common_ids(gens, modes), "id", "left_semi")
    return df.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(ratio).alias("mean_length_ratio"))


def generation_summary(gens: DataFrame, modes: tuple[str, str]) -> DataFrame:
    """Per project and (project null) overall: wins, losses, ties and win rate of the first mode over the second.

    `gens` has a row (id, project_id, mode, score); ids that lack one of the modes take no part.
    """
    wide = gens.groupBy("id", "project_id").pivot("mode", list(modes)).agg(F.first("score")).where(F.col(modes[0]).isNotNull() & F.col(modes[1]).isNotNull())
    a, b = F.col(modes[0]), F.col(modes[1])
    wins, losses = F.count_if(a > b), F.count_if(a < b)
    return wide.rollup("project_id").agg(F.count(F.lit(1)).alias("n"), wins.alias("wins"), losses.alias("losses"), F.count_if(a == b).alias("ties"), (wins / F.greatest(wins + losses, F.lit(1))).alias("win_rate"))


def common_ids(gens: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    return gens.where(F.col("mode").isin(*modes)).groupBy("id").agg(F.countDistinct("mode").alias("k")).where(F.col("k") == len(modes)).select("id")


def probe_directions(acts: DataFrame) -> DataFrame:
    """(layer, project_id, v, threshold, n_train): the unit direction and threshold learned from all other projects.

    Train sums are totals minus the project's own, so no fold is scanned again.
    """
    zipped = F.zip_with("draft", "revised", lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    flat = acts.select("project_id", "layer", F.posexplode(zipped).alias("pos", "x"))
    own = flat.groupBy("layer", "project_id", "pos").agg(F.sum("x.a").alias("sa"), F.sum("x.b").alias("sb"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("layer", "pos")
    rest = own.select("layer", "project_id", "pos", *((F.sum(c).over(total) - F.col(c)).alias(c) for c in ("sa", "sb", "n"))).where("n > 0")
    diff, middle = (F.col("sb") - F.col("sa")) / F.col("n"), (F.col("sb") + F.col("sa")) / (2 * F.col("n"))
    packed = rest.select("layer", "project_id", "n", F.struct("pos", diff.alias("d"), middle.alias("m")).alias("x")).groupBy("layer", "project_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("n").alias("n_train"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["d"] * x["d"]))
    df = packed.withColumn("_size", size).where("_size > 0").withColumn("v", F.transform("x", lambda x: x["d"] / F.col("_size")))
    threshold = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["d"] / F.col("_size") * x["m"])
    return df.select("layer", "project_id", "v", threshold.alias("threshold"), "n_train")


def probe(acts: DataFrame) -> DataFrame:
    """Per (layer, project): accuracy of single vectors against the threshold, and of pair differences."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    df = acts.join(probe_directions(acts), ["layer", "project_id"])
    df = df.withColumn("_d", dot("draft", "v")).withColumn("_r", dot("revised", "v"))
    hit = ((F.col("_r") > F.col("threshold")).cast("int") + (F.col("_d") <= F.col("threshold")).cast("int")) / 2
    return df.groupBy("layer", "project_id").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("single_accuracy"), F.avg((F.col("_r") > F.col("_d")).cast("double")).alias("pair_accuracy"))


def layer_profile(acts: DataFrame) -> DataFrame:
    """Micro accuracies of each layer."""
    n = F.col("n")
    return probe(acts).groupBy("layer").agg(F.sum("n").alias("n"), (F.sum(F.col("single_accuracy") * n) / F.sum(n)).alias("single_micro"), (F.sum(F.col("pair_accuracy") * n) / F.sum(n)).alias("pair_micro"))


def best_layers(acts: DataFrame) -> DataFrame:
    top = lambda c: F.max_by("layer", F.struct(F.round(c, 9), -F.col("layer")))
    return layer_profile(acts).agg(top("single_micro").alias("best_single"), top("pair_micro").alias("best_pair"))
