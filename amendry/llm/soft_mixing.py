"""Mixing sources to target weights with soft membership, in DataFrame operations only.

Method. A naive Bayes classifier over hashed words, fitted on a labelled table, gives each document a posterior over
domains. Nonnegative rates r solve the least squares problem  min sum_k (S_k - T_k)^2 / N_k  with
S_k = sum_i n_i p_ik r_i, the expected tokens of domain k, T_k its target and N_k its expected tokens at rate 1.
Projected gradient solves it: in the metric that weighs documents by their tokens the gradient of r_i is
p_i . (S - T) / N, a step of 1 is safe, and the projection is max(0, .). An iteration is one aggregation to as many
numbers as there are domains; a document's rate follows from its posterior and those numbers, so no state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import beside, written

_BLANKS = r"[\x20\x09-\x0D]+"


def _buckets(text: Column, buckets: int) -> Column:
    """Bucket of each lower-cased word of a text."""
    words = F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str, buckets: int = 4096, most: int = 20_000, most_domains: int = 64) -> tuple[list[str], DataFrame]:
    """(names of the domains, table of bucket and log-likelihoods by domain) from at most `most` labelled rows.

    `labelled` has doc_id and the column `domain`; rows with a null are left out, an id with several domains takes the
    least, and of more than `most` ids those of least hash are taken. The table has `buckets` rows.
    """
    picked = (
        labelled.select("doc_id", F.col(domain).cast("string").alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
        .groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # A broadcast of at most `most` rows of an id and a short name.
    words = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("domain", F.explode(_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = written(words.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).orderBy("domain").limit(most_domains + 1).collect()}
    if len(totals) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    names = sorted(totals)
    wide = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts.groupBy("bucket").pivot("domain", names).sum("n"), "bucket", "left") if names else None
    if wide is None:
        return [], docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    likelihoods = [F.log((F.coalesce(F.col(f"`{name}`"), F.lit(0)) + 1.0) / float(totals[name] + buckets)).alias(f"l{k}") for k, name in enumerate(names)]
    return names, written(wide.select("bucket", *likelihoods), "likelihoods")


def memberships(docs: DataFrame, names: list[str], model: DataFrame, buckets: int = 4096, evidence: float = 16.0, grain: int = 128) -> DataFrame:
    """(doc_id, n_tokens, p, q): words of each document, its posterior over `names`, an array of double, and the posterior
    rounded to 1 / `grain` and scaled to sum to 1.

    All words of a document count, but together as much as `evidence` words, so that posteriors stay soft. Documents
    without words have equal memberships. Rows that share a doc_id are one document; rows without one are left out.
    """
    words = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode_outer(_buckets(F.col("text"), buckets)).alias("bucket"))
    # The model has `buckets` rows whatever the corpus.
    sums = words.join(F.broadcast(model), "bucket", "left").groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))))
    if not names:
        return sums.withColumns({x: F.array().cast("array<double>") for x in ("p", "q")})
    weight = F.least(F.lit(1.0), F.lit(evidence) / F.greatest(F.col("n_tokens"), F.lit(1)))
    scores = F.array(*(F.col(f"s{k}") * weight for k in range(len(names))))
    likely = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    df = sums.withColumn("scores", scores).withColumn("likely", likely).withColumn("share", total("likely"))
    df = df.withColumn("p", F.transform("likely", lambda x: x / F.col("share")))
    df = df.withColumn("grains", F.transform("p", lambda x: F.round(x * grain))).withColumn("share", total("grains"))
    return df.select("doc_id", "n_tokens", "p", F.transform("grains", lambda x: x / F.col("share")).alias("q"))


def _rate(q: Column, steps: list[list[float]], most_rate: float | None) -> Column:
    """The rate of a rounded posterior after the projected steps, from 1 on."""
    if not steps:
        return F.lit(1.0)
    top = F.lit(float("inf") if most_rate is None else most_rate)
    table = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    dot = lambda g: F.aggregate(F.zip_with(q, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(table, F.lit(1.0), lambda r, g: F.least(top, F.greatest(F.lit(0.0), r - dot(g))))


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float] | None = None, temper: float | None = None, total: float | None = None, tolerance: float = 1e-7, most_steps: int = 400, most_rate: float | None = None) -> tuple[list[list[float]], dict[str, float]]:
    """(gradient steps, targets): what `_rate` needs, from a few numbers per iteration.

    `weights` are shares by domain (equal without; domains that they don't name get 0); with `temper` the shares are
    the expected tokens to that power. `total` tokens are aimed at: the tokens there are, or with `temper` as many as
    leave no domain below its present size. Domains without tokens take no part.

    Documents with equal rounded posteriors have equal rates; the expected tokens are those of the posteriors as they
    are. Iterations end when all targets are met to `tolerance` of the total, or when expected tokens no longer change
    because nonnegative rates can't do better; if neither comes about in `most_steps`, that is an error.
    """
    tokens = [F.sum(F.col("p")[k] * F.col("n_tokens")).alias(f"t{k}") for k in range(len(names))]
    groups = written(members.groupBy("q").agg(F.sum("n_tokens").cast("double").alias("n"), *tokens), "memberships")
    sums = lambda rate: [float(x or 0) for x in groups.agg(*(F.sum(F.col(f"t{k}") * rate) for k in range(len(names)))).first()] if names else []
    mass = sums(F.lit(1.0))
    if weights and (unknown := set(weights) - set(names)):
        raise ValueError(f"no labelled documents of {sorted(unknown)}")
    share = [(m**temper if temper is not None else (weights.get(d, 0.0) if weights else 1.0)) if m > 0 else 0.0 for d, m in zip(names, mass)]
    if not sum(share):
        return [], dict.fromkeys(names, 0.0)
    share = [s / sum(share) for s in share]
    if total is None:
        total = max(m / s for m, s in zip(mass, share) if s > 0) if temper is not None else sum(mass)
    targets, steps, now = [s * total for s in share], [], mass
    while max(abs(s - t) for s, t in zip(now, targets)) > tolerance * total:
        if len(steps) == most_steps:
            raise ValueError(f"expected tokens {now} still move toward the targets {targets} after {most_steps} steps")
        steps.append([(s - t) / m if m > 0 else 0.0 for s, t, m in zip(now, targets, mass)])
        before, now = now, sums(_rate(F.col("q"), steps, most_rate))
        if max(abs(a - b) for a, b in zip(before, now)) <= 1e-3 * tolerance * total:
            break
    return steps, dict(zip(names, targets))


def mixing_rates(docs: DataFrame, labelled: DataFrame, domain: str, most_rate: float | None = None, buckets: int = 4096, **aims) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (by the domains in order of names) and rate of each document.

    The expected tokens of each domain at these rates are as near to the targets as nonnegative rates allow. See
    `memberships` for odd rows and `fit_rates` for the aims. Without labelled rows all rates are 1 and domain is null.
    """
    names, model = fit_domains(docs, labelled, domain, buckets)
    members = written(memberships(docs, names, model, buckets), "members")
    steps, _ = fit_rates(members, names, most_rate=most_rate, **aims)
    p = F.col("p")
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int")) if names else F.lit(None).cast("string")
    return members.select("doc_id", "n_tokens", best.alias("domain"), p.alias("posterior"), _rate(F.col("q"), steps, most_rate).alias("rate"))


def mixed(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """The documents, each as often as its rate says: the whole part, and once more with the rest's probability.

    The draw is a hash of the id, so it can be repeated. Columns stay, whatever their names; rows without a rate come
    once, and rows that share an id come equally often.
    """
    copies, copy = beside(docs.columns, "copies", "copy")
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")
    number = F.sequence(F.lit(1), times.cast("int"))
    drawn = rates.select("doc_id", F.when(times > 0, number).otherwise(F.slice(F.array(F.lit(1)), 1, 0)).alias(copies))
    df = docs.join(drawn, "doc_id", "left")
    return df.withColumn(copy, F.explode(F.coalesce(copies, F.array(F.lit(1))))).select(*docs.columns)
