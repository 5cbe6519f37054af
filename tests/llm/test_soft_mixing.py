import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from amendry.llm.soft_mixing import fit_rates, memberships, mixed, mixing_rates, fit_domains, _rate


def corpus(spark):
    words = {"en": "the of and to in", "fr": "le la et les des", "de": "der die und das nicht"}
    rows = [(i, " ".join((words[d] + f" w{i % 5}").split() * (1 + i % 4)), d, None) for i, d in enumerate(["en"] * 30 + ["fr"] * 12 + ["de"] * 6)]
    rows += [(100, None, "en", 1), (101, " ", None, 2), (102, "the le der", "en", 3), (None, "the", "en", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long")


def test_targets_are_met_and_rates_match_numpy(spark):
    df = corpus(spark)
    labelled = df.where("doc_id % 2 = 0").select("doc_id", "lang")
    rates = mixing_rates(df, labelled, "lang").collect()
    assert {r.doc_id: r.domain for r in rates if r.doc_id < 48} == {i: d for i, d in enumerate(["en"] * 30 + ["fr"] * 12 + ["de"] * 6)}
    n, p, r = np.array([x.n_tokens for x in rates], float), np.array([x.posterior for x in rates]), np.array([x.rate for x in rates])
    assert (r >= 0).all() and len(rates) == 51 and np.allclose(p.sum(1), 1)
    assert np.allclose((n * r) @ p, n.sum() / 3, rtol=1e-4)
    mass, own = n @ p, np.ones(len(n))
    for _ in range(2000):
        own = np.maximum(0, own - p @ (((n * own) @ p - n.sum() / 3) / mass))
    assert np.allclose((n * own) @ p, (n * r) @ p, rtol=1e-4)


def test_posteriors_match_plain_naive_bayes(spark):
    df = corpus(spark)
    rows = [(r.doc_id, (r.text or "").lower().split(), r.lang) for r in df.collect() if r.doc_id is not None]
    bucket = lambda w: (lambda h: (h - (1 << 64) if h >> 63 else h) % 4096)(xxhash.xxh64_intdigest(w.encode(), 42))
    counts = {d: Counter(bucket(w) for _, own, e in rows if e == d for w in own) for d in ("de", "en", "fr")}
    for r in mixing_rates(df, df.select("doc_id", "lang"), "lang").collect():
        own = next(w for d, w, _ in rows if d == r.doc_id)
        logs = [sum(math.log((c[bucket(w)] + 1) / (c.total() + 4096)) for w in own) * min(1, 16 / max(1, len(own))) for c in counts.values()]
        likely = [math.exp(x - max(logs)) for x in logs]
        assert r.posterior == pytest.approx([x / sum(likely) for x in likely], abs=1e-9)


def test_rows_of_one_id_with_different_texts(spark):
    df = spark.createDataFrame([(1, "the of and", "en"), (1, "the to in", "en"), (2, "le la les", "fr"), (2, "le la les", "fr")], "doc_id long, text string, lang string")
    rates = {r.doc_id: (r.n_tokens, r.domain) for r in mixing_rates(df, df.select("doc_id", "lang"), "lang").collect()}
    assert rates == {1: (6, "en"), 2: (6, "fr")}
    assert mixed(df, spark.createDataFrame([(1, 2.0), (2, 0.0)], "doc_id long, rate double")).count() == 4


def test_columns_with_names_of_the_operator(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d")], "doc_id long, copies string, copy string, _copy string, rate string")
    out = mixed(df, spark.createDataFrame([(1, 2.0)], "doc_id long, rate double"))
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a", "b", "c", "d")] * 2


def test_steps_that_run_out_are_an_error(spark):
    df = corpus(spark)
    with pytest.raises(ValueError, match="steps"):
        mixing_rates(df, df.select("doc_id", "lang"), "lang", most_steps=1)


def test_zero_targets_and_limits(spark):
    df = corpus(spark)
    rates = mixing_rates(df, df.select("doc_id", "lang"), "lang", weights={"fr": 1.0}, most_rate=3.0).collect()
    by = {r.doc_id: r.rate for r in rates}
    assert by[0] < 0.05 and by[31] == pytest.approx(3.0) and max(by.values()) <= 3.0
    with pytest.raises(ValueError):
        mixing_rates(df, df.select("doc_id", "lang"), "lang", weights={"xx": 1.0})


def test_tempered_targets_shrink_no_domain(spark):
    df = corpus(spark)
    names, model = fit_domains(df, df.select("doc_id", "lang"), "lang")
    members = memberships(df, names, model)
    steps, targets = fit_rates(members, names, temper=0.5)
    got = members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[k]).alias(d) for k, d in enumerate(names))).first()
    assert all(targets[d] >= got[d] - 1e-6 for d in names) and targets["de"] > 1.5 * got["de"]
    assert members.select(_rate(F.col("q"), steps, None).alias("r")).agg(F.min("r")).first()[0] > 0.9


def test_copies_follow_rates_and_keep_columns(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("rate"), F.lit("y").alias("_x"))
    rates = df.select("doc_id", (F.col("doc_id") % 4 * 0.7).alias("rate"))
    out = mixed(df.union(spark.createDataFrame([(None, "a", "b")], "doc_id long, rate string, _x string")), rates)
    assert out.columns == df.columns
    got = {r.g: r.n for r in out.groupBy((F.col("doc_id") % 4).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[None] == 1 and 0 not in got and all(abs(got[g] / 1000 - 0.7 * g) < 0.06 for g in (1, 2, 3))


def test_without_labels_or_rows(spark):
    df = corpus(spark)
    plain = mixing_rates(df, df.limit(0).select("doc_id", "lang"), "lang").collect()
    assert len(plain) == 51 and all(r.rate == 1.0 and r.domain is None for r in plain)
    assert mixing_rates(df.limit(0), df.select("doc_id", "lang"), "lang").count() == 0
