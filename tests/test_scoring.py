import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from amendry.functions import vectors as V
from amendry.operators import evaluation as E
from amendry.operators import models, scoring


def vectors(spark, n=12, d=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, f"p{i % 3}", *(rng.normal(size=d).tolist() for _ in range(3)), float(i), float(2 * i), float(i + 1), int(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, project_id string, src array<double>, a array<double>, b array<double>, len_src double, len_a double, len_b double, label int")


def test_features_match_numpy(spark):
    df = vectors(spark)
    for r in df.select("*", V.preference_features("src", "a", "b", "len_src", "len_a", "len_b").alias("f"), V.pointwise_features("src", "a", "len_src", "len_a").alias("g"), V.truncate_normalize("a", 2).alias("t")).collect():
        s, a, b = map(np.array, (r.src, r.a, r.b))
        want = np.concatenate([s, a, b, a - b, abs(a - b), s - a, s - b, abs(s - a), abs(s - b), [s @ a, s @ b, a @ b, s @ a - s @ b, r.len_src, r.len_a, r.len_b, r.len_a - r.len_b, abs(r.len_a - r.len_b)]])
        assert np.allclose(r.f, want) and len(r.f) == 9 * 4 + 9
        assert np.allclose(r.g, np.concatenate([s, a, s - a, abs(s - a), [s @ a, r.len_src, r.len_a, r.len_a - r.len_src, abs(r.len_a - r.len_src)]]))
        assert np.allclose(r.t, a[:2] / np.linalg.norm(a[:2]))


def test_symmetric_scores_mirror_and_sum_to_one(spark):
    w = scoring.literal_weights([math.sin(i) for i in range(45)])
    df = vectors(spark)
    one = {r.id: r for r in scoring.score_pairwise(df, w).collect()}
    swapped = df.select("id", "src", F.col("b").alias("a"), F.col("a").alias("b"), "len_src", F.col("len_b").alias("len_a"), F.col("len_a").alias("len_b"))
    for r in scoring.score_pairwise(swapped, w).collect():
        assert r.score_a == pytest.approx(one[r.id].score_b) and r.score_a + r.score_b == pytest.approx(1)
    assert all(r.score_a == r.p_ab for r in scoring.score_pairwise(df, w, symmetric=False).collect())


def test_ties_and_softplus(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4, 0.6)], "score_a double, score_b double")
    assert [r[0] for r in df.select(scoring.winner()).collect()] == ["A", "B"]
    big = spark.createDataFrame([(1000.0,), (-1000.0,)], "m double").select(V.softplus_of_minus("m").alias("x")).collect()
    assert [r.x for r in big] == [0.0, 1000.0]


def test_best_of_n_and_convergence(spark):
    df = spark.createDataFrame([("i", 0, 1.0, 1.0), ("i", 1, 1.0, 1.0), ("i", 2, 1.2, 1.0), ("j", 0, 0.0, 0.0)], "item string, cand_index int, score double, source_score double")
    found = {(r.item, r.cand_index): (r.rank, r.accepted) for r in scoring.best_of_n(df, min_margin=0.1).collect()}
    assert found == {("i", 2): (1, True), ("i", 0): (2, True), ("i", 1): (3, True), ("j", 0): (1, False)}
    c = spark.createDataFrame([(1.0, 0.6), (1.2, 0.6)], "score_revised double, score_current double")
    assert [r.converged for r in scoring.converged_bt(c).collect()] == [True, False]


def test_spearman_ties(spark):
    df = spark.createDataFrame([("x", 1.0, 3), ("x", 1.0, 3), ("x", 2.0, 5), ("y", 1.0, 1), ("y", 1.0, 2), ("z", 1.0, 1)], "item string, s double, n int")
    found = {r["item"]: r.spearman for r in E.spearman(df, "item", "s", "n").collect()}
    assert found["x"] == pytest.approx(1.0) and found["y"] is None and found["z"] is None


def test_probes_equal_a_fold_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i}", f"p{i % 4}", i % 2, rng.normal(size=5).tolist(), (rng.normal(size=5) + 0.4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id string, project_id string, layer int, draft array<double>, revised array<double>")
    for r in E.probe(df).collect():
        own = [x for x in rows if x[2] == r.layer and x[1] == r.project_id]
        rest = [x for x in rows if x[2] == r.layer and x[1] != r.project_id]
        d, v = np.mean([x[3] for x in rest], 0), np.mean([x[4] for x in rest], 0)
        u = (v - d) / np.linalg.norm(v - d)
        t = (d @ u + v @ u) / 2
        single = np.mean([(int(np.array(x[4]) @ u > t) + int(np.array(x[3]) @ u <= t)) / 2 for x in own])
        pair = np.mean([(np.array(x[4]) - x[3]) @ u > 0 for x in own])
        assert (r.n, r.single_accuracy, r.pair_accuracy) == (len(own), pytest.approx(single), pytest.approx(pair))


def separable(spark, n=120):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=n) > 0.2).astype(int)
    return spark.createDataFrame([(f"p{i % 3}", x[i].tolist(), int(y[i])) for i in range(n)], "project_id string, features array<double>, label int"), x, y


def test_pairwise_fit_is_optimal(spark):
    df, x, y = separable(spark)
    m = models.fit_pairwise(df, c=1.0)
    mean, std = x.mean(0), x.std(0)
    z, w = (x - mean) / std, np.array(m.weights) * std
    b = m.bias + np.array(m.weights) @ mean
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(z.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05  # C * sum of losses + |w|^2 / 2
    assert ((p > 0.5) == y).mean() > 0.9


def test_bt_fit_and_leave_one_project_out(spark):
    df, x, y = separable(spark)
    zero = F.transform("features", lambda v: v * 0)
    first = F.col("label") == 1
    pairs = df.select("project_id", F.when(first, F.col("features")).otherwise(zero).alias("better"), F.when(first, zero).otherwise(F.col("features")).alias("worse"))
    m = models.fit_bt(pairs)
    assert m.bias == 0 and m.weights[0] > 0 > m.weights[1]
    folds = models.lopo(df, max_iter=50)
    assert {r.project_id for r in folds.collect()} == {"p0", "p1", "p2"}
    s = models.lopo_summary(folds).first()
    assert s.folds == 3 and s.macro_accuracy > 0.85 and s.micro_log_loss < 0.4
    assert models.lopo(pairs, "bt", max_iter=50).count() == 3
    with pytest.raises(ValueError):
        models.lopo(df.where("project_id = 'p0'"))
