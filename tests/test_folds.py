"""Leave-one-project-out in one pass: against fits of each fold alone, and by the gradient at the optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from amendry.operators import folds as L
from amendry.operators import models


def rows(spark, n=240, d=4, projects=5):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    x[:, 3] = 7.0  # doesn't vary
    y = (x @ [1.0, -0.1, 5.0, 0.0] + 0.5 * rng.normal(size=n) > -0.4).astype(int)
    project = [f"p{min(i % 9, projects - 1)}" for i in range(n)]  # one holds most rows
    data = [(p if p != "p1" else None, v.tolist(), int(t)) for p, v, t in zip(project, x, y)]
    return spark.createDataFrame(data, "project_id string, features array<double>, label int").repartition(3), np.array(["(unknown)" if p == "p1" else p for p in project]), x, y


def newton(z, y, c, intercept):
    """The optimum of c * sum of log losses + |w|^2 / 2 by Newton's method."""
    a = np.column_stack((z, np.ones(len(z)))) if intercept else z
    w, ridge = np.zeros(a.shape[1]), np.append(np.ones(z.shape[1]), [0.0] * intercept)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(c * a.T * (p * (1 - p)) @ a + np.diag(ridge + 1e-12), c * a.T @ (p - y) + ridge * w)
    return w


@pytest.mark.parametrize("block", [2, 256])
def test_folds_equal_fits_of_their_own(spark, block):
    df, project, x, y = rows(spark)
    found = {r.project_id: r for r in L.lopo(df, c=0.7, tol=1e-9, block=block).collect()}
    assert set(found) == set(project)
    for p, r in found.items():
        rest = project != p
        mean, std = x[rest].mean(0), x[rest].std(0)
        z = (x - mean) * np.divide(1, std, out=np.zeros(4), where=std > 1e-9)
        w = newton(z[rest], y[rest], 0.7, True)
        m = (z[~rest] @ w[:-1] + w[-1]) * (2 * y[~rest] - 1)
        assert (r.n, r.train_samples) == ((~rest).sum(), rest.sum())
        assert abs(r.accuracy - (m > 0).mean()) < 1e-9 and abs(r.log_loss - np.log1p(np.exp(-m)).mean()) < 1e-6
        inside = (z[rest] @ w[:-1] + w[-1]) * (2 * y[rest] - 1)
        assert abs(r.objective - (0.7 * np.log1p(np.exp(-inside)).sum() + w[:-1] @ w[:-1] / 2)) < 1e-6 and r.gradient_share <= 1e-9


def test_bt_folds_scale_by_both_sides(spark):
    df, project, x, y = rows(spark)
    other = F.transform("features", lambda v: v * 0.5 + 1)
    first = F.col("label") == 1
    pairs = df.select("project_id", F.when(first, F.col("features")).otherwise(other).alias("better"), F.when(first, other).otherwise(F.col("features")).alias("worse"))
    found = {r.project_id: r for r in L.lopo(pairs, "bt", tol=1e-9).collect()}
    half = x * 0.5 + 1
    better, worse = np.where(y[:, None] == 1, x, half), np.where(y[:, None] == 1, half, x)
    for p, r in found.items():
        rest = project != p
        std = np.vstack((better[rest], worse[rest])).std(0)
        z = (better - worse) / np.where(std > 1e-9, std, np.inf)
        w = newton(np.vstack((z[rest], -z[rest])), np.repeat([1, 0], rest.sum()), 1.0, False)
        m = z[~rest] @ w
        assert abs(r.log_loss - np.log1p(np.exp(-m)).mean()) < 1e-6 and r.train_samples == rest.sum()


def test_choice_of_folds_and_errors(spark):
    df, *_ = rows(spark)
    assert [r.project_id for r in L.lopo(df, only=["p2"]).collect()] == ["p2"]
    with pytest.raises(ValueError, match="unknown projects: \\['zz'\\]"):
        L.lopo(df, only=["p2", "zz"])
    with pytest.raises(ValueError, match="two projects"):
        L.lopo(df.where("project_id = 'p2'"))
    assert max(r.steps for r in L.lopo(df, max_iter=3).collect()) == 3


def test_jobs_do_not_grow_with_projects(spark, monkeypatch):
    df, *_ = rows(spark)
    many = df.withColumn("project_id", F.concat(F.lit("q"), F.floor(F.rand(1) * 60)))
    passes = []
    keep = L._passes
    monkeypatch.setattr(L, "_passes", lambda rows, active, *a: (passes.append(len(active)), keep(rows, active, *a))[1])
    found = L.lopo(many, tol=1e-5)
    assert found.count() > 50 and len(passes) < 60 and passes[0] == found.count()


def test_certificate_of_the_fits(spark):
    df, project, x, y = rows(spark)
    at = models.fit_pairwise(df, c=0.5)
    slopes = models.optimality(df, at, "pairwise", 0.5).collect()
    assert sorted(r.pos for r in slopes) == [0, 1, 2, 3, 4] and max(abs(r.gradient) for r in slopes) < 0.05
    zero = models.LinearModel([0.0] * 4, 0.0)
    start = {r.pos: r.gradient for r in models.optimality(df, zero, "pairwise", 0.5).collect()}
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), np.inf)
    want = 0.5 * z.T @ (0.5 - y)
    assert all(abs(start[j + 1] - want[j]) < 1e-8 for j in range(4)) and abs(start[0] - 0.5 * (0.5 - y).sum()) < 1e-8
    pairs = df.select("project_id", F.col("features").alias("better"), F.transform("features", lambda v: v * v).alias("worse"))
    slopes = models.optimality(pairs, models.fit_bt(pairs), "bt").collect()
    assert sorted(r.pos for r in slopes) == [1, 2, 3, 4] and max(abs(r.gradient) for r in slopes) < 0.05


def test_passes_read_packed_rows_on_all_cores(spark, monkeypatch):
    """Vectors are matrices of many rows, also where all rows come in one partition; none is lost and results stay."""
    df, _, x, y = rows(spark)
    want = {r.project_id: r for r in L.lopo(df).collect()}
    kept, keep = [], L._blocks
    monkeypatch.setattr(L, "_ROW", 8 * 4 * 7)
    monkeypatch.setattr(L, "_blocks", lambda *a: (kept.append(keep(*a)), kept[-1])[1])
    found = {r.project_id: r for r in L.lopo(df.coalesce(1)).collect()}
    assert set(found) == set(want) and all(abs(found[p].objective - want[p].objective) < 1e-6 for p in want)
    assert kept[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    blocks = kept[0].collect()
    packed = np.concatenate([np.frombuffer(b.x).reshape(-1, 4) for b in blocks])
    assert 35 <= len(blocks) < 45 and max(len(b.y) for b in blocks) <= 8 * 7
    assert np.allclose(np.sort(packed, 0), np.sort(x - x.mean(0), 0)) and sum(len(b["at"]) for b in blocks) == 4 * len(y)


def test_fits_send_sums_from_few_partitions(spark, monkeypatch):
    """However many partitions the rows come in: no more than cores, or whole blocks of bytes, take part in the steps."""
    df, *_ = rows(spark)
    seen, keep = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, data: (seen.append(data.rdd.getNumPartitions()), keep(self, data))[1])
    many = df.repartition(60)
    one, two = models.fit_pairwise(df, c=0.5), models.fit_pairwise(many, c=0.5)
    models.fit_bt(many.select(F.col("features").alias("better"), F.transform("features", lambda v: v * v).alias("worse")))
    cores = spark.sparkContext.defaultParallelism
    assert max(seen) <= cores and np.allclose(one.weights, two.weights, atol=1e-4)
    assert models._in_few(many, 9 * models._PARTITION).rdd.getNumPartitions() == max(9, cores)
