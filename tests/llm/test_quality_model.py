import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amendry.llm.quality_model import WIDTH, AttentionModel, fit_attention_model, kept_by_quality, labelled_sample, passages, score_quality
from amendry.llm.textarrays import words_of

from .cases import SCHEMA, by_id, documents


def corpus(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        parts = [[word() for _ in range(64)] for _ in range(rng.randint(2, 6))]
        if junk:  # in one passage only
            parts[rng.randrange(len(parts))] = [word() + "$$$" for _ in range(64)]
        rows.append((i, " ".join(w for p in parts for w in p), "x"))
        labels.append((i, 0 if junk else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def plain_passage(own):
    """Features of the words of one passage, counted one by one."""
    x = [0.0] * WIDTH
    marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def kind(b):
        c = chr(b)
        if b in marks:
            return 8 + marks.index(b)
        if b >= 128:
            return 6 if b >= 192 else 7
        return 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5

    letters = [kind(b) for w in own for b in w]
    first = 8 + len(marks)
    for k in letters:
        x[k] += 1
    for k in range(first):
        x[k] = math.sqrt(x[k] / max(1, len(letters)))
    for w in own:
        x[first + int(words_of([w]).hashes()[0] % np.uint64(48))] += 1
    for k in range(first, first + 48):
        x[k] = math.sqrt(x[k] / max(1, len(own)))
    word = lambda b: kind(b) in (0, 1, 2, 3, 6, 7)
    rules = [
        sum(len(w) / 10 for w in own), sum(len(w) > 20 for w in own), sum(sum(kind(b) == 2 for b in w) >= max(2, len(w) / 2) for w in own), sum(not word(w[-1]) for w in own),
        sum(not any(map(word, w)) for w in own), len(own) - len(set(own)),
    ]
    for k, rule in enumerate(rules):
        x[first + 48 + k] = rule / max(1, len(own))
    x[-1] = len(own) / 64
    return x


def plain_score(model, text):
    """The forward pass passage by passage."""
    own = text.encode().split()
    bags = [plain_passage(own[i : i + 64]) for i in range(0, max(1, len(own)), 64)]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    hidden, attention = [], []
    for x in bags:
        h = [math.tanh(sum(a * model.E[i][j] for i, a in enumerate(x)) + model.e[j]) for j in range(len(model.e))]
        gates = [math.tanh(sum(a * model.V[i][j] for i, a in enumerate(h))) * sigmoid(sum(a * model.U[i][j] for i, a in enumerate(h))) for j in range(len(model.w))]
        hidden.append(h)
        attention.append(math.exp(sum(g * w for g, w in zip(gates, model.w))))
    z = [sum(a * h[j] for a, h in zip(attention, hidden)) / sum(attention) for j in range(len(model.e))]
    return sigmoid(sum(v * c for v, c in zip(z, model.c)) + model.b[0])


def test_scores_match_a_plain_forward_pass(spark):
    rng = np.random.default_rng(5)
    model = AttentionModel(rng.normal(0, 0.5, len(AttentionModel().flat)))
    rows = [r for r in documents() if r[0] is not None]
    found = by_id(score_quality(spark.createDataFrame(rows, SCHEMA).repartition(3), model))
    for doc, text, *_ in rows:
        assert found[doc].score == pytest.approx(plain_score(model, text or ""), abs=1e-5), doc


def test_rows_of_one_id_are_one_bag(spark):
    docs = spark.createDataFrame([(1, f"t {i}") for i in range(50)] + [(2, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 1)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in sample) == [(1, "t 0", 0.0), (2, "x y", 1.0)]
    kept = kept_by_quality(docs.union(docs), AttentionModel(), threshold=0.0)
    assert kept.count() == 102 and kept.columns == docs.columns


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, number, y = rng.normal(size=(7, WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    model = AttentionModel(rng.normal(0, 0.3, len(AttentionModel().flat)))

    def loss(flat):
        s = AttentionModel(flat).forward(x, number)["score"]
        return -np.mean(np.log(np.where(y == 1, s, 1 - s))) + 0.05 * (flat**2).sum()

    grad = model.gradient(x, number, y, 0.1)
    for i in rng.integers(0, len(grad), 40).tolist() + list(range(len(grad) - 70, len(grad))):
        step = np.zeros(len(grad))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(model.flat + step) - loss(model.flat - step)) / 2e-5, abs=1e-6)


def test_held_out_accuracy_and_attention(spark):
    df, labels = corpus(spark)
    model = fit_attention_model(df, labels, usable=F.col("doc_id") % 4 != 2, steps=60)
    found = score_quality(df, model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    kept = kept_by_quality(df, model)
    assert kept.columns == df.columns and 150 < kept.count() < 230


def test_odd_rows(spark):
    df, labels = corpus(spark)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "x " * 5000, "c")], df.schema)
    none = score_quality(odd, fit_attention_model(df, labels.limit(0))).collect()
    assert [r.score for r in none] == [0.5] * 4 and {r.n_passages for r in none} == {1, 79}
    assert score_quality(odd.limit(0), AttentionModel()).count() == 0
    assert passages([b""])[0].shape == (1, WIDTH)
