"""Operators on embeddings against plain versions: ties, nulls, non-finite components, repeated rows, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from amendry.llm.dictionary_codes import codebooks_digest, compress_vectors, decode_vectors, fit_codebooks, nearest_entries
from amendry.llm.shallot import Round, shallot_clusters
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, cluster int, vector int"
DIMS = 8


def rows(n=150, seed=3):
    rng = random.Random(seed)
    out = [(i * 5 % 997, [rng.choice((-1.5, -0.25, 0.0, 0.1, 0.1001, 2.0)) + rng.choice((0.0, rng.random())) for _ in range(DIMS)], rng.choice((1, 2, 2, 2, None))) for i in range(n)]
    out += [out[3], out[3], (9000, out[7][1], 1), (None, out[8][1], 2), (9001, None, 1), (9002, [None] + [0.0] * (DIMS - 1), 1)]
    out += [(9003, [math.nan] * DIMS, 1), (9004, [math.inf] + [0.0] * (DIMS - 1), None), (9005, [], 1), (9006, [0.5] * (DIMS + 1), 1), (9007, [-0.0] * DIMS, None)]
    return [(*r, None, None, 7, 7) for r in out]


def kept(given, scale):
    np_rows = [(i, np.float32(v).tolist(), label) for i, v, label, *_ in given if v is not None and None not in v and len(v) == DIMS and all(map(math.isfinite, v))]
    return [(i, [math.floor(scale * x) for x in v], label, v) for i, v, label in np_rows]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_codes(given, parts, entries, rounds):
    data = kept(given, 256)
    w = DIMS // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted((d for d in data if d[0] is not None), key=lambda d: (d[0], d[3]))[:entries]
    books = [[cut(d[1], p) for d in first] for p in range(parts)]
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (squared(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        at = [[best(d[1], p) for p in range(parts)] for d in data]
        for p in range(parts):
            own = {e: [cut(d[1], p) for d, a in zip(data, at) if a[p] == e] for e in range(len(books[p]))}
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if own[e] else b for e, b in enumerate(books[p])]
    out, total = [], {}
    for i, v, label, _ in data:
        code = [best(v, p) for p in range(parts)]
        error = sum(squared(cut(v, p), books[p][c]) for p, c in enumerate(code))
        total[label] = total.get(label, 0) + error
        out.append((i, "".join("%02x" % c for c in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total[label], digest) for i, c, e, label in out]


@pytest.mark.parametrize("entries", [16, 400])
def test_codes_equal_the_plain_ones(spark, entries):
    given = rows()
    found = compress_vectors(spark.createDataFrame(given, SCHEMA).repartition(5), DIMS, 4, min(entries, 256), 2)
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(plain_codes(given, 4, min(entries, 256), 2), key=repr)


def test_totals_of_many_labels_are_joined_without_a_broadcast(spark, monkeypatch):
    from amendry.llm import dictionary_codes, vectors

    monkeypatch.setattr(dictionary_codes, "attach_totals", lambda *a: vectors.attach_totals(*a, most=1))
    given = rows()
    found = compress_vectors(spark.createDataFrame(given, SCHEMA), DIMS, 4, 16, 2)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()), key=repr) == sorted(plain_codes(given, 4, 16, 2), key=repr)


def test_dictionaries_give_the_distances(spark):
    rng = np.random.default_rng(1)
    x, books = rng.integers(-300, 300, (70, 12)), rng.integers(-300, 300, (3, 9, 4))
    code, error = nearest_entries(x, books)
    for p in range(3):
        d = ((x[:, None, p * 4 : p * 4 + 4] - books[p]) ** 2).sum(2)
        assert (code[:, p] == d.argmin(1)).all() and (error[:, p] == d.min(1)).all()


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    given = [r for r in rows() if r[0] is not None]
    df = spark.createDataFrame(given, SCHEMA)
    usable = spark.createDataFrame([(i, v) for i, _, _, v in kept(given, 256)], "vec_id long, vector array<double>")
    books = fit_codebooks(usable, DIMS, 4, 16, 2, 256)
    found = compress_vectors(df, DIMS, 4, 16, 2)
    assert found.first().codebooks_sha256 == codebooks_digest(books)
    by_code = {r.code: r.decoded for r in decode_vectors(found, books).collect()}
    own = {(i, tuple(v)) for i, v, _, _ in kept(given, 256)}
    for r in found.collect():
        assert any(sum((a - b * 256) ** 2 for a, b in zip(v, by_code[r.code])) == r.error for i, v in own if i == r.vec_id)


def plain_clusters(given, k, rounds):
    data = kept(given, 1024)
    key = lambda d: (hashlib.sha256(f"3:{d[0]}".encode()).hexdigest(), d[3])
    centroids = [d[1] for d in sorted((d for d in data if d[0] is not None), key=key)[:k]]
    best = lambda v: min((squared(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [best(d[1])[1] for d in data]
        own = [[d[1] for d, a in zip(data, at) if a == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centroids)]
    found = [(d[0], *best(d[1])) for d in data]
    each = [sum(x for _, x, j in found if j == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, each[j], sum(each), digest[j]) for i, d, j in found]


@pytest.mark.parametrize("k", [1, 8, 500])
def test_clusters_equal_the_plain_ones(spark, k):
    given = rows()
    found = shallot_clusters(spark.createDataFrame(given, SCHEMA).repartition(4), k, 6, DIMS)
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(given, k, 6), key=repr)


def test_search_is_exact_and_skips_most_distances():
    rng = np.random.default_rng(2)
    k, centres = 40, rng.integers(-4000, 4000, (40, 16))
    x = centres[rng.integers(0, k, 3000)] + rng.integers(-300, 300, (3000, 16))
    centroids, before = x[:k].copy(), None
    state = [np.zeros(3000, np.int32), np.ones(3000, np.int32), np.full(3000, np.inf), np.zeros(3000)]
    taken = 0
    for _ in range(12):
        taken += Round(centroids, before).assign(x, *state)
        d = ((x[:, None].astype(float) - centroids) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        before, centroids = centroids, centroids.copy()
        for j in range(k):
            if (state[0] == j).any():
                centroids[j] = x[state[0] == j].sum(0) // (state[0] == j).sum()
    assert taken < 12 * 3000 * k / 4


def test_no_usable_rows(spark):
    for given in ([], [r for r in rows() if r[0] in (9001, 9002, 9003, 9004, 9005, 9006)]):
        df = spark.createDataFrame(given, SCHEMA)
        assert compress_vectors(df, DIMS, 4).count() == 0 and shallot_clusters(df, dims=DIMS).count() == 0


def test_huge_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * DIMS)], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    with pytest.raises(Exception, match="fit a long"):
        compress_vectors(df, DIMS, 4).collect()
