"""The grouped prefix join against all pairs, on odd rows, copies, edited copies, and texts at the threshold."""

import random

from amendry.llm import prefix_join
from amendry.llm.prefix_join import similar_sets

from .cases import SCHEMA, documents, words


def shingles(text, width=4):
    w = [x.encode().lower() for x in words(text)]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(rows, width=4, per_cent=85):
    known = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1], width) for r in known]
    parent = list(range(len(known)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= per_cent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(known):
        least[root(i)] = min(r[0], least.get(root(i), r[0]))
    own = [(r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(known, sets))]
    return sorted([*own, *((None, len(shingles(r[1], width)), None) for r in rows if r[0] is None)], key=repr)


def found(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_sets(df, **options).collect()), key=repr)


def families(seed=1, prefix=""):
    """Families of near copies with many or few edits, some sharing passages, some chained only through others."""
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = prose(40), []
    for size in (30, 60, 100, 200):
        base = prose(size) + (passage if size > 50 else [])
        for edits in range(14):
            w = list(base)
            for _ in range(edits % 7):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        drift = list(base)
        for _ in range(12):
            drift[rng.randrange(len(drift))] = f"d{rng.randrange(10**6)}"
            texts.append(" ".join(drift))
        texts += [" ".join(base[:k]) for k in range(size - 9, size, 2)]
    texts += [" ".join(passage), " ".join(passage + ["x"]), *(" ".join(prose(6) + passage) for _ in range(12))]
    rng.shuffle(texts)
    return [(i * 3 + 1, prefix + t, "en", "s", len(t), 0, 0) for i, t in enumerate(texts)]


def test_odd_documents(spark):
    rows = documents()
    rows += [(rows[3][0], "another text under a known id that has ten words", *rows[0][2:]), (77001, "another text under a known id that has ten words", *rows[0][2:]), rows[4], rows[4]]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_families(spark, monkeypatch):
    """Many buckets, levels of frequency, ids joined by a shuffle, and one round of leaders, so that pairs do the rest."""
    for name, value in (("_BUCKET", 300), ("_KNOWN", 400), ("_SENT", 3), ("_ROUNDS", 1)):
        monkeypatch.setattr(prefix_join, name, value)
    rows = families()
    want = plain(rows)
    assert len({c for _, _, c in want}) > 10
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want


def test_another_threshold(spark):
    rows, options = families(3), {"width": 2, "per_cent": 50}
    assert found(spark.createDataFrame(rows, SCHEMA), **options) == plain(rows, **options)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, "", "", 0, 0, 0), (2, " ", "", "", 0, 0, 0)], SCHEMA)) == [(1, 0, 1), (2, 0, 2)]


def test_copies_meet_the_nearest_leader_though_pairs_are_proposed(spark, monkeypatch):
    """Near copies that share rarer passages with strangers are linked by a pair each, not by pairs of all of them."""
    rng, texts, made, pairs_of = random.Random(4), [], [], prefix_join._group_pairs
    prose = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    base = prose(150)
    texts.append(base)
    for i in range(60):
        passage, copy = prose(6), list(base)
        copy[rng.randrange(150)] = "edit"
        texts += [copy + passage, *(prose(100) + passage for _ in range(2))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)

    def counted(*args):
        made.append(pairs_of(*args))
        return made[-1]

    monkeypatch.setattr(prefix_join, "_ROUNDS", 1)
    monkeypatch.setattr(prefix_join, "_group_pairs", counted)
    none = spark.createDataFrame([], "a binary, b binary")
    *_, linked = prefix_join.linked_sets(docs, 5, 80, none)
    assert [(r.component_id, r["count"]) for r in linked.groupBy("component_id").count().collect()] == [(0, 61)]
    assert made[0].count() < 60
