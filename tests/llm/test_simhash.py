import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from amendry.llm import simhash
from amendry.llm.simhash import components, fingerprints, links, near_duplicate_groups, similar_groups

from .cases import SCHEMA, by_id, documents, words


def plain_fingerprint(text):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    best = {d: d for d in fps}
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(best[a], best[b])
            moved |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


def test_documents_match_brute_force(spark):
    rows = documents()
    found = by_id(near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    fps = {doc: plain_fingerprint(text) for doc, text, *_ in rows if doc is not None}
    want = plain_components(fps)
    assert {d: (r.fingerprint, r.component_id) for d, r in found.items()} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_similar_documents_are_linked_on_their_shingles(spark):
    """Every link is right, and of pairs at 0.8 or more few are missed."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for share in (0.005, 0.01, 0.015, 0.02, 0.05):
            texts.append([rng.choice(vocabulary) if rng.random() < share else w for w in base])
    texts += [[], [], ["one"], ["ONE"], ["one", "two"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "x"), (5, None)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in similar_groups(df.where("text IS NOT NULL")).collect()}
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(360), 2) if a // 6 == b // 6 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(found[a] == found[b] for a, b in near) >= 0.95 * len(near) > 100
    best = {i: i for i in range(len(texts))}
    for a, b in near * 6:
        best[a] = best[b] = min(best[a], best[b])
    assert all(best[i] <= c for i, c in found.items() if i < 360)  # nothing is linked that isn't alike
    assert [found[i] for i in range(360, 365)] == [360, 360, 362, 362, 364]
    assert similar_groups(df.limit(0)).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_no_pair_within_three_bits(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    nodes = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, signed(f)) for i, f in nodes], "node long, fp long")
    found = {tuple(sorted((r.a, r.b))) for r in links(df).collect()}
    assert found == {(a, b) for (a, x), (b, y) in itertools.combinations(nodes, 2) if bin(x ^ y).count("1") <= 3}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([((i * 37) % 199, ((i + 1) * 37) % 199) for i in range(198)], "a long, b long")
    found = {r.node: r.component for r in components(nodes, edges).collect()}
    assert found == {i: 0 for i in range(199)} | {199: 199}


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, None), (2, ""), (9, " \n"), (4, "one"), (4, "one"), (None, "one")], "doc_id long, text string")
    for crowd in (100_000, 1):  # also where copies are dealt to several keys
        found = sorted((r.doc_id or 0, r.fingerprint == "0" * 16, r.component_id or 0) for r in near_duplicate_groups(df, crowd=crowd).collect())
        assert found == [(0, False, 0), (2, True, 2), (3, True, 2), (4, False, 4), (4, False, 4), (9, True, 2)]
    assert near_duplicate_groups(df.limit(0)).count() == 0
    assert fingerprints(df).count() == 6
    with pytest.raises(ValueError):
        links(df, most=4)


def test_ids_with_several_texts_have_a_group_for_each(spark):
    rng = random.Random(8)
    a, b, c = ([f"{x}{rng.randrange(5000)}" for _ in range(90)] for x in "abc")
    near = lambda w: [*w[:-1], "other"]
    rows = [(2, a), (2, b), (3, near(a)), (4, near(b)), (9, c), (9, c), (12, near(near(b))), (1, c[:80])]
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicate_groups(df).collect())
    fps = {t: plain_fingerprint(t) for _, t in rows}
    best = plain_components(fps)  # of texts, each named by the first
    least = {}
    for i, t in rows:
        least[best[t]] = min(i, least.get(best[t], i))
    assert found == sorted((i, f"{fps[t]:016x}", least[best[t]]) for i, t in rows)
    groups = sorted((r.doc_id, r.component_id) for r in similar_groups(df).collect())
    assert groups == [(1, 1), (2, 2), (2, 2), (3, 2), (4, 2), (9, 1), (9, 1), (12, 2)]
    marks = {(r.doc_id, r.mark) for r in similar_groups(df).collect()}
    assert len(marks) == 7  # the repeated row is one


def test_the_pipeline_drops_rows_by_their_own_text(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b = ([f"{x}{rng.randrange(5000)}" for _ in range(90)] for x in "ab")
    rows = [(2, " ".join(a)), (3, " ".join([*a[:-1], "z"])), (3, " ".join(b)), (None, " ".join(a)), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)


def test_one_row_of_a_group_stays_where_rows_share_an_id(spark):
    """Near copies under the least id, the same words in other case, and whole rows that repeat, are copies as well."""
    import corpus_pipeline

    rng = random.Random(10)
    a, b, c = ([f"{x}{rng.randrange(5000)}" for _ in range(90)] for x in "abc")
    rows = [(2, a), (2, [*a[:-1], "z"]), (2, b), (2, [x.upper() for x in b]), (3, [*a[:-1], "y"]), (4, c), (4, c), (4, c), (None, c), (None, c)]
    df = spark.createDataFrame([(i, " ".join(t), "en", f"s{k % 2}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    own = sorted((r.doc_id or 0, r.text[0].lower()) for r in kept.collect())
    assert own == [(0, "c"), (0, "c"), (2, "a"), (2, "b"), (4, "c")]


def test_no_similar_pair_is_missed(spark):
    """Short texts with both ends changed, of which fingerprints alone miss some at a similarity of 0.84."""
    rng, rows = random.Random(12), []
    for i in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(27)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(["y", *w[1:-1], "z"]))]
    found = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i // 2 * 2 for i in range(300)}
    with pytest.raises(ValueError, match="hundredths"):
        similar_groups(spark.createDataFrame(rows[:2], "doc_id long, text string"), similarity=0.805)


def test_proposed_pairs_come_from_tasks_of_bounded_visits(spark):
    """One file of nodes is dealt to many tasks, visits are not counted in tables of a task, and pairs are those of each anchor."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    rows = [(i, x, x ^ (1 << i)) for i, x in enumerate(prints)] + [(100 + i, x ^ 3 << 8, x ^ (1 << i)) for i, x in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long").coalesce(1)
    found = simhash.proposed(nodes, 2, most=500)
    places = nodes.select("node", F.posexplode(F.array("f0", "f1")).alias("print", "fp"))
    at = {}
    for r in simhash.visits(places).select("node", "print", "half", "anchor").collect():
        at.setdefault((r.print, r.half, r.anchor), set()).add(r.node)
    assert {tuple(r) for r in found.collect()} == {(x, min(v)) for v in at.values() for x in v if x != min(v)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("Aggregate [") == 1 and "Join" not in plan and plan.count("RepartitionByExpression") == 2


def test_one_pair_a_node_is_proposed(spark):
    """The one that most anchors propose, not all that a node meets by chance, which grow with the square of the table."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    rows = [(i, x, x ^ (1 << i)) for i, x in enumerate(prints)] + [(100 + i, x, x ^ (1 << i)) for i, x in enumerate(prints)]
    rows += [(200 + i, prints[i], prints[(i + 1) % 40] ^ 5) for i in range(40)]  # nearer to another than to the least it meets
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long").repartition(3)
    met = simhash._met(nodes, 2, 500).groupBy("node", "least").count().collect()
    want = {n: min((-r["count"], r.least) for r in met if r.node == n)[1] for n in {r.node for r in met}}
    assert {r.node: r.least for r in simhash.nearest(nodes, 2, 500).collect()} == want
    assert len(want) == 80 and all(want[100 + i] == i for i in range(40)) and len(met) > 100


def test_near_dedup_makes_shingles_once(spark, monkeypatch):
    """Proposals are checked on the sets of the prefix join; there is no second table of shingles."""
    names, keep = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (names.append(name), keep(df, name))[1])
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in similar_groups(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert names[:3] == ["sketches", "nodes", "near"] and not {"wanted", "shingles", "first", "similar"} & set(names)
