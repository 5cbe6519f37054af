"""Chains, mainlines and fork points on hand-made and random commit graphs, against sets of ancestors."""

import random

import pytest
from pyspark.sql import functions as F

from amendry.operators import history as H

SCHEMA = "project_id string, commit string, parents array<string>, subject string"


def ancestors(parents, c):
    seen, todo = set(), [c]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents.get(x, [])
    return seen


def plain_fork(parents, a, b):
    common = ancestors(parents, a) & ancestors(parents, b)
    best = {x for x in common if not any(x != y and x in ancestors(parents, y) for y in common)}
    return min(best, default=None)


def graph(seed, n):
    """A mainline with branches of all lengths, merges both ways, octopus merges, old branches, and several roots."""
    rng = random.Random(seed)
    name = {i: f"{rng.randrange(16**6):06x}" for i in range(n)}
    heads, parents = [0], {name[0]: []}
    for i in range(1, n):
        kind = rng.random()
        at = rng.randrange(len(heads))
        if kind < 0.02:
            up = []
            heads.append(i)
        elif kind < 0.15:
            up = [heads[at] if rng.random() < 0.7 else rng.randrange(i)]
            heads.append(i)
        elif kind < 0.4 and len(heads) > 1:
            up = [heads[at], *rng.sample([h for h in heads if h != heads[at]], min(len(heads) - 1, rng.choice((1, 1, 1, 2))))]
            heads[at] = i
        elif kind < 0.43:
            up = [heads[at], rng.randrange(i)]
            heads[at] = i
        else:
            up = [heads[at]]
            heads[at] = i
        parents[name[i]] = list(dict.fromkeys(name[u] for u in up))
    return parents


def table(spark, graphs):
    return spark.createDataFrame([(p, c, up, f"Merge branch 'edit/{c}'" if len(up) == 2 else "work") for p, g in graphs.items() for c, up in g.items()], SCHEMA)


def test_fork_points_of_random_graphs(spark):
    graphs = {f"p{s}": graph(s, 60 + 20 * s) for s in range(6)}
    commits = table(spark, graphs)
    found = {(r.project_id, r.commit): r.fork for r in H.fork_points(commits, commits, window=4).collect()}
    want = {(p, c): f for p, g in graphs.items() for c, up in g.items() if len(up) == 2 and (f := plain_fork(g, *up))}
    assert found == want and len(want) > 60


def test_chains_are_lines_of_first_parents(spark):
    graphs = {"a": graph(7, 150), "b": graph(8, 90)}
    rows = H.chains(table(spark, graphs)).collect()
    at = {(r.project_id, r.chain, r.pos): r.commit for r in rows}
    assert len(at) == len(rows) == sum(map(len, graphs.values()))
    for r in rows:
        below = at.get((r.project_id, r.chain, r.pos - 1))
        up = graphs[r.project_id][r.commit]
        assert below is None or up[0] == below
        assert r.pos == 0 or up


def test_parents_without_rows_are_roots_and_circles_an_error(spark):
    parents = {"m": ["x", "y"], "x": ["gone"], "y": ["gone"]}
    commits = table(spark, {"p": parents})
    assert [r.fork for r in H.fork_points(commits, commits).collect()] == ["gone"]
    with pytest.raises(ValueError, match="own ancestors"):
        H.chains(table(spark, {"p": {"1": ["2"], "2": ["1"]}}))
    assert H.fork_points(commits.limit(0), commits.limit(0)).count() == 0


def test_rounds_of_chains_move_no_names(spark, monkeypatch):
    """Of the tables written only that of the nodes holds strings; of tips equally deep the last in order of names counts."""
    real, kinds = H.written, []
    monkeypatch.setattr(H, "written", lambda df, name: kinds.append((name, "string" in df.schema.simpleString())) or real(df, name))
    commits = table(spark, {"p": {"r": [], "x": ["r"], "z": ["x"], "y": ["x"]}})
    assert {(r.commit, r.chain, r.pos) for r in H.chains(commits).collect()} == {("r", "z", 0), ("x", "z", 1), ("z", "z", 2), ("y", "y", 2)}
    assert sum(strings for _, strings in kinds) == 1 and len(kinds) > 2


def test_mainline(spark):
    g = graph(3, 120)
    last = list(g)[-1]
    line, c = set(), last
    while c:
        line.add(c)
        c = next(iter(g[c]), None)
    commits = table(spark, {"p": g})
    assert {r.commit for r in H.mainline(commits, commits.where(F.col("commit") == last)).collect()} == line


def test_merged_branches_and_their_sections(spark):
    parents = {"1": [], "2": ["1"], "3": ["2"], "4": ["2"], "5": ["4"], "6": ["3", "5"], "7": ["6", "5"], "8": ["7", "3", "5"], "9": ["5"], "a": ["9", "8"]}
    commits = table(spark, {"p": parents})
    rows = [(r.commit, r.fork, r.tip, r.base) for r in H.merged_branches(commits).orderBy("commit").collect()]
    assert rows == [("6", "2", "5", "6"), ("a", "5", "8", "a")]  # 7 merges what is there already, 8 has three parents
    heads = commits.where("commit = '8'")
    assert [r.commit for r in H.merged_branches(commits, heads).collect()] == ["6"]
    old, new = "# A\n\none two\n\nthree\n# B\n\nsame\n", "# A\n\nONE two\n\nthree\n# B\n\nsame\n"
    texts = [("p", path, ref, t) for path in ("f.md", "f.py") for ref, t in (("2", old), ("5", new))] + [("p", "only.md", "5", new), ("p", "equal.md", "2", old), ("p", "equal.md", "5", old)]
    revisions = spark.createDataFrame(texts, "project_id string, path string, ref string, text string")
    (row,) = H.merged_section_pairs(commits, revisions, heads).collect()
    assert (row.path, row.section_key, row.merge_commit, row.merged_branch, row.source_text, row.paragraph_count_edited) == ("f.md", "A", "6", "edit/6", "# A\n\none two\n\nthree", 3)
    assert row.source_reference == "f.md:section:2@2->5@5:A" and H.merged_section_pairs(commits, revisions, heads, path="f.py").count() == 0


def test_work_follows_the_branch(spark, monkeypatch):
    """On a long mainline with old merges all along, a short branch reaches few chains."""
    g, tip = {"c0": []}, "c0"
    for i in range(1, 400):
        if i % 4 == 0:
            g[f"b{i}"] = [tip]
            g[f"c{i}"] = [tip]
            g[f"m{i}"] = [f"c{i}", f"b{i}"]
            tip = f"m{i}"
        else:
            g[f"c{i}"] = [tip]
            tip = f"c{i}"
    g["x"], g["y"], g["last"] = [tip], [tip], ["x", "y"]
    commits = table(spark, {"p": g})
    sizes, keep = [], H.written
    monkeypatch.setattr(H, "written", lambda df, name: (lambda out: (sizes.append(out.count()) if name == "reach" else None, out)[1])(keep(df, name)))
    (row,) = H.fork_points(commits, commits.where("commit = 'last'"), 8).collect()
    assert row.fork == tip and max(sizes) < 12


def test_criss_cross_forks_dont_walk_the_history(spark, monkeypatch):
    """A merge with two forks on top of a long history: both walk until they meet, a few commits below."""
    g, tip = {"c0": []}, "c0"
    for i in range(1, 200):
        g[f"b{i}"], g[f"c{i}"] = [tip], [tip]
        g[f"m{i}"] = [f"c{i}", f"b{i}"]
        tip = f"m{i}"
    g |= {"x": [tip], "y": [tip], "p": ["x", "y"], "q": ["y", "x"], "last": ["p", "q"]}
    commits = table(spark, {"p": g})
    sizes, keep = [], H.written
    monkeypatch.setattr(H, "written", lambda df, name: (lambda out: (sizes.append(out.count()) if name in ("reach", "below") else None, out)[1])(keep(df, name)))
    (row,) = H.fork_points(commits, commits.where("commit = 'last'"), 8).collect()
    assert row.fork == "x" and max(sizes) < 30


def test_a_round_deals_what_is_reached_by_merge_once(spark, monkeypatch):
    """Numbers alone travel from round to round, one table is written in each, and what is above an unmoved place is not
    followed again."""
    g = graph(5, 160)
    commits, tables, real = table(spark, {"p": g}), [], H.written
    monkeypatch.setattr(H, "written", lambda df, name: (lambda out: (tables.append((name, out)), out)[1])(real(df, name)))
    H.fork_points(commits, commits, window=2).count()
    walk = [(name, df) for name, df in tables[[name for name, _ in tables].index("links") :] if name != "several"]
    assert {name for name, _ in walk} == {"links", "reach", "ends"} and len(walk) > 5
    assert not any("string" in df.schema.simpleString() for _, df in walk)
    assert any(df.where("busy AND top < pos").count() for name, df in walk if name == "reach")


def test_merges_without_texts_are_not_walked(spark, monkeypatch):
    """Section pairs come from merges whose tip has a text; forks of others are not looked for, nor their projects placed."""
    parents = {"1": [], "2": ["1"], "3": ["1"], "4": ["2", "3"], "5": ["4"], "6": ["4"], "7": ["5", "6"]}
    commits = table(spark, {"p": parents, "q": parents})
    asked, real = [], H.fork_points
    monkeypatch.setattr(H, "fork_points", lambda c, m, *rest: (asked.append((c.count(), m.count())), real(c, m, *rest))[1])
    texts = [("p", "f.md", "1", "# A\n\nold\n"), ("p", "f.md", "3", "# A\n\nnew\n"), ("q", "f.png", "3", "x")]
    rows = H.merged_section_pairs(commits, spark.createDataFrame(texts, "project_id string, path string, ref string, text string")).collect()
    assert [(r.project_id, r.merge_commit, r.section_key) for r in rows] == [("p", "4", "A")]
    assert asked == [(7, 1)]


def test_chains_of_contracted_histories(spark, monkeypatch):
    """Long lines, random graphs, lone commits and a circle, contracted to a few commits: the places that doubling gives,
    from rounds that shrink."""
    line = {f"{i * 7919 % 1000:04d}": [f"{(i - 1) * 7919 % 1000:04d}"] if i else [] for i in range(400)}
    graphs = {"l": line, **{f"p{s}": graph(s, 150) for s in range(3)}, **{f"s{i}": {"x": []} for i in range(40)}}
    commits = table(spark, graphs)
    want = sorted(map(tuple, H.chains(commits).collect()))
    sizes, real = [], H.written
    monkeypatch.setattr(H, "written", lambda df, name: (lambda out: (sizes.append(out.count()) if name == "contracted" else None, out)[1])(real(df, name)))
    monkeypatch.setattr(H, "_FEW", 20)
    assert sorted(map(tuple, H.chains(commits).collect())) == want and len(want) == 890
    assert len(sizes) > 5 and sizes[0] == 890 and sum(sizes) < 4 * 890
    monkeypatch.setattr(H, "_FEW", 0)
    with pytest.raises(ValueError, match="own ancestors"):
        H.chains(table(spark, {"p": {"1": ["2"], "2": ["3"], "3": ["1"], "4": ["1"]}, "q": {"1": []}}))
