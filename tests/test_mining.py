import random

from pyspark.sql import functions as F

from amendry.operators import mining as M


def test_diff_hunks_and_quirks(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,2 +4 @@ ctx\n-old one  \n-\n--- lost\n+new one\n+\n+two\n unchanged\n@@ -9,0 +12 @@\n+only added\n@@ -20 +22,2 @@\n-a\n+b\n"
    df = spark.createDataFrame([("p", "x", diff), ("p", "y", ""), ("p", "z", None)], "project_id string, path string, diff string")
    found = [(r.hunk_no, r.line_old, r.line_new, r.source_text, r.edited_text) for r in M.parse_unified_diff(df).orderBy("hunk_no").collect()]
    assert found == [(1, 3, 4, "old one", "new one\ntwo"), (3, 20, 22, "a", "b")]


def sections(spark, text):
    df = spark.createDataFrame([("p", "f", "x", text)], "project_id string, path string, ref string, text string")
    return {r.section_key: r.body for r in M.split_sections(df).collect()}


def test_breadcrumbs_preamble_anchor_and_last_wins(spark):
    text = "before\n\n# A\none\n### B\nb\n## C {#sec:x}\nc\n# A\ntwo  \n\n"
    assert sections(spark, text) == {"__preamble__": "before\n", "A > B": "### B\nb\n", "A > C": "## C {#sec:x}\nc\n", "A": "# A\ntwo\n"}
    assert sections(spark, "\n \n") == {} and sections(spark, "") == {}


def plain_sections(text):
    lines, stack, out, key, body = text.splitlines(), [], {}, "__preamble__", []

    def close():
        joined = "\n".join(body).rstrip()
        if joined.strip():
            out[key] = joined + "\n"

    for line in lines:
        level = len(line) - len(line.lstrip("#"))
        if 1 <= level <= 6 and line[level : level + 1] == " ":
            close()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, line[level:].strip()))
            key, body = " > ".join(t for _, t in stack), []
        body.append(line)
    close()
    return out


def test_random_outlines_match_a_stack(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["text", "", "# A", "## B", "### C", "#### D", "## E", "# F"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([("p", f"f{i}", "x", t) for i, t in enumerate(texts)], "project_id string, path string, ref string, text string")
    found = {}
    for r in M.split_sections(df).collect():
        found.setdefault(r.path, {})[r.section_key] = r.body
    assert found == {f"f{i}": want for i, t in enumerate(texts) if (want := plain_sections(t))}


def test_section_pairs_and_stats(spark):
    rows = [("p", "f", "x", "# A\n\nsame\n# B\n\nold\n# C\n\nonly here"), ("p", "f", "edit/x", "# A\n\nsame\n# B\n\nnew\n\nmore\n# D\n\nnew only")]
    df = spark.createDataFrame(rows, "project_id string, path string, ref string, text string")
    found = M.section_pairs(df, "x", "edit/x").collect()
    assert [(r.section_key, r.paragraph_count_source, r.paragraph_count_edited) for r in found] == [("B", 2, 3)]
    lengths = spark.createDataFrame([("x" * (i + 1), "y" * (i + 1), 1, 1, 1, 1) for i in range(10)], "source_text string, edited_text string, paragraph_count_source int, paragraph_count_edited int, line_count_source int, line_count_edited int")
    stats = M.section_stats(lengths).first()
    assert stats.source_p90 == 10 and stats.source_mean == 5 and stats.source_median == 5.5 and stats.n == 10


def test_line_matcher_finds_replaced_blocks(spark):
    rows = [("p", "f", "a", "x\nold\ny\n"), ("p", "f", "b", "x\nnew\ny\nadded\n")]
    found = M.diff_hunks(spark.createDataFrame(rows, "project_id string, path string, ref string, text string"), "a", "b").collect()
    assert [(r.line_old, r.source_text, r.edited_text) for r in found] == [(2, "old", "new")]


def shortest(old, new):
    """Lines removed and added by a shortest script, by the table of longest common subsequences."""
    row = [0] * (len(new) + 1)
    for x in old:
        last = row
        row = [0]
        for j, y in enumerate(new):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return len(old) + len(new) - 2 * row[-1]


def test_edit_scripts_are_shortest_and_rebuild_the_text():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 5, 8, 30, 60] * 25:
        old, new = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, n))] for _ in range(2))
        if rng.random() < 0.4:
            new = [x for x in old if rng.random() < 0.8] + new[:2]
        blocks = M.changed_blocks(old, new)
        out, at = [], 0
        for a, b, c, d in blocks:
            out += old[at:a] + new[c:d]
            at = b
        assert out + old[at:] == new and sum(b - a + d - c for a, b, c, d in blocks) == shortest(old, new)
        assert all(p[1] < q[0] and p[3] < q[2] for p, q in zip(blocks, blocks[1:]))
    long = [f"line {i % 700}" for i in range(20_000)]
    edited = [x + "!" if i % 997 == 5 else x for i, x in enumerate(long)]
    assert len(M.changed_blocks(long, edited)) == 21


def test_hunks_of_files(spark):
    rows = [("p", "f", "a", "x\nold\ny\n"), ("p", "f", "b", "x\nnew\ny\nadded\n"), ("p", "gone", "a", "x"), ("p", "same", "a", "x"), ("p", "same", "b", "x"), ("p", "null", "a", None), ("p", "null", "b", "z")]
    df = spark.createDataFrame(rows, "project_id string, path string, ref string, text string")
    hunks = M.edit_hunks(df, "a", "b")
    assert sorted((r.path, r.hunk_no, r.line_old, r.line_new, r.removed, r.added) for r in hunks.collect()) == [("f", 1, 2, 2, ["old"], ["new"]), ("f", 2, 4, 4, [], ["added"]), ("null", 1, 1, 1, [""], ["z"])]
    rebuilt = M.apply_hunks(df.where("ref = 'a'").drop("ref"), hunks)
    assert {r.path: r.rebuilt for r in rebuilt.collect()} == {"f": "x\nnew\ny\nadded\n", "gone": "x", "same": "x", "null": "z"}


def test_refs(spark):
    branches = spark.createDataFrame([("p", "main"), ("p", "origin/edit/a"), ("p", "edit/b"), ("p", "origin/edit/b")], "project_id string, branch string")
    wanted = spark.createDataFrame([("p", x) for x in ("main", "edit/a", "edit/b", "gone")], "project_id string, ref string")
    assert {r.ref: r.resolved for r in M.resolve_refs(wanted, branches).collect()} == {"main": "main", "edit/a": "origin/edit/a", "edit/b": "edit/b", "gone": None}
    assert sorted(r.branch for r in M.edit_branches(branches).collect()) == ["edit/a", "edit/b"]
    paths = spark.createDataFrame([(x,) for x in ("a.md", "b.RST", "c.py", "md", "a.md", "d.x/e")], "path string")
    assert sorted(r.path for r in M.text_paths(paths).collect()) == ["a.md", "b.RST"]
