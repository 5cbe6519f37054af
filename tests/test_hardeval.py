import random
import re

from pyspark.sql import functions as F

from amendry.operators import hardeval as H

PARAS = ["paragraph number one is long", "paragraph number two is long\nsecond line", "paragraph number three is long", "paragraph number four is long"]
TEXT = "## T\n\n" + "\n\n".join(PARAS) + "\n"


def test_candidate_set_drops_equal_degradations(spark):
    df = spark.createDataFrame([(1, "base", TEXT), (2, "base", "## T\n\nx\n"), (3, TEXT, TEXT)], "id int, base_text string, human_text string")
    found = {r.id: [c.id for c in r.candidates] for r in H.candidate_set(df).collect()}
    assert found == {i: ["human", "deg-join", "deg-split", "base", "deg-reverse"] for i in (1, 3)}


def test_windows(spark):
    rows = [("s", TEXT, TEXT.replace("one", "1"), 4), ("m", TEXT + "TODO", TEXT, 4), ("c", "## T\n\na\n\nb\n\nc", "## T\n\na\n\nb\n\nd", 3)]
    df = spark.createDataFrame(rows, "section_key string, source_text string, edited_text string, paragraph_count_edited int")
    found = [(r.section_key, r.unit, r.window_start, r.window_paragraphs, r.human_text) for r in H.expand_windows(df).orderBy("section_key", "unit", "window_start").collect()]
    assert [x[:4] for x in found] == [("c", "section", 0, 3), ("s", "section", 0, 4), ("s", "window", 0, 3), ("s", "window", 1, 3)]
    assert found[3][4] == "## T\n\n" + "\n\n".join(PARAS[1:]) + "\n"


def plain_pick(pool, n_items, per_project, n):
    picked, per, seen = [], {}, set()
    for x in sorted(pool, key=lambda x: (-abs(x["paragraph_count_edited"] - x["paragraph_count_source"]), x["unit"] != "section", len(x["base_text"]), x["line_no"])):
        if len(picked) >= n_items:
            break
        key = (x["project_id"], x["section_key"], x["window_start"], x["window_paragraphs"])
        near = any(p["project_id"] == x["project_id"] and p["section_key"] == x["section_key"] and p["unit"] == x["unit"] == "window" and abs(p["window_start"] - x["window_start"]) < n for p in picked)
        if per.get(x["project_id"], 0) >= per_project or key in seen or near:
            continue
        seen.add(key)
        picked.append(x)
        per[x["project_id"]] = per.get(x["project_id"], 0) + 1
    return [x["line_no"] for x in picked]


def test_greedy_pick_equals_the_sequential_loop(spark):
    rng = random.Random(9)
    names = ("line_no", "project_id", "section_key", "unit", "window_start", "window_paragraphs", "base_text", "paragraph_count_source", "paragraph_count_edited")
    for cap, n_items in ((3, 12), (50, 200)):
        pool = []
        for i in range(150):
            unit = rng.choice(["section", "window", "window"])
            pool.append(dict(zip(names, (i, f"p{rng.randrange(4)}", f"s{rng.randrange(4)}", unit, 0 if unit == "section" else rng.randrange(8), 3 if unit == "window" else rng.randint(3, 5), "x" * rng.randrange(5), 3, 3 + rng.randrange(3)))))
        df = spark.createDataFrame([tuple(x[k] for k in names) for x in pool], "line_no long, project_id string, section_key string, unit string, window_start int, window_paragraphs int, base_text string, paragraph_count_source int, paragraph_count_edited int")
        assert [r.line_no for r in H.greedy_pick(df, n_items, cap, 3).collect()] == plain_pick(pool, n_items, cap, 3)


def test_validation(spark):
    schema = "id string, candidates array<struct<id:string,text:string>>, human struct<best_id:string,rank:array<string>>, status string, base_text string"
    two = [("a", "x"), ("b", "y")]
    rows = [
        ("ok", two, ("a", ["a", "b"]), "labeled", "t"), ("pending", [], None, "pending", None), ("few_candidates", two[:1], ("a", ["a"]), "labeled", "t"),
        ("duplicate_ids", [two[0], two[0]], ("a", ["a", "a"]), "labeled", "t"), ("no_best", two, (None, ["a", "b"]), "labeled", "t"), ("unknown_best", two, ("z", ["a", "b"]), "labeled", "t"),
        ("bad_rank", two, ("a", ["a"]), "labeled", "t"), ("blank_base", two, ("a", ["b", "a"]), "labeled", " "),
    ]
    found = {r.id: r.error for r in H.validate(spark.createDataFrame(rows, schema)).collect()}
    assert found == {i: None if i in ("ok", "pending") else i for i in found}


def test_rank_pairs_and_three_way(spark):
    df = spark.createDataFrame([("he-example-001", ["norms", "base", "plain"])], "id string, rank array<string>")
    assert sorted((r.better, r.worse) for r in H.rank_pairs(df).collect()) == [("base", "plain"), ("norms", "base"), ("norms", "plain")]
    items = spark.createDataFrame([("1", "b", [("human", "h")]), ("2", "b", [("human", "h")])], "id string, base_text string, candidates array<struct<id:string,text:string>>")
    texts = spark.createDataFrame([("1", "m")], "id string, text string")
    found = {r.id: ([c.text for c in r.candidates], r.missing) for r in H.three_way(items, texts).collect()}
    assert found == {"1": (["h", "m", "b"], False), "2": (["h", None, "b"], True)}


def test_preview_round_trip_and_audit(spark):
    text = "# P\n\n### `lost` (x)\n\nno item\n\n## he-1\n\nnote\n\n### `b` (x)\n\nbody b\nmore\n\n### `a` (x)\n\nbody a\n\n## he-2\n\n### Candidate: `a` (y)\n\nzz\n"
    parsed = H.parse_ranked_preview(spark.createDataFrame([(text,)], "text string"))
    assert sorted((r["item"], r.position, r.cand, r.body) for r in parsed.collect()) == [("he-1", 1, "b", "body b\nmore"), ("he-1", 2, "a", "body a"), ("he-2", 1, "a", "zz")]
    items = spark.createDataFrame([("he-1", [("a", "body a\n"), ("b", "body b\nmore")]), ("he-2", [("a", "other")]), ("he-3", [("a", "x")])], "id string, candidates array<struct<id:string,text:string>>")
    found = {r.id: (r.best_id, r.rank, r.error) for r in H.apply_ranks(items, parsed).collect()}
    assert found == {"he-1": ("b", ["b", "a"], None), "he-2": (None, None, "body_changed"), "he-3": (None, None, "not_in_preview")}


def test_best_section_ties(spark):
    rows = [(1, "p", "f", "k", "s", "longer text", 3, 4), (2, "p", "f", "k", "s", "short", 3, 4), (3, "p", "f", "k", "s", "first", 3, 4), (4, "p", "f", "k", "s", "x", 2, 9)]
    df = spark.createDataFrame(rows, "line_no int, project_id string, path string, section_key string, source_text string, edited_text string, paragraph_count_source int, paragraph_count_edited int")
    assert [r.line_no for r in H.best_section(df).collect()] == [2]
    assert H.best_section(df.where(F.lit(False))).count() == 0


def test_build_rejects_before_it_picks(spark):
    """A rejected item takes no place from a valid one: of one place, the pair with the larger change is too long."""
    long = "## T\n\n" + "\n\n".join(f"{p} {'word ' * 300}" for p in PARAS) + "\n"
    rows = [("p", "long.md", "k1", long, long.replace("one", "1"), 3, 9, 1), ("p", "fine.md", "k2", TEXT, TEXT.replace("one", "1"), 3, 4, 2)]
    df = spark.createDataFrame(rows, "project_id string, path string, section_key string, source_text string, edited_text string, paragraph_count_source int, paragraph_count_edited int, line_no long")
    found = H.build_hard_eval(df, n_items=1, count=lambda base, text: len(base.split()) + len(text.split())).collect()
    assert [(r.path, [c.id for c in r.candidates]) for r in found] == [("fine.md", list(H.GOLD_RANK))]


def test_tokens_are_counted_by_paragraph(spark):
    """Counts of windows equal counts of their texts; the build by counted pieces picks what the build by texts picks."""
    rng = random.Random(3)
    rows = []
    for i in range(12):
        paras = ["first line\n" + " ".join(f"word{rng.randrange(50)}," for _ in range(rng.randint(8, 60))) for _ in range(rng.randint(3, 7))]
        text = f"## T{i}\n\n" + "\n\n".join(paras) + "\n"
        rows.append((f"p{i % 3}", f"f{i}.md", f"k{i % 5}", text, text.replace("word1", "Word1").replace("word2", "new word2"), len(paras), len(paras) + i % 2, i))
    df = spark.createDataFrame(rows, "project_id string, path string, section_key string, source_text string, edited_text string, paragraph_count_source int, paragraph_count_edited int, line_no long")
    pieces = lambda t: F.regexp_count(t, F.lit(r"[A-Za-z0-9#]+|,"))
    windows = H.expand_windows(df, pieces=pieces).select(F.col("base_tokens") == pieces("base_text"), F.col("human_tokens") == pieces("human_text"), "human_paragraphs").collect()
    assert len(windows) > 30 and all(a and b for a, b, _ in windows)
    count = lambda base, text: len(re.findall(r"[A-Za-z0-9#]+|,", base)) + len(re.findall(r"[A-Za-z0-9#]+|,", text))
    keys = lambda found: [(r.path, r.unit, r.window_start, r.line_no, [c.text for c in r.candidates]) for r in found.collect()]
    for most in (700, 2000):
        by_pieces = keys(H.build_hard_eval(df, 8, 3, max_tokens=most, pieces=pieces))
        assert by_pieces == keys(H.build_hard_eval(df, 8, 3, max_tokens=most, count=count)) and len(by_pieces) > 2
