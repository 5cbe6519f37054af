import hashlib

import pytest
from pyspark.sql import functions as F

from amendry.functions import text as T


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    row = spark.createDataFrame([tuple(values.values())], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_unicode_space(spark):
    assert one(spark, T.normalize("t"), t="a　b 日本\n\n語") == "ab日本語"
    assert one(spark, T.strip("t"), T.rstrip("t"), t="　 a　\n") == ("a", "　 a")


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f\n\n", "x\n\ny"])
def test_split_lines_as_python(spark, text):
    assert one(spark, T.split_lines("t"), t=text) == text.splitlines()


def test_slug(spark):
    for text, want in (("a b/c", "a-b-c"), ("--", "x"), ("", "x"), ("日本 v1.0", "v1.0")):
        assert one(spark, T.slug("t"), t=text) == want


def test_reference_block(spark):
    assert one(spark, T.strip_reference("t"), T.strip_reference("t", both=False), t=" 本文\n\n[参照]\nx") == ("本文", " 本文")
    assert one(spark, T.input_text(F.col("t"), F.col("r")), t="a", r="x") == "a\n\n[参照]\nx"
    assert one(spark, T.input_text(F.col("t"), F.col("r")), t="a", r=None) == "a"


def test_predicates(spark):
    assert one(spark, T.is_directive_only("t"), t=".. figure:: a.png\n=====") and one(spark, T.is_directive_only("t"), t=" \n")
    assert not one(spark, T.is_directive_only("t"), t=".. note::\ntext")
    for text, want in (("Smith, January 2020", True), ("- item without script", True), ("two words", True), ("短い文", True), ("これは十二文字以上ある本文の一行です", False), ("a\nb", False)):
        assert one(spark, T.is_short_fragment("t"), t=text) == want, text
    assert one(spark, T.has_language("t"), t="this has four words") and not one(spark, T.has_language("t"), t="only three words")
    assert one(spark, T.is_citation_only("a", "b"), a="本文の説明[1]である文章です。", b="本文の説明である文章です。")
    assert not one(spark, T.is_citation_only("a", "b"), a="本文 です。", b="本文です。")
    assert one(spark, T.bad_length_ratio("a", F.col("b")), a="x" * 10, b="y" * 61) and not one(spark, T.bad_length_ratio("a", F.col("b")), a="x" * 10, b="y" * 60)


def test_previews(spark):
    assert one(spark, T.preview("t"), t="a \n　b") == "a b"
    long = "字" * 130
    assert one(spark, T.preview("t"), T.flat_preview("t"), t=long) == ("字" * 119 + "…", "字" * 120)


def test_degradations(spark):
    text = "## T\n\np1 l1\np1 l2\n\np2\n\np3\n"
    got = one(spark, T.degrade_join("t"), T.degrade_split("t"), T.degrade_reverse("t"), t=text)
    assert got == ("## T\n\np1 l1\np1 l2\np2\np3\n", "## T\n\np1 l1\n\np1 l2\n\np2\n\np3\n", "## T\n\np3\n\np2\n\np1 l1\np1 l2\n")
    twice = one(spark, T.degrade_reverse(T.degrade_reverse("t")), t=text)
    assert twice == text
    assert one(spark, T.degrade_join("t"), t="no heading\n\nb") == "no heading\nb\n"


def test_generations_are_cleaned(spark):
    assert one(spark, T.strip_thinking("t"), t="<think>a</think> x <THINK>open") == "x"
    assert one(spark, T.strip_thinking("t"), t="<think>never closed") == ""
    assert one(spark, T.strip_meta_revision("t"), t="以下は推敲です\n---\n本文\n---\n\n## 説明\nx") == "本文"
    assert one(spark, T.strip_meta_revision("t"), t="前置き\n**推敲後の文**：\n\n本文\n\n**変更点**\nx") == "本文"
    assert one(spark, T.strip_meta_revision("t"), t="推敲後の本文：本文\n---") == "本文"


def test_rejected_and_ids(spark):
    assert one(spark, T.rejected_text("weakened", F.col("s"), F.col("e")), s="s", e="文。次，") == "文。 次、"
    assert one(spark, T.rejected_text("weakened", F.col("s"), F.col("e")), s="s", e="plain") == "s"
    digest = hashlib.sha256(b"a\n---\nb").hexdigest()[:12]
    assert one(spark, T.content_id(F.col("p"), source=F.col("s"), edited=F.col("e")), p="p 1", s="a", e="b") == f"p-1-{digest}"


def test_split_is_a_function_of_the_key(spark):
    score, split = one(spark, T.bucket("k"), T.choose_split(T.bucket("k")), k="row-17")
    assert score == pytest.approx(0.7981996597588428, abs=1e-15) and split == "train"
    with pytest.raises(ValueError):
        T.choose_split(F.lit(0.5), 0.9, 0.1)


@pytest.mark.parametrize("margin, want", [(0.12, "preferred_edit"), (0.119, "uncertain"), (-0.12, "preferred_base"), (-0.25, "reject_edit"), (-0.119, "uncertain")])
def test_verdict_edges(spark, margin, want):
    assert one(spark, T.verdict("m"), m=margin) == want


def test_branches(spark):
    assert one(spark, T.branch_of_subject("t"), t="Merge pull request #3 from me/edit/x") == "edit/x"
    assert one(spark, T.branch_of_subject("t"), t="Merge branch 'edit/y' into main") == "edit/y"
    assert one(spark, T.branch_of_subject("t"), t="Merge branch 'main'") is None
    assert one(spark, T.base_of_branch("t"), t="edit/x") == "x" and one(spark, T.base_of_branch("t"), t="main") == "main"


def test_usable(spark):
    assert one(spark, T.usable_pair("a", "b"), a="x", b="…") and not one(spark, T.usable_pair("a", "b"), a="!", b="…")
    assert not one(spark, T.usable_pair("a", "b"), a="x" * 1801, b="y")
    assert not one(spark, T.usable_section("a", "b"), a="x\n", b=" x")


def test_texts_are_split_once(spark):
    """Lines and headings are taken from one pass over a text each, not from one for every part read."""
    plan = lambda *c: spark.range(1).selectExpr("repeat('# a', int(id)) AS t").select(*c)._jdf.queryExecution().optimizedPlan().toString()
    lines = T.split_lines("t")
    assert plan(lines.alias("n")).count("split(") == 1
    assert plan(*(c.alias(x) for c, x in zip(T.heading_and_body("t"), "hb"))).count("split(") <= 5
    texts = ["", "\n", "# a", "# a\r\nb\r\n\r\nc\r", "#\nb", "#x\n", "a\n\n# b\n", "###### h\tx\u0085y\n\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lines.alias("n"), *(c.alias(x) for c, x in zip(T.heading_and_body("t"), "hb"))).collect()
    assert [tuple(r) for r in rows] == [
        ([], "", ""), ([""], "", ""), (["# a"], "# a", ""), (["# a", "b", "", "c"], "# a", "b\n\nc"), (["#", "b"], "", "#\nb"), (["#x"], "", "#x"),
        (["a", "", "# b"], "", "a\n\n# b"), (["###### h\tx", "y", ""], "###### h\tx", "y"), (None, "", None),
    ]
