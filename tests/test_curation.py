import pytest
from pyspark.sql import functions as F

from amendry.operators import curation as C

SCHEMA = "id string, input string, chosen string, rejected string, source_reference string, project_id string, created_at int"


def reason(spark, inp, chosen, rejected, reference="", **options):
    row = spark.createDataFrame([("i", inp, chosen, rejected, reference, "p", 0)], SCHEMA)
    return C.prepared(row, "input", "chosen", "rejected").select(C.reject_reason(**options)).first()[0]


A, B = "これは下書きの本文であり十分な長さがある。", "これは推敲後の本文であり十分に長い文章だ。"


def test_rules_in_order(spark):
    assert reason(spark, A, B, A) is None
    assert reason(spark, "短い", B, A) == "bad_length"
    assert reason(spark, A, B, B + " ") == "same_choice"
    assert reason(spark, A, A + "[1]", A, drop_citation_only=True) == "citation_or_bib_only"
    assert reason(spark, A, A + "[1]", A) is None
    assert reason(spark, A, B + "要確認", A, exclude=("推敲",)) == "user_exclude_pattern"
    assert reason(spark, A, B + "要確認", A) == "placeholder_note"
    assert reason(spark, A, ".. figure:: 長い名前の図", A) == "directive_only"
    assert reason(spark, A, "Smith, January 2020", A) == "short_fragment"
    english = "this is a long english line without any target script in it"
    assert reason(spark, english, english + " x", english) == "no_japanese_target"
    assert reason(spark, "12345 67890 12345 67890", B, A) == "short_fragment"
    assert reason(spark, "1 2 3\n4 5 6", B, A) == "non_paragraph"
    assert reason(spark, A, B * 7, A) == "bad_length_ratio"
    assert reason(spark, "短い", "短い", "短い") == "bad_length"  # also the same choice: the first rule counts


def test_dedup_is_idempotent_and_first_wins(spark):
    rows = [(f"i{k}", A, B, A + " " * k, "", "p", k) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = C.curated(df)
    assert [r.id for r in once.collect()] == ["i0"] and C.curated(once).count() == 1
    assert {(r.reason, r.n) for r in C.curate_report(df, project="p").collect()} == {("kept", 1), ("duplicate", 2)}
    assert {r.reason for r in C.with_reason(df, project="q").collect()} == {"project_id_mismatch"}


EX = "id string, project_id string, source_text string, edited_text string, source_reference string, review_result string, created_at int, line_no int"


def examples(spark):
    rows = [("a", "p", "s1", "e1", None, "accepted", 2, 1), ("b", "p", "s1", "e1", "", "accepted", 1, 2), ("c", "p", "s2", "s2", "", "accepted", 1, 3), ("d", "p", "", "e", "", "accepted", 1, 4), ("e", "p", "s3", "e3", "r", "pending", 1, 5), ("a", "p", "s1", "e9", "r", "accepted", 2, 9)]
    return spark.createDataFrame(rows, EX)


def test_dpo_and_pref(spark):
    df = C.upsert_by_id(examples(spark))
    assert {r.id: r.edited_text for r in df.collect()}["a"] == "e9"
    dpo = C.build_dpo(df)
    assert {(r.id, r.input, r.chosen) for r in dpo.collect()} == {("a", "s1\n\n[参照]\nr", "e9"), ("b", "s1", "e1")}
    pref = C.build_pref(dpo)
    assert {(r.id, r.label, r.candidate_a) for r in pref.collect()} == {("a", 1, "e9"), ("a-swap", 0, "s1"), ("b", 1, "e1"), ("b-swap", 0, "s1")}
    assert C.build_pref(dpo, swap=False).count() == 2 and C.unique_pairs(pref).count() == 2
    assert {r.source_text for r in C.build_pref(dpo, strip_reference=True).collect()} == {"s1"}
    split = C.hash_split(pref).groupBy("base_id").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in split)
    assert C.merge_pref(pref, pref).count() == 4 and C.distinct_texts(pref).count() == 4


def test_append_twice_appends_nothing(spark):
    df = examples(spark)
    first = C.append_new(df, df.limit(0))
    assert first.count() == 6 and C.append_new(df, first).count() == 0
    assert C.append_new(df.union(df), df.limit(0)).count() == 6


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    df = examples(spark).limit(0)
    assert C.build_pref(C.curated(C.build_dpo(C.upsert_by_id(df)))).count() == 0
