import hashlib

import pytest
from pyspark.sql import functions as F

from amendry.llm import windows
from amendry.llm.lempel_ziv import WORDS, parse_block, remove_repeated_windows, without_repeated_windows
from amendry.llm.suffix_groups import remove_repeated_bytes, repeats, suffix_array

from .cases import SCHEMA, by_id, documents, words


def expected(rows, units, size, join):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            own = units(text)
            for i in range(len(own) - size + 1):
                key = tuple(own[i : i + size])
                first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, text, *_ in rows:
        own = units(text)
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if doc is not None and first[tuple(own[i : i + size])] < doc:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(own), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(own, gone) if not g])).hexdigest())
    return out


def utf8(text):
    return list((text or "").encode())


@pytest.fixture(params=[None, 40])
def small(request, monkeypatch):
    """Also where tasks send what they hold after a few entries and all texts count as long."""
    if request.param:
        for name, value in (("_ENTRIES", request.param), ("_PIECES", request.param), ("_SLICE", 300)):
            monkeypatch.setattr(windows, name, value)
    return request.param


def test_words_match_brute_force(spark, small):
    rows = documents()
    found = by_id(remove_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = expected(rows, words, 13, lambda x: " ".join(x).encode())
    for doc, r in found.items():
        assert (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) == want[doc], doc
    assert len(found) == len(rows) - 1


def test_bytes_match_brute_force(spark, small):
    rows = documents()
    found = by_id(remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = expected(rows, utf8, 50, bytes)
    for doc, r in found.items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[doc], doc
    assert len(found) == len(rows) - 1


def test_rows_without_id_keep_everything_and_repeated_rows_come_back(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, "x " + text), (None, text), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeated_windows(df).collect())
    assert found == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (1, 31, 0), (2, 30, 30)]


def test_different_texts_of_one_id_are_cut_on_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    other = " ".join(f"q{i}" for i in range(120))
    df = spark.createDataFrame([(1, passage), (2, f"{other} {passage}"), (2, "a b"), (2, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeated_windows(df).collect()) == [(1, 40, 0), (2, 2, 0), (2, 120, 0), (2, 160, 40)]
    assert sorted((r.n_bytes, r.n_removed) for r in remove_repeated_bytes(df).collect() if r.doc_id == 2) == [(3, 0), (len(other), 0), (len(other) + 1 + len(passage), len(passage))]


def test_columns_with_names_of_the_operator(spark):
    text = " ".join(f"w{i}" for i in range(20))
    columns = "doc_id int, text string, doc string, row string, spans string, kept_text string, _id string, _sha string, flags string"
    df = spark.createDataFrame([(1, text, *"abcdefg"), (2, text + " x", *"hijklmn"), (3, None, *"opqrstu")], columns)
    found = without_repeated_windows(df)
    assert found.columns == df.columns and {(r.text, r.doc, r.flags) for r in found.collect()} == {(text, "a", "g"), ("x", "h", "n"), (None, "o", "u")}


def test_a_common_passage_leaves_each_task_once_and_the_matcher_decides(spark):
    """Pieces grow with the documents, not with their square, and what overlaps in part is decided by the matcher."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = lambda n: [(i, f"a{i} b{i % 7} {passage} c{i % 5} d{i}") for i in range(n)]
    decided = []
    for n in (200, 400):
        df = spark.createDataFrame(texts(n), "doc_id long, text string").repartition(3)
        plain = df.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("row"), "text")
        spans = windows.removed_spans(plain, WORDS, parse_block, 4).collect()
        decided.append(len(spans))
        found = by_id(remove_repeated_windows(df))
        want = expected(texts(n), words, 13, lambda x: " ".join(x).encode())
        assert all((r.n_removed, r.kept_sha256) == (want[d][1], want[d][3]) for d, r in found.items())
    assert decided[1] < 3 * decided[0]


def test_a_long_text_in_parts(spark):
    text = " ".join(f"w{i % 9999}x{i}" for i in range(600_000))
    assert len(text) > 3 * windows._SLICE
    df = spark.createDataFrame([(1, text[3_000_000:3_000_500]), (2, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in remove_repeated_bytes(df).collect()}
    assert (found[2].n_bytes, found[2].n_removed, found[2].n_spans) == (len(text), 500, 1)
    assert {r.n_removed for r in remove_repeated_windows(df).collect()} == {0, len(text[3_000_000:3_000_500].split()) - 2}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(df).count() == 0
    assert remove_repeated_bytes(df).count() == 0


def test_cut_texts_keep_their_blanks(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage, "a"), (2, f"A\n b  {passage}\n\nc  d", "b"), (3, "x", "c")], "doc_id long, text string, known string")
    found = {r.doc_id: r for r in without_repeated_windows(df).collect()}
    assert found[2].text == "A\n b\n\nc  d" and found[1].text == passage and found[3].text == "x" and found[2].known == "b"


def test_suffix_array_small():
    assert suffix_array([]) == []
    assert suffix_array([2, 1, 3, 1, 3, 1]) == [5, 3, 1, 0, 4, 2]


def test_matchers_on_ties():
    same = [(1, b"abcabc"), (1, b"abcabc"), (2, b"xabcabcx")]
    assert repeats(same, 3) == [(2, 1, 6)]
    spaced = [(d, b" ".join(bytes([c]) for c in t)) for d, t in same]
    assert parse_block([(*x, 0, 0) for x in spaced], 3) == [(2, 1, 6)]
