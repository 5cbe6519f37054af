import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from amendry.llm.token_attribution import _tokenizer, attribute, line_spans, token_counts, token_spans

from .cases import SCHEMA, documents

ARGS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def plain_spans(text):
    encoding, _ = _tokenizer(*ARGS)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        out.append((owner[at], owner[at + size - 1] + 1))
        at += size
    return out


def plain_counts(text, sections, rule):
    count, crossing, outside = [0.0] * len(sections), [0] * len(sections), 0.0
    for a, b in plain_spans(text):
        held = [max(0, min(b, z) - max(a, s)) for s, z in sections]
        among = [i for i, h in enumerate(held) if h]
        if not among:
            outside += 1
            continue
        for i in among:
            crossing[i] += len(among) > 1
        if rule == "share":
            for i in among:
                count[i] += held[i] / sum(held)
        else:
            count[{"first": among[0], "last": among[-1], "most": max(among, key=lambda i: (held[i], -i))}[rule]] += 1
    return count, crossing, outside


@pytest.mark.parametrize("rule", ["first", "last", "most", "share"])
def test_sections_match_brute_force(rule):
    text = "Hello   wörld\n\n\n漢字🎉 tokens tokens\n x"
    for sections in ([(0, 4), (4, 9), (9, 11), (12, 17), (17, len(text))], [(2, 3), (5, 20)], []):
        low, high = np.array([s for s, _ in sections], int), np.array([z for _, z in sections], int)
        count, crossing, outside = attribute(*token_spans(text, *ARGS), low, high, rule)
        want = plain_counts(text, sections, rule)
        assert count.tolist() == pytest.approx(want[0]) and crossing.tolist() == want[1] and outside == want[2]
    assert list(zip(*token_spans(text, *ARGS))) == plain_spans(text)


def test_lines_of_documents_sum_to_their_tokens(spark):
    rows = documents()
    found = token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), *ARGS).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("lines")).collect()
    encoding, _ = _tokenizer(*ARGS)
    want = {r[0]: (len(encoding.encode_ordinary(r[1] or "")), (r[1] or "").count("\n") + 1) for r in rows}
    assert {r.doc_id: (r.n, r.lines) for r in found} == want


def test_given_sections_and_tokens_outside(spark):
    df = spark.createDataFrame([(1, "one two three", [(0, 3)]), (2, "one", None), (3, None, []), (4, "", [(0, 0)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    found = sorted((r.doc_id, r.section_no, r.n_tokens) for r in token_counts(df, *ARGS, sections="parts").collect())
    assert found == [(1, -1, 2.0), (1, 0, 1.0), (2, -1, 1.0), (3, -1, 0.0), (4, 0, 0.0)]
    assert line_spans("")[1].tolist() == [0]
    with pytest.raises(ValueError):
        token_counts(df, *ARGS, rule="best")


def test_odd_sections_have_a_defined_result(spark):
    """Unordered and overlapping spans, one that ends before it begins, and null bounds; numbers are places in the array."""
    df = spark.createDataFrame([(1, "one two three", [(7, 13), (0, 5), (3, 7), (9, 8), (None, 4), None])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    found = {r.section_no: (r.char_start, r.char_end, r.n_tokens) for r in token_counts(df, *ARGS, rule="first", sections="parts").collect()}
    assert found == {1: (0, 5, 2.0), 2: (5, 7, 0.0), 0: (7, 13, 1.0), 3: (13, 13, 0.0)}
