import importlib
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amendry.llm import queries
from amendry.llm.byte_bpe import encode_and_decode
from amendry.llm.quality_model import fit_attention_model, score_quality
from amendry.llm.scratch import written
from amendry.llm.simhash import similar_groups

from .cases import words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_names(stages):
    assert [n for n, *_ in stages] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing to target weights", "byte-level BPE"]
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_quality_keeps_what_the_model_scores_high(spark, stages):
    _, before, after = stages[0]
    model = fit_attention_model(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in score_quality(before, model).where("score >= 0.7").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want and 0 < len(want) <= before.count()


def test_near_dedup_keeps_the_first_of_each_group(stages):
    _, before, after = stages[1]
    want = {r.component_id for r in similar_groups(before).collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert kept == want
    own = {r.doc_id: words("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in before.collect()}
    assert {d for d in own if any(own[d] == own[e] for e in own if e < d)} & kept == set()


def test_stages_on_odd_tables(spark, stages):
    """Empty tables, nulls in every column, rows that repeat, and columns with names that stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).union(docs.limit(3)).union(spark.createDataFrame([(None,) * 5, (7, None, None, None, None), (8, "", "", "", 0)], docs.schema))
    odd = odd.withColumns({c: F.lit(c) for c in ("row", "spans", "copies", "copy", "flags", "digest", "node", "shard")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        after = written(stage(spark, odd, SF), "odd")
        assert name == "byte-level BPE" or (after.columns == odd.columns and after.where("spans <> 'spans'").count() == 0), name


def test_substrings_are_cut_from_the_text(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    first = {}
    for doc in sorted(texts):
        own = words(texts[doc])
        for i in range(len(own) - 12):
            first.setdefault(tuple(own[i : i + 13]), doc)
    for r in after.collect():
        own = words(texts[r.doc_id])
        gone = {i + j for i in range(len(own) - 12) if first[tuple(own[i : i + 13])] < r.doc_id for j in range(13)}
        assert words(r.text) == [w for i, w in enumerate(own) if i not in gone] and r.n_chars == len(r.text)
        assert gone or r.text == texts[r.doc_id]


def test_mixing_repeats_whole_documents(stages):
    _, before, after = stages[3]
    assert after.select("doc_id").distinct().count() >= 0.95 * before.count()
    assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0


def test_encoding_has_a_row_for_each_document(stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.where("NOT utf8 OR size(ids) <> n_tokens").count() == 0
    again = encode_and_decode(before, *queries.tokenizer()).select(F.sum("n_tokens")).first()[0]
    assert again == after.select(F.sum("n_tokens")).first()[0]


def test_registered_queries_match_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql).df()
        got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        order = lambda df: sorted(map(tuple, df.astype(str).values.tolist()))
        assert order(got) == order(want), name


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in root.glob("amendry/**/*.py"):
        if "llm" not in path.parts:
            assert "amendry.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
    assert importlib.import_module("__spark_entry__").queries().keys() >= {"pipeline", *queries.QUERIES}
