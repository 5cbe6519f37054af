"""Registered queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_and_decode
from .dictionary_codes import compress_vectors
from .lempel_ziv import remove_repeated_windows
from .prefix_join import similar_sets
from .quality_model import fit_attention_model, score_quality
from .quality_rules import line_frequency_rules
from .shallot import shallot_clusters
from .simhash import near_duplicate_groups
from .soft_mixing import mixing_rates
from .suffix_groups import remove_repeated_bytes
from .suffix_tree_lm import score_texts
from .token_attribution import token_counts
from .wand import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; long texts go to Python in small Arrow batches, so that a task needs little memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level BPE of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which the expected tokens of the languages are equal; the labelled table gives some ids a language."""
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "lang")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_attention_model(docs, table(spark, sf_dir, "labels"), usable=fold(4) != 2)
    return score_quality(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted", "n_passages", "top_weight")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *tokenizer())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 50 are the queries, against all documents."""
    return top_k(table(spark, sf_dir, "documents"), "doc_id % 50 = 0")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), *tokenizer())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold(10) == 0)


def op10_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op11_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op13_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_soft_mixing, op2_quality_model, op3_quality_rules, op4_token_counts, op5_top_k, op6_simhash, op7_byte_bpe,
        op8_substring_dedup, op9_suffix_tree_lm, op10_suffix_groups, op11_dictionary_codes, op12_prefix_join, op13_shallot,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
r AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, host, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM l WHERE line <> '' GROUP BY doc_id),
f AS (SELECT host, line FROM l WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > 50),
lost AS (SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS n_removed_words, count(*) AS n_removed_lines FROM l JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words, coalesce(n_removed_lines, 0) AS n_removed_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.4 * n_words AS kept FROM j"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m USING (win) WHERE m.first < g.doc_id),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.p) AS k FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d) w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id),
n AS (SELECT a.doc_id, count(*) AS n_removed, count(*) FILTER (b.p IS NULL) AS n_spans FROM gone a LEFT JOIN gone b ON a.doc_id = b.doc_id AND b.p = a.p - 1 GROUP BY a.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS p FROM g JOIN m USING (win) WHERE m.first < g.doc_id),
kept AS (SELECT w.doc_id, string_agg(substr(w.h, 2 * w.p - 1, 2), '' ORDER BY w.p) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM d) w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id),
n AS (SELECT a.doc_id, count(*) AS n_removed, count(*) FILTER (b.p IS NULL) AS n_spans FROM gone a LEFT JOIN gone b ON a.doc_id = b.doc_id AND b.p = a.p - 1 GROUP BY a.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _op11(dims: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    w = dims // parts
    steps = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))),
x AS MATERIALIZED (SELECT r, p, v[{w} * p + 1:{w} * p + {w}] AS s FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, s FROM x WHERE r <= {entries})"""]
    nearest = "SELECT r, p, min((list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS m FROM x JOIN {0} b USING (p) GROUP BY r, p"
    for i in range(rounds):
        means = ", ".join(f"sum(s[{j}])::HUGEINT AS t{j}" for j in range(1, w + 1))
        floors = ", ".join(f"((t{j} - ((t{j} % n) + n) % n) // n)::BIGINT" for j in range(1, w + 1))
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(f"b{i}")}),
c{i} AS (SELECT p, e, [{floors}] AS s FROM (SELECT p, m[2] AS e, count(*)::HUGEINT AS n, {means} FROM a{i} JOIN x USING (r, p) GROUP BY p, m[2])),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(c.s, b.s) AS s FROM b{i} b LEFT JOIN c{i} c USING (p, e))""")
    steps.append(f"""z AS ({nearest.format(f"b{rounds}")}),
y AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM y JOIN k USING (r), h""")
    return ",\n".join(steps)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP5 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS ws FROM documents),
m AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
t AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
f AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, m GROUP BY w),
s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / mean))), 6) AS score
  FROM (SELECT doc_id, w FROM t WHERE doc_id % 50 = 0) q JOIN t USING (w) JOIN f USING (w) JOIN d ON d.doc_id = t.doc_id, m GROUP BY q.doc_id, t.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
_OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.low), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)"""


def _op13(dims: int = 64, k: int = 8, rounds: int = 10) -> str:
    steps = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))),
b0 AS MATERIALIZED (SELECT r - 1 AS c, v FROM k WHERE r <= {k})"""]
    nearest = "SELECT r, any_value(k.v) AS v, min((list_sum(list_transform(list_zip(k.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c)) AS m FROM k, {0} b GROUP BY r"
    for i in range(rounds):
        steps.append(f"""a{i} AS ({nearest.format(f"b{i}")}),
u{i} AS (SELECT c, j, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM (SELECT m[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),
w{i} AS (SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM u{i} GROUP BY c),
b{i + 1} AS MATERIALIZED (SELECT b.c, coalesce(w.v, b.v) AS v FROM b{i} b LEFT JOIN w{i} w USING (c))""")
    steps.append(f"""z AS (SELECT r, m[2]::INTEGER AS cluster, m[1]::BIGINT AS distance FROM ({nearest.format(f"b{rounds}")}))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(b.v, ',')) AS centroid_sha256
FROM z JOIN k USING (r) JOIN b{rounds} b ON b.c = z.cluster""")
    return ",\n".join(steps)


#: DuckDB SQL for the same rows, where SQL can express them at a bearable cost; the others are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _OP3, "op5_top_k": _OP5, "op8_substring_dedup": _OP8, "op10_suffix_groups": _OP10, "op11_dictionary_codes": _op11(), "op12_prefix_join": _OP12, "op13_shallot": _op13()}
