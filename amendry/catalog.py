"""Registry: one query for each operator over the driver tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amendry.functions import hooks
from amendry.functions import text as T
from amendry.functions import vectors as V
from amendry.operators import curation, evaluation, hardeval, history, mining, models, scoring, sft
from amendry.plans import duck as D
from amendry.plans.fixtures import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SCRIPT = "[A-Za-zÀ-ÿ]"
RULES = {"script": SCRIPT, "exclude": ("zz9",)}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_sines(n: int):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i) / 10)


# --- curation ------------------------------------------------------------------------------------------------------

UPSERT = f"up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS k FROM {duck('examples')}) WHERE k = 1)"


def _dpo(rejected: str) -> str:
    return f"""dpo AS (SELECT id, project_id, source_reference, created_at, edited_text AS chosen, {rejected} AS rejected,
  CASE WHEN source_reference = '' THEN source_text ELSE source_text || chr(10) || chr(10) || '[参照]' || chr(10) || source_reference END AS input
  FROM (SELECT *, row_number() OVER (PARTITION BY source_text, edited_text ORDER BY created_at, id) AS j FROM up WHERE review_result = 'accepted' AND source_text <> '' AND edited_text <> '')
  WHERE j = 1 AND {rejected} <> edited_text)"""


DPO = f"{UPSERT}, {_dpo('source_text')}"
WEAK = "CASE WHEN replace(replace(edited_text, '。', '。 '), '，', '、') = edited_text THEN source_text ELSE replace(replace(edited_text, '。', '。 '), '，', '、') END"
REASON = f"""{DPO}, ruled AS (SELECT *, {D.reject_reason()} AS broken FROM dpo),
  reasons AS (SELECT *, CASE WHEN broken IS NULL AND row_number() OVER (PARTITION BY {D.normalize('input')}, {D.normalize('chosen')}, {D.normalize('rejected')}, broken IS NULL ORDER BY created_at, id) > 1 THEN 'duplicate' ELSE broken END AS reason FROM ruled)"""
PREF = f"""{REASON}, pref AS (
  SELECT id AS base_id, id, input AS source_text, chosen AS candidate_a, rejected AS candidate_b, 1 AS label, 'chosen_first' AS pair_order, project_id FROM reasons WHERE reason IS NULL
  UNION ALL SELECT id, id || '-swap', input, rejected, chosen, 0, 'rejected_first', project_id FROM reasons WHERE reason IS NULL)"""
BUCKET = "(('0x' || substr(sha256(base_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE)"
SPLIT = f"CASE WHEN {BUCKET} < 0.8 THEN 'train' WHEN {BUCKET} < 0.9 THEN 'valid' ELSE 'test' END"


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.upsert_by_id(view(spark, sf_dir, "examples"))


def dpo(spark: SparkSession, sf_dir: str, rejected: str = "source") -> DataFrame:
    return curation.build_dpo(upserted(spark, sf_dir), rejected)


def pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.build_pref(curation.curated(dpo(spark, sf_dir), **RULES))


@query(f"WITH {UPSERT} SELECT id, line_no, md5(edited_text) AS edited FROM up")
def upsert_by_id(spark, sf_dir):
    return upserted(spark, sf_dir).select("id", "line_no", F.md5("edited_text").alias("edited"))


@query(f"WITH {UPSERT} SELECT id, CAST(created_at AS VARCHAR) AS day FROM up WHERE review_result = 'accepted'")
def accepted_scan(spark, sf_dir):
    return curation.accepted(upserted(spark, sf_dir)).orderBy("created_at", "id").select("id", F.col("created_at").cast("string").alias("day"))


@query(f"""WITH e AS {duck('examples')}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_text, edited_text, source_reference ORDER BY line_no) AS k FROM e WHERE line_no > 1000000 OR conv_id % 2 = 1) WHERE k = 1)
  SELECT id, line_no FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.conv_id % 2 = 0 AND o.line_no < 1000000000000 AND o.project_id = f.project_id AND o.source_text = f.source_text AND o.edited_text = f.edited_text AND o.source_reference = f.source_reference)""")
def append_new(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return curation.append_new(e.where("line_no > 1000000 OR conv_id % 2 = 1"), e.where("conv_id % 2 = 0 AND line_no < 1000000000000")).select("id", "line_no")


@query(f"SELECT id, line_no FROM {duck('examples')} WHERE {D.usable('source_text', 'edited_text', 400)}")
def usable_pairs(spark, sf_dir):
    return view(spark, sf_dir, "examples").where(T.usable_pair("source_text", "edited_text", 400)).select("id", "line_no")


@query(f"WITH {DPO} SELECT id, input, chosen, rejected FROM dpo")
def build_dpo(spark, sf_dir):
    return dpo(spark, sf_dir).select("id", "input", "chosen", "rejected")


@query(f"WITH {UPSERT}, {_dpo(WEAK)} SELECT id, rejected FROM dpo")
def dpo_weakened(spark, sf_dir):
    return dpo(spark, sf_dir, "weakened").select("id", "rejected")


@query(f"WITH {REASON} SELECT id, reason FROM reasons")
def curate_reasons(spark, sf_dir):
    return curation.with_reason(dpo(spark, sf_dir), **RULES).select("id", "reason")


@query(f"WITH {DPO} SELECT id, {D.directive_only('input')} AS directive, {D.short_fragment('chosen')} AS fragment, {D.has_language('input')} AS language, {D.normalize(D.before_reference('input'))} = {D.normalize('chosen')} AS same FROM dpo")
def curate_predicates(spark, sf_dir):
    return dpo(spark, sf_dir).select(
        "id", T.is_directive_only("input").alias("directive"), T.is_short_fragment("chosen", SCRIPT).alias("fragment"), T.has_language("input", SCRIPT).alias("language"),
        (T.normalize(T.strip_reference("input")) == T.normalize("chosen")).alias("same"),
    )


@query(f"WITH {REASON} SELECT id, chosen FROM reasons WHERE reason IS NULL")
def curated(spark, sf_dir):
    return curation.curated(dpo(spark, sf_dir), **RULES).select("id", "chosen")


@query(f"WITH {REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def curate_report(spark, sf_dir):
    return curation.curate_report(dpo(spark, sf_dir), **RULES)


@query(f"WITH {PREF} SELECT id, base_id, md5(candidate_a) AS a, md5(candidate_b) AS b, label, pair_order FROM pref")
def build_pref(spark, sf_dir):
    return pref(spark, sf_dir).select("id", "base_id", F.md5("candidate_a").alias("a"), F.md5("candidate_b").alias("b"), "label", "pair_order")


@query(f"WITH {PREF} SELECT id, round({BUCKET}, 9) AS score, {SPLIT} AS split FROM pref")
def hash_split(spark, sf_dir):
    return curation.hash_split(pref(spark, sf_dir)).select("id", F.round("score", 9).alias("score"), "split")


@query(f"""WITH {PREF} SELECT project_id, {SPLIT} AS part, count(*) AS n FROM pref GROUP BY 1, 2
  UNION ALL SELECT project_id, reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY 1, 2""")
def pref_by_split(spark, sf_dir):
    """Per project: usable pairs of each split, and dropped rows of each reason."""
    return curation.split_counts(curation.with_reason(dpo(spark, sf_dir), **RULES))


@query(f"""WITH {DPO}, ruled AS (SELECT *, CASE WHEN project_id <> 'p1' THEN 'project_id_mismatch' ELSE {D.reject_reason(citations=True)} END AS broken FROM dpo),
  reasons AS (SELECT *, CASE WHEN broken IS NULL AND row_number() OVER (PARTITION BY {D.normalize('input')}, {D.normalize('chosen')}, {D.normalize('rejected')}, broken IS NULL ORDER BY created_at, id) > 1 THEN 'duplicate' ELSE broken END AS reason FROM ruled)
  SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1""")
def curate_project(spark, sf_dir):
    """The report of one project, with the rule on citations on."""
    return curation.curate_report(dpo(spark, sf_dir), project="p1", drop_citation_only=True, **RULES)


@query(f"""WITH e AS {duck('examples')}, c AS (SELECT id, line_no, source_text, CASE WHEN conv_id % 2 = 0 THEN replace(source_text, ' ', ' [1] ') ELSE source_text || ' [@book:key2020]x' END AS cited FROM e)
  SELECT id, line_no, {D.markup_free('cited')} AS bare, {D.citation_only('source_text', 'cited')} AS only_citations FROM c""")
def citation_rules(spark, sf_dir):
    """Texts against copies that differ in citations, or in a citation and a letter."""
    e = view(spark, sf_dir, "examples")
    cited = F.when(F.col("conv_id") % 2 == 0, F.replace("source_text", F.lit(" "), F.lit(" [1] "))).otherwise(F.concat("source_text", F.lit(" [@book:key2020]x")))
    df = e.select("id", "line_no", "source_text", cited.alias("cited"))
    return df.select("id", "line_no", T.strip_markup("cited").alias("bare"), T.is_citation_only("source_text", "cited").alias("only_citations"))


@query(f"""WITH {PREF}, t AS (SELECT label, CASE WHEN label = 1 THEN ['section_pair_mined', 'x'] ELSE ['x'] END AS labels FROM pref) SELECT count(*) AS n_merged, count_if(list_contains(labels, 'section_pair_mined')) AS n_tagged FROM t""")
def merge_counts(spark, sf_dir):
    tags = F.when(F.col("label") == 1, F.array(F.lit("section_pair_mined"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return curation.merge_counts(pref(spark, sf_dir).withColumn("labels", tags))


@query(f"WITH {PREF} SELECT id, label FROM pref WHERE pair_order = 'chosen_first' AND label = 1")
def unique_pairs(spark, sf_dir):
    return curation.unique_pairs(pref(spark, sf_dir)).select("id", "label")


@query(f"""WITH {PREF}, twice AS (SELECT 0 AS part, * FROM pref UNION ALL SELECT 1, base_id, id || '-s', source_text, candidate_b, candidate_a, label, pair_order, project_id FROM pref)
  SELECT id, part AS from_second FROM (SELECT *, row_number() OVER (PARTITION BY source_text, candidate_a, candidate_b, label ORDER BY part, id) AS k FROM twice) WHERE k = 1""")
def merge_pref(spark, sf_dir):
    first = pref(spark, sf_dir).withColumn("from_second", F.lit(0))
    second = first.select("base_id", F.concat("id", F.lit("-s")).alias("id"), "source_text", F.col("candidate_b").alias("candidate_a"), F.col("candidate_a").alias("candidate_b"), "label", "pair_order", "project_id", F.lit(1).alias("from_second"))
    return curation.merge_pref(first.drop("created_at"), second).select("id", "from_second")


DRAFTS = f"""{DPO}, pairs AS (SELECT id, project_id, {D.rstrip('rejected')} AS draft, {D.rstrip('chosen')} AS revised FROM dpo WHERE {D.rstrip('rejected')} <> {D.rstrip('chosen')} AND {D.rstrip('rejected')} <> '' AND {D.rstrip('chosen')} <> '')"""


def revised(spark, sf_dir):
    return curation.revision_pairs(dpo(spark, sf_dir))


@query(f"WITH {DRAFTS} SELECT * FROM pairs")
def revision_pairs(spark, sf_dir):
    return revised(spark, sf_dir)


@query(f"WITH {PREF} SELECT DISTINCT md5(unnest([source_text, candidate_a, candidate_b])) AS digest FROM pref")
def distinct_texts(spark, sf_dir):
    return curation.distinct_texts(pref(spark, sf_dir)).select(F.md5("text").alias("digest"))


@query(f"SELECT id, line_no, concat_ws('-', {D.slug('project_id')}, {D.slug('source_reference')}, substr(sha256(source_text || chr(10) || '---' || chr(10) || edited_text), 1, 12)) AS content_id FROM {duck('examples')}")
def content_ids(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("id", "line_no", T.content_id(F.col("project_id"), F.col("source_reference"), source=F.col("source_text"), edited=F.col("edited_text")).alias("content_id"))


@query(f"WITH {DPO} SELECT id, {D.slug('input')} AS slug, {D.normalize('input')} AS dense, {D.before_reference('input')} AS plain FROM dpo")
def text_functions(spark, sf_dir):
    return dpo(spark, sf_dir).select("id", T.slug("input").alias("slug"), T.normalize("input").alias("dense"), T.strip_reference("input").alias("plain"))


@query(f"SELECT path, ref, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {D.strip('p')} <> '')) AS paragraphs, len(list_filter(string_split(text, chr(10)), lambda p: {D.strip('p')} <> '')) AS lines FROM {duck('revisions')}")
def text_shape(spark, sf_dir):
    return view(spark, sf_dir, "revisions").select("path", "ref", T.paragraph_count("text").alias("paragraphs"), T.line_count("text").alias("lines"))


FLAT = D.strip(f"regexp_replace(text, '{D.SPACE}+', ' ', 'g')")


@query(f"SELECT doc_id, CASE WHEN length({FLAT}) <= 120 THEN {FLAT} ELSE left({FLAT}, 119) || '…' END AS preview, left(replace(text, chr(10), ' '), 120) AS flat FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"), T.flat_preview("text").alias("flat"))


# --- supervised pairs ----------------------------------------------------------------------------------------------


@query(f"""WITH {DRAFTS}, r AS (SELECT project_id, length(revised) / greatest(length(draft), 1)::DOUBLE AS r FROM pairs)
  SELECT project_id, count(*) AS n, round(avg(r), 9) AS mean_ratio, round(quantile_cont(r, 0.1), 9) AS p10, round(quantile_cont(r, 0.5), 9) AS p50, round(quantile_cont(r, 0.9), 9) AS p90 FROM r GROUP BY ROLLUP (project_id)""")
def pair_stats(spark, sf_dir):
    return sft.pair_stats(revised(spark, sf_dir)).select("project_id", "n", *(F.round(c, 9).alias(c) for c in ("mean_ratio", "p10", "p50", "p90")))


@query()
def pair_similarity(spark, sf_dir):
    """As pair_stats, with the likeness of both texts, which SQL can't express."""
    df = sft.pair_stats(revised(spark, sf_dir), sft.char_similarity)
    return df.select("project_id", "n", *(F.round(c, 6).alias(c) for c in df.columns[2:]))


@query(f"WITH {DRAFTS} SELECT 'Revise.' || chr(10) || chr(10) || draft AS user_turn, revised AS assistant_turn FROM pairs WHERE length(draft) % 5 <> 0")
def sft_rows(spark, sf_dir):
    """Rows with messages; those of some texts have none."""
    chat = sft.chat_rows(revised(spark, sf_dir).withColumn("n", F.length("draft")).drop("n"), "Revise.")
    none = F.length(sft.draft_of(F.get("messages", F.lit(0))["content"])) % 5 == 0
    rows = sft.sft_rows(chat.withColumn("messages", F.when(~none, F.col("messages")).otherwise(F.slice("messages", 1, 0))))
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return rows.select(turn(0).alias("user_turn"), turn(1).alias("assistant_turn"))


@query(f"WITH {DRAFTS} SELECT id, 'Revise.' || chr(10) || chr(10) || draft AS user_turn, revised AS assistant_turn, draft AS back FROM pairs")
def chat_rows(spark, sf_dir):
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return sft.chat_rows(revised(spark, sf_dir), "Revise.").select("id", turn(0).alias("user_turn"), turn(1).alias("assistant_turn"), sft.draft_of(turn(0)).alias("back"))


@query(f"WITH {DRAFTS} SELECT id, 'Be brief.' || chr(10) || chr(10) || 'Revise.' || chr(10) || chr(10) || draft AS with_norms, 'Revise.' || chr(10) || chr(10) || draft AS plain FROM pairs")
def prompts(spark, sf_dir):
    return revised(spark, sf_dir).select("id", sft.prompt("draft", "Be brief.", "Revise.").alias("with_norms"), sft.prompt("draft", None, "Revise.").alias("plain"))


@query(f"WITH {DRAFTS} SELECT id, CASE WHEN project_id IN (SELECT project_id FROM pairs GROUP BY 1 HAVING count(*) % 2 = 0) THEN 'holdout' ELSE 'train' END AS split FROM pairs")
def sft_holdout(spark, sf_dir):
    pairs = revised(spark, sf_dir)
    return sft.sft_holdout(pairs, pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")).select("id", "split")


@query(f"WITH {DRAFTS} SELECT DISTINCT source AS project_id FROM documents WHERE source NOT IN (SELECT replace(project_id, 'p', 'src') FROM pairs)")
def unknown_projects(spark, sf_dir):
    known = revised(spark, sf_dir).select(F.replace("project_id", F.lit("p"), F.lit("src")).alias("project_id"))
    return sft.missing_keys(table(spark, sf_dir, "documents").select(F.col("source").alias("project_id")), known, "project_id")


@query(f"SELECT id, line_no, depth FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY line_no) AS depth FROM {duck('examples')}) ORDER BY depth, project_id LIMIT 50")
def round_robin(spark, sf_dir):
    return sft.round_robin(view(spark, sf_dir, "examples"), 50).select("id", "line_no", "depth")


@query(f"SELECT id, line_no FROM {duck('examples')} WHERE length(source_text) BETWEEN 100 AND 300")
def length_window(spark, sf_dir):
    return sft.length_window(view(spark, sf_dir, "examples"), 100, 300, "source_text").select("id", "line_no")


GENS = duck("generations")


@query(f"SELECT mode, id, generated FROM (SELECT *, row_number() OVER (PARTITION BY mode, id ORDER BY line_no DESC) AS k FROM {GENS}) WHERE k = 1")
def load_generations(spark, sf_dir):
    """Generations with a thinking block before and an explanation after them, which cleaning removes."""
    gens = view(spark, sf_dir, "generations")
    dressed = F.concat(F.lit("<think>why\n</think>\n"), "generated", F.lit("\n---\n\n## 説明\nx"))
    return sft.load_generations(gens.withColumn("generated", dressed)).select("mode", "id", "generated")


#: What stands around a generation, by its line number modulo 8.
DRESS = (
    ("<think>a</think>\n", ""), ("", "\n<think>open"), ("以下は指示に従った推敲の結果です。\n\n", ""), ("以下は推敲です。\n---\n", ""),
    ("**推敲後（案）**：\n\n", ""), ("", "\n**変更点**: x"), ("", "\n### 説明：y"), ("推敲後の本文：\n", "\n---"),
)


@query(f"SELECT mode, id, {D.strip(D.LINES)} AS generated FROM {GENS} WHERE {D.strip(D.LINES)} <> ''")
def clean_generation(spark, sf_dir):
    """Generations of one line between what models add, all of which cleaning removes."""
    g = view(spark, sf_dir, "generations").withColumn("bare", T.strip(F.regexp_replace("generated", r"[\n#*-]+", " "))).where("bare <> ''")
    kind = F.pmod(F.xxhash64("id", "mode"), F.lit(len(DRESS)))
    around = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in DRESS)), (kind + 1).cast("int"))
    return g.select("mode", "id", T.clean_generation(F.concat(around(0), "bare", around(1))).alias("generated"))


@query(f"""WITH g AS {GENS}, c AS (SELECT id FROM g WHERE mode IN ('adapter', 'base_norms') GROUP BY id HAVING count(DISTINCT mode) = 2)
  SELECT mode, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(length(generated) / greatest(length(draft), 1)::DOUBLE), 9) AS mean_length_ratio FROM g WHERE mode IN ('adapter', 'base_norms') AND id IN (SELECT id FROM c) GROUP BY mode""")
def mode_summary(spark, sf_dir):
    df = evaluation.mode_summary(view(spark, sf_dir, "generations"), ("adapter", "base_norms"))
    return df.select("mode", "n", F.round("mean_score", 9).alias("mean_score"), F.round("mean_length_ratio", 9).alias("mean_length_ratio"))


@query(f"SELECT id FROM {GENS} GROUP BY id HAVING count(DISTINCT mode) = 3")
def common_ids(spark, sf_dir):
    return evaluation.common_ids(view(spark, sf_dir, "generations"), ("adapter", "base_norms", "gold"))


@query(f"""WITH g AS {GENS}, w AS (SELECT x.id, x.project_id, x.score AS a, y.score AS b FROM g x JOIN g y ON x.id = y.id AND x.mode = 'adapter' AND y.mode = 'base_norms')
  SELECT project_id, count(*) AS n, count_if(a > b) AS wins, count_if(a < b) AS losses, count_if(a = b) AS ties, round(count_if(a > b) / greatest(count_if(a > b) + count_if(a < b), 1)::DOUBLE, 9) AS win_rate FROM w GROUP BY ROLLUP (project_id)""")
def gen_compare(spark, sf_dir):
    return evaluation.generation_summary(view(spark, sf_dir, "generations"), ("adapter", "base_norms")).withColumn("win_rate", F.round("win_rate", 9))


# --- mining --------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT path FROM (SELECT 'f' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.RST' WHEN 2 THEN '.py' WHEN 3 THEN '.txt.gz' WHEN 4 THEN '.org' ELSE '' END AS path FROM documents) WHERE path LIKE '%.md' OR path LIKE '%.RST' OR path LIKE '%.org'")
def text_paths(spark, sf_dir):
    ending = F.when(F.col("k") == 0, ".md").when(F.col("k") == 1, ".RST").when(F.col("k") == 2, ".py").when(F.col("k") == 3, ".txt.gz").when(F.col("k") == 4, ".org").otherwise("")
    df = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 6)
    return mining.text_paths(df.select(F.concat(F.lit("f"), "doc_id", ending).alias("path")))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  h AS (SELECT 'f' || doc_id || '.md' AS path, CAST(i AS INT) AS hunk_no, CAST(i AS INT) AS line_new, {D.rstrip('x')} AS s, {D.rstrip("replace(x, 'e', 'E')")} AS e FROM l WHERE (i - 1) % 4 <> 3)
  SELECT path, hunk_no, line_new, md5(s) AS source, md5(e) AS edited FROM h WHERE {D.usable('s', 'e', 1800)}""")
def parse_diff(spark, sf_dir):
    return mining.parse_unified_diff(view(spark, sf_dir, "diffs")).select("path", "hunk_no", "line_new", F.md5("source_text").alias("source"), F.md5("edited_text").alias("edited"))


@query(f"""WITH x AS {duck('diffs')} SELECT DISTINCT path, path || ':x@' || left(md5(path), 8) || '->edit/x@' || left(sha256(path), 8) AS source_reference,
  CASE WHEN project_id = 'p3' THEN 'given' ELSE project_id || '-repo' END AS project FROM x WHERE diff LIKE '%@@ %'""")
def source_references(spark, sf_dir):
    """References and projects of hunks that name both sides' labels and commits."""
    sides = {"base_label": F.lit("x"), "edit_label": F.lit("edit/x"), "base_commit": F.md5("path"), "edit_commit": F.sha2("path", 256)}
    hunks = mining.parse_unified_diff(view(spark, sf_dir, "diffs").withColumns(sides))
    every = view(spark, sf_dir, "diffs").where("diff LIKE '%@@ %'").withColumns(sides)
    named = every.select("path", T.source_reference(F.col("path"), *map(F.col, mining.SIDES)).alias("source_reference"), T.project_id_of(F.concat(F.lit("-"), "project_id", F.lit("/ repo-")), F.when(F.col("project_id") == "p3", "given")).alias("project")).distinct()
    odd = hunks.select("path", "source_reference").distinct().join(named, ["path", "source_reference"], "left_anti")  # none
    return named.unionByName(odd.withColumn("project", F.lit("differs")))


SECTIONS = f"""l AS (SELECT project_id, path, ref, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {duck('revisions')}),
  n AS (SELECT *, length(regexp_extract(x, '^(#+) ', 1)) AS lv, regexp_extract(x, '^#+ (.*)$', 1) AS title FROM l),
  s AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path, ref ORDER BY i) AS sec,
    {', '.join(f"last_value(CASE WHEN lv = {k} THEN title END IGNORE NULLS) OVER w AS t{k}, last_value(CASE WHEN lv = {k} THEN i END IGNORE NULLS) OVER w AS i{k}" for k in (1, 2, 3))}
    FROM n WINDOW w AS (PARTITION BY path, ref ORDER BY i)),
  k AS (SELECT project_id, path, ref, sec, max(CASE WHEN lv = 1 THEN t1 WHEN lv = 2 THEN concat_ws(' > ', t1, t2)
    WHEN lv = 3 THEN concat_ws(' > ', t1, CASE WHEN i2 > coalesce(i1, 0) THEN t2 END, t3) END) AS section_key,
    {D.rstrip("string_agg(x, chr(10) ORDER BY i)")} || chr(10) AS body FROM s WHERE sec > 0 GROUP BY 1, 2, 3, 4),
  sections AS (SELECT project_id, path, ref, section_key, body FROM (SELECT *, row_number() OVER (PARTITION BY path, ref, section_key ORDER BY sec DESC) AS r FROM k) WHERE r = 1)"""


@query(f"WITH {SECTIONS} SELECT path, ref, section_key, md5(body) AS body FROM sections")
def split_sections(spark, sf_dir):
    return mining.split_sections(view(spark, sf_dir, "revisions")).select("path", "ref", "section_key", F.md5("body").alias("body"))


def _counts(side: str) -> str:
    t = f"{side}_text"
    return f"len(list_filter(string_split({t}, chr(10) || chr(10)), lambda p: {D.strip('p')} <> '')) AS paragraph_count_{side}, len(list_filter(string_split({t}, chr(10)), lambda p: {D.strip('p')} <> '')) AS line_count_{side}"


SECTION_PAIRS = f"""{SECTIONS}, joined AS (SELECT a.project_id, a.path, a.section_key, {D.strip('a.body')} AS source_text, {D.strip('b.body')} AS edited_text FROM sections a JOIN sections b ON a.path = b.path AND a.section_key = b.section_key AND a.ref = 'x' AND b.ref = 'edit/x'),
  pairs AS (SELECT *, {_counts('source')}, {_counts('edited')} FROM joined WHERE {D.usable('source_text', 'edited_text', 12000)} AND source_text <> edited_text)"""


def mined(spark, sf_dir):
    return mining.section_pairs(view(spark, sf_dir, "revisions"), "x", "edit/x")


@query(f"""WITH {SECTION_PAIRS} SELECT concat_ws('-', project_id, {D.slug('path')}, left({D.slug('section_key')}, 48), substr(sha256(concat_ws(chr(10) || '---' || chr(10), section_key, source_text, edited_text)), 1, 12)) AS id,
  paragraph_count_source, paragraph_count_edited, line_count_source, line_count_edited FROM pairs""")
def section_pairs(spark, sf_dir):
    return mined(spark, sf_dir).select("id", "paragraph_count_source", "paragraph_count_edited", "line_count_source", "line_count_edited")


OTHER = "CASE WHEN length(text) % 2 = 0 THEN ' ' || chr(10) || text || chr(10) || ' ' ELSE replace(text, 'e', 'E') END"


@query(f"SELECT path, ref FROM {duck('revisions')} WHERE {D.usable(D.strip('text'), D.strip(OTHER), 20000)} AND {D.strip('text')} <> {D.strip(OTHER)}")
def usable_sections(spark, sf_dir):
    """Against a copy with more blanks around it, or with E for e, which differs only where there is an e."""
    other = F.when(F.length("text") % 2 == 0, F.concat(F.lit(" \n"), "text", F.lit("\n "))).otherwise(F.replace("text", F.lit("e"), F.lit("E")))
    return view(spark, sf_dir, "revisions").where(T.usable_section("text", other, 20000)).select("path", "ref")


def _lengths(side: str) -> str:
    n = f"length({side}_text)"
    return f"floor(avg({n}))::BIGINT AS {side}_mean, median({n})::DOUBLE AS {side}_median, list_sort(list({n}))[floor(count(*) * 0.9)::INT + 1]::INT AS {side}_p90"


@query(f"""WITH {SECTION_PAIRS} SELECT count(*) AS n, round(avg((contains(source_text, chr(10) || chr(10)) OR contains(edited_text, chr(10) || chr(10)))::INT), 9) AS boundary_share,
  round(avg((paragraph_count_source > 1 OR paragraph_count_edited > 1)::INT), 9) AS multi_share, round(avg((paragraph_count_source <> paragraph_count_edited)::INT), 9) AS paragraphs_changed,
  round(avg((line_count_source <> line_count_edited)::INT), 9) AS lines_changed, {_lengths('source')}, {_lengths('edited')} FROM pairs""")
def section_stats(spark, sf_dir):
    shares = ("boundary_share", "multi_share", "paragraphs_changed", "lines_changed")
    return mining.section_stats(mined(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in shares})


def dag(spark, sf_dir):
    name = lambda k: F.concat(F.lit("c"), F.lpad(k.cast("string"), 6, "0"))
    c = view(spark, sf_dir, "commits")
    k = F.col("k")
    older = F.when(k % 5 == 0, F.greatest(k - 3, F.lit(1)))
    parents = F.when(k == 1, F.array().cast("array<string>")).when(k % 5 == 0, F.array(name(k - 1), name(older))).otherwise(F.array(name(k - 1)))
    return c.select("project_id", name(k).alias("commit"), parents.alias("parents"), "subject")


@query(f"""WITH c AS {duck('commits')} SELECT project_id, 'c' || lpad(k::VARCHAR, 6, '0') AS "commit", CASE WHEN k % 10 = 0 THEN 'edit/b' || (k % 7) ELSE 'edit/l' || (k % 3) END AS branch, CASE WHEN k % 10 = 0 THEN 'b' || (k % 7) ELSE 'l' || (k % 3) END AS base FROM c WHERE k % 5 = 0""")
def edit_merges(spark, sf_dir):
    return mining.edit_merges(dag(spark, sf_dir)).select("project_id", "commit", "branch", "base")


FORKS = f"""h AS MATERIALIZED {duck('history')}, edge AS MATERIALIZED (SELECT DISTINCT project_id, "commit" AS child, unnest(parents) AS parent FROM h),
  m AS (SELECT project_id, "commit", subject, parents FROM h WHERE len(parents) = 2),
  up AS (SELECT project_id, "commit", 1 AS side, parents[1] AS a FROM m UNION SELECT project_id, "commit", 2, parents[2] FROM m
    UNION SELECT u.project_id, u."commit", u.side, e.parent FROM up u JOIN edge e ON e.project_id = u.project_id AND e.child = u.a),
  common AS MATERIALIZED (SELECT project_id, "commit", a FROM up GROUP BY ALL HAVING count(DISTINCT side) = 2),
  forks AS (SELECT c.project_id, c."commit", min(c.a) AS fork FROM common c ANTI JOIN
    (SELECT c.project_id, c."commit", e.parent AS a FROM common c JOIN edge e ON e.project_id = c.project_id AND e.child = c.a) b ON b.project_id = c.project_id AND b."commit" = c."commit" AND b.a = c.a GROUP BY ALL)"""
MERGED = f"""{FORKS}, subjects AS (SELECT *, regexp_extract(subject, 'edit/[^ '']+') AS branch FROM m WHERE contains(subject, 'edit/')),
  branches AS (SELECT project_id, "commit", branch, substr(branch, 6) AS base, fork, parents[2] AS tip FROM subjects JOIN forks USING (project_id, "commit") WHERE fork <> parents[2])"""


@query(f"WITH RECURSIVE {FORKS} SELECT * FROM forks")
def fork_points(spark, sf_dir):
    """Over histories with branches, criss-cross and octopus merges, and merges of what the mainline already holds."""
    commits = view(spark, sf_dir, "history").select("project_id", "commit", "parents")
    return history.fork_points(commits, commits.where(F.size("parents") == 2))


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM branches")
def merged_branches(spark, sf_dir):
    return history.merged_branches(view(spark, sf_dir, "history"))


@query(f"""WITH RECURSIVE h AS {duck('history')}, top AS (SELECT project_id, max(k) - 3 AS k FROM h GROUP BY 1),
  line AS (SELECT h.project_id, h."commit", h.parents[1] AS up FROM h JOIN top USING (project_id, k) UNION ALL SELECT h.project_id, h."commit", h.parents[1] FROM line JOIN h ON h.project_id = line.project_id AND h."commit" = line.up)
  SELECT project_id, "commit" FROM line""")
def mainline(spark, sf_dir):
    """What first parents lead to from the fourth commit from the end of each project."""
    commits = view(spark, sf_dir, "history")
    last = commits.groupBy("project_id").agg((F.max("k") - 3).alias("k"))
    return history.mainline(commits, commits.join(last, ["project_id", "k"]))


@query(f"""WITH RECURSIVE {MERGED}, t AS {duck('snapshots')},
  files AS (SELECT b.project_id, b."commit", b.branch, b.fork, b.tip, x.path, x.text AS base_text, y.text AS edit_text FROM branches b JOIN t x ON x.project_id = b.project_id AND x.ref = b.fork JOIN t y ON y.project_id = b.project_id AND y.ref = b.tip AND y.path = x.path
    WHERE x.text <> y.text AND regexp_matches(x.path, '\\.(md|rst|txt|adoc|org)$')),
  sides AS (SELECT project_id, path || '|' || "commit" AS path, unnest(['x', 'edit/x']) AS ref, unnest([base_text, edit_text]) AS text FROM files),
  {SECTION_PAIRS.replace(duck('revisions'), 'sides')}
  SELECT p.project_id, f.path, f."commit" AS merge_commit, f.branch AS merged_branch, p.section_key, f.path || ':section:' || f.fork || '@' || f.fork[1:8] || '->' || f.tip || '@' || f.tip[1:8] || ':' || p.section_key AS source_reference,
    concat_ws('-', p.project_id, {D.slug('f.path')}, left({D.slug('p.section_key')}, 48), substr(sha256(concat_ws(chr(10) || '---' || chr(10), p.section_key, source_text, edited_text)), 1, 12)) AS id, paragraph_count_source, paragraph_count_edited
  FROM pairs p JOIN files f ON f.project_id = p.project_id AND p.path = f.path || '|' || f."commit" """)
def merged_section_pairs(spark, sf_dir):
    """From merges to pairs in one job: where a branch forked, what it changed, and which sections differ."""
    found = history.merged_section_pairs(view(spark, sf_dir, "history"), view(spark, sf_dir, "snapshots"))
    return found.select("project_id", "path", "merge_commit", "merged_branch", "section_key", "source_reference", "id", "paragraph_count_source", "paragraph_count_edited")


@query(f"""WITH {SECTION_PAIRS}, hunks AS (SELECT text AS source_text, '' AS edited_text FROM conversations),
  both_sides AS (SELECT 'pairs' AS side, source_text, edited_text FROM pairs UNION ALL SELECT 'compare', source_text, edited_text FROM hunks),
  flagged AS (SELECT side, contains(coalesce(source_text, ''), chr(10) || chr(10)) OR contains(coalesce(edited_text, ''), chr(10) || chr(10)) AS b FROM both_sides)
  SELECT side, count(*) AS n, count_if(b)::BIGINT AS with_boundary, round(count_if(b) / count(*), 9) AS share FROM flagged GROUP BY side""")
def section_contrast(spark, sf_dir):
    """Sections against single turns of conversations, which stand for hunks."""
    turns = table(spark, sf_dir, "conversations").select(F.col("text").alias("source_text"), F.lit("").alias("edited_text"))
    return mining.boundary_shares(mined(spark, sf_dir), turns).withColumn("share", F.round("share", 9))


BRANCHES = "b AS (SELECT DISTINCT source AS project_id, CASE WHEN doc_id % 3 = 0 THEN 'edit/' WHEN doc_id % 3 = 1 THEN 'origin/edit/' ELSE 'origin/' END || lang AS branch FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def branches(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 3 == 0, "edit/").when(F.col("doc_id") % 3 == 1, "origin/edit/").otherwise("origin/")
    df = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return df.select(F.col("source").alias("project_id"), F.concat(lead, "lang").alias("branch")).distinct()


@query(f"WITH {BRANCHES} SELECT DISTINCT project_id, regexp_replace(branch, '^origin/', '') AS branch FROM b WHERE regexp_replace(branch, '^origin/', '') LIKE 'edit/%'")
def edit_branches(spark, sf_dir):
    return mining.edit_branches(branches(spark, sf_dir))


@query(f"""WITH {BRANCHES}, w AS (SELECT DISTINCT project_id, regexp_replace(branch, '^origin/', '') AS ref FROM b)
  SELECT w.project_id, w.ref, CASE WHEN o.branch IS NOT NULL THEN w.ref WHEN r.branch IS NOT NULL THEN 'origin/' || w.ref END AS resolved, regexp_replace(w.ref, '^edit/', '') AS base
  FROM w LEFT JOIN b o ON o.project_id = w.project_id AND o.branch = w.ref LEFT JOIN b r ON r.project_id = w.project_id AND r.branch = 'origin/' || w.ref""")
def resolve_refs(spark, sf_dir):
    b = branches(spark, sf_dir)
    wanted = b.select("project_id", F.regexp_replace("branch", r"\Aorigin/", "").alias("ref")).distinct()
    return mining.resolve_refs(wanted, b).withColumn("base", T.base_of_branch("ref"))


@query(f"WITH {BRANCHES} SELECT project_id, regexp_replace(branch, '^.*/', '') AS base, branch AS edit FROM b")
def manifest_pairs(spark, sf_dir):
    pair = F.struct(F.regexp_replace("branch", r"\A.*/", "").alias("base"), F.col("branch").alias("edit"))
    manifest = branches(spark, sf_dir).groupBy("project_id").agg(F.collect_list(pair).alias("branch_pairs"))
    return mining.manifest_pairs(manifest)


# --- vectors and scores --------------------------------------------------------------------------------------------

PV = f"v AS {duck('pref_vectors')}"
N_PAIR, N_POINT = 9 * 64 + 9, 4 * 64 + 5


def _digest(v: str) -> str:
    """Sum, weighted sum and size of a vector, rounded: enough to tell vectors apart."""
    return f"len({v}) AS size, round(list_sum({v}), 5) AS total, round(list_dot_product({v}, {D.weights(0).replace('range(0)', f'range(len({v}))')}), 5) AS weighed"


def digest(v):
    sines = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.sin(i) / 10)
    return F.size(v).alias("size"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(V.dot(v, sines), 5).alias("weighed")


@query("WITH t AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM t) SELECT vec_id, " + _digest("u") + " FROM u")
def vec_truncate(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", V.truncate_normalize("embedding", 16).alias("u"))
    return df.select("vec_id", *digest(F.col("u")))


@query(f"WITH {PV}, f AS (SELECT id, {D.pointwise('src', 'a', 'len_src', 'len_a')} AS f FROM v) SELECT id, {_digest('f')} FROM f")
def pointwise_features(spark, sf_dir):
    df = view(spark, sf_dir, "pref_vectors").select("id", V.pointwise_features("src", "a", "len_src", "len_a").alias("f"))
    return df.select("id", *digest(F.col("f")))


@query(f"WITH {PV}, f AS (SELECT id, {D.preference('src', 'a', 'b', 'len_src', 'len_a', 'len_b')} AS f FROM v) SELECT id, {_digest('f')} FROM f")
def pref_features(spark, sf_dir):
    df = view(spark, sf_dir, "pref_vectors").select("id", V.preference_features("src", "a", "b", "len_src", "len_a", "len_b").alias("f"))
    return df.select("id", *digest(F.col("f")))


def _p(*order: str) -> str:
    return f"(1 / (1 + exp(-list_dot_product({D.weights(N_PAIR)}, {D.preference('src', *order)}))))"


SCORED = f"""{PV}, p AS (SELECT *, {_p('a', 'b', 'len_src', 'len_a', 'len_b')} AS p_ab, {_p('b', 'a', 'len_src', 'len_b', 'len_a')} AS p_ba FROM v),
  s AS (SELECT *, (p_ab + 1 - p_ba) / 2 AS score_a, (1 - p_ab + p_ba) / 2 AS score_b FROM p)"""


def scored(spark, sf_dir):
    return scoring.score_pairwise(view(spark, sf_dir, "pref_vectors"), literal_sines(N_PAIR))


@query(f"WITH {SCORED} SELECT id, round(p_ab, 6) AS p_ab, round(p_ba, 6) AS p_ba, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b FROM s")
def symmetric_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *(F.round(c, 6).alias(c) for c in ("p_ab", "p_ba", "score_a", "score_b")))


@query(f"WITH {SCORED} SELECT id, CASE WHEN score_b > score_a THEN 'B' ELSE 'A' END AS winner FROM s")
def compare(spark, sf_dir):
    return scored(spark, sf_dir).select("id", scoring.winner().alias("winner"))


def _bt(cand: str, length: str) -> str:
    return f"list_dot_product({D.weights(N_POINT)}, {D.pointwise('src', cand, 'len_src', length)})"


BT = f"{PV}, t AS (SELECT *, {_bt('a', 'len_a')} AS ta, {_bt('b', 'len_b')} AS tb, {_bt('src', 'len_src')} AS ts FROM v)"


def bt(spark, sf_dir):
    w = literal_sines(N_POINT)
    df = view(spark, sf_dir, "pref_vectors")
    return df.withColumns({"ta": scoring.score_bt(w, "src", "a", "len_src", "len_a"), "tb": scoring.score_bt(w, "src", "b", "len_src", "len_b"), "ts": scoring.score_bt(w, "src", "src", "len_src", "len_src")})


@query(f"WITH {BT} SELECT id, round(ta, 6) AS ta, round(tb, 6) AS tb, round(ts, 6) AS ts FROM t")
def bt_scores(spark, sf_dir):
    return bt(spark, sf_dir).select("id", *(F.round(c, 6).alias(c) for c in ("ta", "tb", "ts")))


@query(f"WITH {BT}, m AS (SELECT CASE label WHEN 1 THEN ta - tb ELSE tb - ta END AS m FROM t) SELECT count(*) AS n, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 6) AS pair_accuracy, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS pair_loss, round(avg(m), 6) AS mean_margin FROM m")
def pair_metrics(spark, sf_dir):
    df = bt(spark, sf_dir).withColumn("margin", F.when(F.col("label") == 1, F.col("ta") - F.col("tb")).otherwise(F.col("tb") - F.col("ta")))
    return scoring.pair_metrics(df).select("n", *(F.round(c, 6).alias(c) for c in ("pair_accuracy", "pair_loss", "mean_margin")))


VERDICTS = f"""{SCORED}, m AS (SELECT id, project_id, score_a, score_b, score_a - score_b AS margin FROM s),
  j AS (SELECT *, CASE WHEN margin >= 0.12 THEN 'preferred_edit' WHEN margin <= -0.25 THEN 'reject_edit' WHEN margin <= -0.12 THEN 'preferred_base' ELSE 'uncertain' END AS verdict, row_number() OVER (PARTITION BY project_id ORDER BY id) AS number FROM m)"""


def judged(spark, sf_dir):
    return scoring.with_verdicts(scored(spark, sf_dir), "project_id", "id", "score_a", "score_b").withColumnRenamed("score_a", "score_edit").withColumnRenamed("score_b", "score_base")


@query(f"WITH {VERDICTS} SELECT id, number AS index, verdict FROM j")
def verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "index", "verdict")


@query(f"WITH {VERDICTS} SELECT id FROM j WHERE verdict <> 'preferred_edit'")
def flagged_hunks(spark, sf_dir):
    return scoring.only_flagged(judged(spark, sf_dir)).select("id")


@query(f"""WITH {VERDICTS} SELECT project_id, count(*) AS n, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS min_margin, round(max(margin), 6) AS max_margin, round(avg(score_a), 6) AS mean_edit, round(avg(score_b), 6) AS mean_base,
  round(min(score_a), 6) AS min_edit, round(max(score_a), 6) AS max_edit, round(avg((margin > 0)::INT), 6) AS win_rate FROM j GROUP BY ROLLUP (project_id)""")
def hunk_stats(spark, sf_dir):
    df = scoring.hunk_stats(judged(spark, sf_dir), "project_id")
    return df.select("project_id", "n", *(F.round(c, 6).alias(c) for c in df.columns[2:]))


@query(f"WITH {VERDICTS} SELECT count(*) AS total, " + ", ".join(f"count_if(verdict = '{v}') AS {v}" for v in scoring.VERDICTS) + " FROM j")
def verdict_summary(spark, sf_dir):
    return scoring.verdict_summary(judged(spark, sf_dir))


CANDS = f"c AS (SELECT *, {D.dot(D.weights(N_POINT), D.pointwise('src', 'cand_vec', 'len_src', 'len_cand / 1000'))} AS score, {D.dot(D.weights(N_POINT), D.pointwise('src', 'src', 'len_src', 'len_src'))} AS source_score FROM {duck('candidates')})"


def cands(spark, sf_dir):
    df = view(spark, sf_dir, "candidates").withColumn("_len", F.col("len_cand") / 1000)
    w = literal_sines(N_POINT)
    return df.withColumns({"score": scoring.score_bt(w, "src", "cand_vec", "len_src", "_len"), "source_score": scoring.score_bt(w, "src", "src", "len_src", "len_src")})


@query(f"""WITH {CANDS}, a AS (SELECT item, cand_index, score, source_score FROM c UNION ALL SELECT item, 0, min(source_score), min(source_score) FROM c GROUP BY item),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, cand_index) AS rank, score - source_score AS margin FROM a)
  SELECT item, cand_index, rank, round(margin, 6) AS margin, max(margin) OVER (PARTITION BY item) >= 0.1 AS accepted FROM r""")
def best_of_n(spark, sf_dir):
    """The source is candidate 0."""
    own = cands(spark, sf_dir).select("item", "cand_index", "score", "source_score")
    return scoring.best_of_n(scoring.with_source(own), min_margin=0.1).select("item", "cand_index", "rank", F.round("margin", 6).alias("margin"), "accepted")


@query(f"WITH {BT} SELECT id, round(ta - ts, 6) AS improvement, ta - ts < 0.5 AS converged FROM t")
def converged(spark, sf_dir):
    df = bt(spark, sf_dir).withColumnRenamed("ta", "score_revised").withColumnRenamed("ts", "score_current")
    return scoring.converged_bt(df).select("id", F.round("improvement", 6).alias("improvement"), "converged")


@query(f"WITH {SCORED} SELECT id, abs(score_a - score_b) <= 0.08 AS converged FROM s")
def converged_pairs(spark, sf_dir):
    return scoring.converged_pair(scored(spark, sf_dir)).select("id", "converged")


@query(f"""WITH {SCORED}, g AS (SELECT label, p_ab AS p, (p_ab >= 0.5)::INT AS y FROM s), c AS (SELECT count(*) AS n, avg((label = y)::INT) AS accuracy, avg(-ln(CASE label WHEN 1 THEN least(greatest(p, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(p, 1e-15), 1 - 1e-15) END)) AS log_loss,
  count_if(label = 1 AND y = 1) AS tp, count_if(label = 0 AND y = 1) AS fp, count_if(label = 1 AND y = 0) AS fn, count_if(label = 0 AND y = 0) AS tn FROM g)
  SELECT n, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss, tp + fn AS support_1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision_1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall_1, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_1,
  round(2 * tn / (2 * tn + fp + fn)::DOUBLE, 6) AS f1_0, round((2 * tp / (2 * tp + fp + fn)::DOUBLE + 2 * tn / (2 * tn + fp + fn)::DOUBLE) / 2, 6) AS macro_f1, round((2 * tp / (2 * tp + fp + fn)::DOUBLE * (tp + fn) + 2 * tn / (2 * tn + fp + fn)::DOUBLE * (tn + fp)) / n, 6) AS weighted_f1 FROM c""")
def clf_report(spark, sf_dir):
    df = evaluation.classification_report(scored(spark, sf_dir).withColumn("p", F.col("p_ab")))
    return df.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"), "support_1", *(F.round(c, 6).alias(c) for c in ("precision_1", "recall_1", "f1_1", "f1_0", "macro_f1", "weighted_f1")))


@query(f"WITH e AS {duck('examples')} SELECT id, line_no, CAST(length(source_text) AS DOUBLE) AS n_source, CAST(length(edited_text) AS DOUBLE) AS n_edited FROM e")
def pref_vectors(spark, sf_dir):
    """Vectors are encoded once for each distinct text and joined twice; here a vector is the text's length."""
    e = view(spark, sf_dir, "examples")
    texts = e.select(F.explode(F.array("source_text", "edited_text")).alias("text")).distinct()
    vectors = texts.select("text", F.array(F.length("text").cast("float")).alias("vec"))
    df = hooks.attach_vectors(e, vectors, {"source_text": "vs", "edited_text": "ve"})
    return df.select("id", "line_no", F.get("vs", F.lit(0)).cast("double").alias("n_source"), F.get("ve", F.lit(0)).cast("double").alias("n_edited"))


@query("""WITH f AS (SELECT label, vec_id % 5 <> 0 AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, sum(CASE WHEN m THEN x ELSE 0 END) / greatest(count_if(m), 1e-6) AS x FROM f GROUP BY 1, 2)
  SELECT label, round(sum(x), 5) AS total, round(sum(x * i), 4) AS weighed FROM a GROUP BY 1""")
def mean_pool(spark, sf_dir):
    df = hooks.mean_pool(table(spark, sf_dir, "embeddings").withColumn("mask", F.col("vec_id") % 5 != 0), "label", "embedding", "mask")
    places = F.transform("vec", lambda x, i: x * (i + 1))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return df.select("label", F.round(total("vec"), 5).alias("total"), F.round(total(places), 4).alias("weighed"))


# --- evaluation ----------------------------------------------------------------------------------------------------

@query(f"""WITH {CANDS}, best AS (SELECT item, arg_min(cand, gold_rank) AS best_human, arg_max(cand, score) AS best_model FROM c GROUP BY item),
  pairs AS (SELECT a.item, count_if(a.score > b.score) AS pairwise_agree, count(*) AS pairwise_total FROM c a JOIN c b ON a.item = b.item AND a.gold_rank < b.gold_rank GROUP BY a.item)
  SELECT item, best_human = best_model AS top1_hit, pairwise_agree, pairwise_total FROM best JOIN pairs USING (item)""")
def hard_eval_score(spark, sf_dir):
    return evaluation.score_hard_eval(cands(spark, sf_dir).withColumn("length", F.col("len_cand"))).select("item", "top1_hit", "pairwise_agree", "pairwise_total")


@query(f"""WITH {CANDS}, best AS (SELECT item, arg_min(cand, gold_rank) AS best_human, arg_max(cand, score) AS best_model FROM c GROUP BY item),
  pairs AS (SELECT a.item, count_if(a.score > b.score) AS agree, count(*) AS total FROM c a JOIN c b ON a.item = b.item AND a.gold_rank < b.gold_rank GROUP BY a.item)
  SELECT count(*) AS n_labeled, count_if(best_human = best_model) AS top1_hits, round(count_if(best_human = best_model) / count(*)::DOUBLE, 9) AS top1_accuracy, sum(agree)::BIGINT AS pairwise_agree, sum(total)::BIGINT AS pairwise_total, round(sum(agree) / sum(total)::DOUBLE, 9) AS pairwise_accuracy FROM best JOIN pairs USING (item)""")
def hard_eval_totals(spark, sf_dir):
    df = evaluation.hard_eval_totals(evaluation.score_hard_eval(cands(spark, sf_dir).withColumn("length", F.col("len_cand"))))
    return df.withColumns({c: F.round(c, 9) for c in ("top1_accuracy", "pairwise_accuracy")}).drop("mean_spearman")


@query(f"""WITH c AS (SELECT item, round(cosine, 1) AS x, floor(len_cand / 500) AS y FROM {duck('candidates')}), r AS (SELECT item,
  rank() OVER (PARTITION BY item ORDER BY x) + (count(*) OVER (PARTITION BY item, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY item ORDER BY y) + (count(*) OVER (PARTITION BY item, y) - 1) / 2.0::DOUBLE AS b FROM c)
  SELECT item, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY item""")
def spearman(spark, sf_dir):
    df = view(spark, sf_dir, "candidates").select("item", F.round("cosine", 1).alias("x"), F.floor(F.col("len_cand") / 500).alias("y"))
    return evaluation.spearman(df, "item", "x", "y").withColumn("spearman", F.round("spearman", 6))


@query(f"""WITH c AS {duck('candidates')} SELECT a.cand AS cand_a, b.cand AS cand_b, count(*) AS n, round(avg((a.cosine > b.cosine)::INT), 6) AS win_rate, round(avg(a.cosine - b.cosine), 6) AS mean_margin, round(median(a.cosine - b.cosine), 6) AS median_margin
  FROM c a JOIN c b ON a.item = b.item AND a.cand < b.cand GROUP BY 1, 2""")
def margin_stats(spark, sf_dir):
    df = evaluation.margin_stats(view(spark, sf_dir, "candidates").withColumn("score", F.col("cosine")))
    return df.select("cand_a", "cand_b", "n", *(F.round(c, 6).alias(c) for c in ("win_rate", "mean_margin", "median_margin")))


@query(f"""WITH c AS {duck('candidates')}, w AS (SELECT item, max(CASE cand WHEN 'c1' THEN cosine END) AS h, max(CASE cand WHEN 'c2' THEN cosine END) AS m, max(CASE cand WHEN 'c3' THEN cosine END) AS k FROM c GROUP BY item)
  SELECT item, round(CASE WHEN h - k > 0.001 THEN (m - k) / (h - k) END, 4) AS position, CASE WHEN h >= m AND h >= k THEN 'human' WHEN m >= k THEN 'model' ELSE 'copy' END AS leader FROM w WHERE h IS NOT NULL AND m IS NOT NULL AND k IS NOT NULL""")
def relative_position(spark, sf_dir):
    return evaluation.relative_position(named_scores(spark, sf_dir)).select("item", F.round("position", 4).alias("position"), F.get("order", F.lit(0)).alias("leader"))


@query(f"""WITH c AS {duck('candidates')}, w AS (SELECT item, max(CASE cand WHEN 'c1' THEN cosine END) AS h, max(CASE cand WHEN 'c2' THEN cosine END) AS m, max(CASE cand WHEN 'c3' THEN cosine END) AS k FROM c GROUP BY item),
  p AS (SELECT CASE WHEN h - k > 0.001 THEN (m - k) / (h - k) END AS p FROM w WHERE h IS NOT NULL AND m IS NOT NULL AND k IS NOT NULL) SELECT count(*) AS n, round(avg(p), 4) AS mean_position, round(median(p), 4) AS median_position, round(count_if(p > 0 AND p < 1) / count(p)::DOUBLE, 6) AS between_0_1 FROM p""")
def position_summary(spark, sf_dir):
    df = evaluation.position_summary(evaluation.relative_position(named_scores(spark, sf_dir)))
    return df.select("n", F.round("mean_position", 4).alias("mean_position"), F.round("median_position", 4).alias("median_position"), F.round("between_0_1", 6).alias("between_0_1"))


def named_scores(spark, sf_dir):
    name = F.when(F.col("cand") == "c1", "human").when(F.col("cand") == "c2", "model").when(F.col("cand") == "c3", "copy")
    return view(spark, sf_dir, "candidates").select("item", name.alias("cand"), F.col("cosine").alias("score"))


FOLDS = duck("folds")


@query(f"SELECT model, count(*) AS folds, round(sum(accuracy * n) / sum(n), 6) AS micro_accuracy, round(avg(accuracy), 6) AS macro_accuracy, round(sum(log_loss * n) / sum(n), 6) AS micro_log_loss, round(avg(log_loss), 6) AS macro_log_loss FROM {FOLDS} GROUP BY model")
def fold_summary(spark, sf_dir):
    df = evaluation.fold_summary(view(spark, sf_dir, "folds"), "model")
    return df.select("model", "folds", *(F.round(c, 6).alias(c) for c in df.columns[2:]))


@query(f"SELECT model, project_id, weakness FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy, project_id) AS weakness FROM {FOLDS}) WHERE weakness <= 3")
def weak_folds(spark, sf_dir):
    return evaluation.weak_folds(view(spark, sf_dir, "folds")).select("model", "project_id", "weakness")


@query(f"""WITH f AS {FOLDS}, r AS (SELECT model, sum(accuracy * n) / sum(n) AS micro, avg(accuracy) AS macro FROM f GROUP BY model),
  w AS (SELECT model, string_agg(project_id, ',' ORDER BY weakness) AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy, project_id) AS weakness FROM f) WHERE weakness <= 3 GROUP BY model)
  SELECT model, 'b' AS source, round(micro, 6) AS micro_accuracy, round(macro, 6) AS macro_accuracy, weakest FROM r JOIN w USING (model)""")
def encoder_compare(spark, sf_dir):
    """Two reports of each model, of which the later one counts."""
    f = view(spark, sf_dir, "folds")
    own = f.groupBy("model").agg(F.collect_list(F.struct("project_id", "accuracy")).alias("folds")).join(evaluation.fold_summary(f, "model").drop("folds"), "model").withColumnRenamed("model", "embedding_model")
    older = own.withColumn("micro_accuracy", F.lit(0.0)).withColumn("source", F.lit("a"))
    df = evaluation.encoder_compare(own.withColumn("source", F.lit("b")).unionByName(older))
    weakest = F.array_join(F.transform("weak_folds", lambda x: x["project_id"]), ",")
    return df.select("model", "source", F.round("micro_accuracy", 6).alias("micro_accuracy"), F.round("macro_accuracy", 6).alias("macro_accuracy"), weakest.alias("weakest"))


PROBE = f"""a AS {duck('activations')}, x AS (SELECT layer, project_id, unnest(draft) AS d, unnest(revised) AS r, generate_subscripts(draft, 1) AS i FROM a),
  g AS (SELECT DISTINCT layer, project_id FROM a), o AS (SELECT g.layer, g.project_id, x.i, avg(x.r) - avg(x.d) AS diff, (avg(x.r) + avg(x.d)) / 2 AS mid FROM g JOIN x ON x.layer = g.layer AND x.project_id <> g.project_id GROUP BY 1, 2, 3),
  v AS (SELECT layer, project_id, list(diff ORDER BY i) AS w, sqrt(sum(diff * diff)) AS size, sum(diff * mid) AS t FROM o GROUP BY 1, 2),
  h AS (SELECT a.layer, a.project_id, list_dot_product(a.draft, w) AS pd, list_dot_product(a.revised, w) AS pr, t FROM a JOIN v USING (layer, project_id) WHERE size > 0),
  k AS (SELECT layer, project_id, count(*) AS n, avg(((pr > t)::INT + (pd <= t)::INT) / 2.0::DOUBLE) AS single_accuracy, avg((pr > pd)::INT) AS pair_accuracy FROM h GROUP BY 1, 2)"""


@query(f"WITH {PROBE} SELECT layer, project_id, n, round(single_accuracy, 6) AS single_accuracy FROM k")
def probe_single(spark, sf_dir):
    return evaluation.probe(view(spark, sf_dir, "activations")).select("layer", "project_id", "n", F.round("single_accuracy", 6).alias("single_accuracy"))


@query(f"WITH {PROBE} SELECT layer, project_id, n, round(pair_accuracy, 6) AS pair_accuracy FROM k")
def probe_pair(spark, sf_dir):
    return evaluation.probe(view(spark, sf_dir, "activations")).select("layer", "project_id", "n", F.round("pair_accuracy", 6).alias("pair_accuracy"))


@query(f"WITH {PROBE}, l AS (SELECT layer, round(sum(single_accuracy * n) / sum(n), 9) AS s, round(sum(pair_accuracy * n) / sum(n), 9) AS p FROM k GROUP BY layer) SELECT (SELECT layer FROM l ORDER BY s DESC, layer LIMIT 1) AS best_single, (SELECT layer FROM l ORDER BY p DESC, layer LIMIT 1) AS best_pair")
def probe_best(spark, sf_dir):
    return evaluation.best_layers(view(spark, sf_dir, "activations"))


# --- hard eval -----------------------------------------------------------------------------------------------------


def section_rows(spark, sf_dir):
    return mined(spark, sf_dir).withColumn("line_no", F.xxhash64("id"))


@query(f"""WITH {SECTION_PAIRS}, q AS (SELECT *, string_split(edited_text, chr(10))[1] AS head, list_transform(list_filter(string_split(regexp_replace(substr(edited_text, length(string_split(edited_text, chr(10))[1]) + 2), '^\n+|\n+$', '', 'g'), chr(10) || chr(10)), lambda p: {D.strip('p')} <> ''), lambda p: regexp_replace(p, '^\n+|\n+$', '', 'g')) AS ps FROM pairs)
  SELECT path, section_key, md5(head || chr(10) || chr(10) || array_to_string(ps, chr(10)) || chr(10)) AS joined, md5(head || chr(10) || chr(10) || array_to_string(list_reverse(ps), chr(10) || chr(10)) || chr(10)) AS reversed,
  md5(head || chr(10) || chr(10) || array_to_string(list_filter(string_split(array_to_string(ps, chr(10)), chr(10)), lambda l: {D.strip('l')} <> ''), chr(10) || chr(10)) || chr(10)) AS split FROM q WHERE len(ps) > 0""")
def degradations(spark, sf_dir):
    df = hardeval.degradations(mined(spark, sf_dir)).where(F.size(T.paragraphs(T.heading_and_body("edited_text")[1])) > 0)
    return df.select("path", "section_key", F.md5("deg_join").alias("joined"), F.md5("deg_reverse").alias("reversed"), F.md5("deg_split").alias("split"))


def rival_rows(spark, sf_dir):
    """Each pair of sections, and one of the same section with a longer edit and maybe another number of paragraphs."""
    rows = mined(spark, sf_dir)
    more = (F.length("edited_text") % 3 - 1).cast("int")
    rival = rows.withColumn("paragraph_count_edited", F.col("paragraph_count_edited") + more).withColumn("edited_text", F.concat("edited_text", F.lit(" z"))).withColumn("line_no", F.lit(1))
    return rows.withColumn("line_no", F.lit(0)).unionByName(rival)


CLEAN = "paragraph_count_source >= 3 AND paragraph_count_edited >= 3 AND NOT regexp_matches(source_text || edited_text, '```|~~~|\\|--|af://|★|<!--|TODO|FIXME')"


@query(f"""WITH {SECTION_PAIRS}, rivals AS (SELECT path, section_key, paragraph_count_source, paragraph_count_edited, source_text, edited_text, 0 AS line_no FROM pairs
    UNION ALL SELECT path, section_key, paragraph_count_source, paragraph_count_edited + length(edited_text) % 3 - 1, source_text, edited_text || ' z', 1 FROM pairs)
  SELECT path, section_key, md5(edited_text) AS edited, line_no FROM (SELECT *, row_number() OVER (PARTITION BY path, section_key ORDER BY abs(paragraph_count_edited - paragraph_count_source) DESC, length(edited_text), line_no) AS k FROM rivals WHERE {CLEAN}) WHERE k = 1""")
def best_section(spark, sf_dir):
    return hardeval.best_section(rival_rows(spark, sf_dir)).select("path", "section_key", F.md5("edited_text").alias("edited"), "line_no")


def windows(spark, sf_dir):
    return hardeval.expand_windows(hardeval.best_section(section_rows(spark, sf_dir)))


NL = "chr(10)"


def _trim(t: str) -> str:
    return f"regexp_replace({t}, '^\n+|\n+$', '', 'g')"


def _paragraphs(t: str) -> str:
    body = _trim(f"substr({t}, length(string_split({t}, {NL})[1]) + 2)")
    return f"list_transform(list_filter(string_split({body}, {NL} || {NL}), lambda p: {D.strip('p')} <> ''), lambda p: {_trim('p')})"


def _headed(head: str, body: str) -> str:
    return f"({head} || {NL} || {NL} || {_trim(body)} || {NL})"


WINDOWS = f"""{SECTION_PAIRS}, two AS (SELECT path, section_key, {_trim('source_text')} || {NL} AS s, {_trim('edited_text')} || {NL} AS e FROM pairs WHERE {CLEAN}),
  parted AS (SELECT *, string_split(s, {NL})[1] AS hs, string_split(e, {NL})[1] AS he, {_paragraphs('s')} AS ps, {_paragraphs('e')} AS pe FROM two),
  fit AS (SELECT *, least(len(ps), len(pe)) AS few, least(len(ps), len(pe)) >= 3 AND list_avg(list_transform(ps, lambda x: length(x))) >= 20 AND list_avg(list_transform(pe, lambda x: length(x))) >= 20 AS fine FROM parted),
  w AS (SELECT path, section_key, 'section' AS unit, 0 AS window_start, s AS base, e AS human FROM fit
    UNION ALL SELECT path, section_key, 'window', CAST(i AS INT), {_headed('hs', f"array_to_string(ps[i + 1:i + 3], {NL} || {NL})")}, {_headed('he', f"array_to_string(pe[i + 1:i + 3], {NL} || {NL})")} FROM (SELECT *, unnest(range(0, few - 2)) AS i FROM fit WHERE fine))"""


@query(f"WITH {WINDOWS} SELECT path, section_key, unit, window_start, md5(base) AS base, md5(human) AS human FROM w")
def window_candidates(spark, sf_dir):
    return windows(spark, sf_dir).select("path", "section_key", "unit", "window_start", F.md5("base_text").alias("base"), F.md5("human_text").alias("human"))


@query(f"""WITH {WINDOWS}, h AS (SELECT *, string_split(human, {NL})[1] AS head, {_paragraphs('human')} AS ps FROM w),
  c AS (SELECT *, {_headed('head', f"array_to_string(ps, {NL})")} AS joined, {_headed('head', f"array_to_string(list_reverse(ps), {NL} || {NL})")} AS reversed,
    {_headed('head', f"array_to_string(list_filter(string_split(array_to_string(ps, {NL}), {NL}), lambda l: {D.strip('l')} <> ''), {NL} || {NL})")} AS split FROM h),
  a AS (SELECT *, list_transform([human, joined, split, base, reversed], lambda t: {D.strip('t')}) AS five FROM c)
  SELECT path, section_key, unit, window_start, md5(joined) AS joined, md5(split) AS split, md5(reversed) AS reversed FROM a
  WHERE len(list_filter(five, lambda t: t = five[2])) = 1 AND len(list_filter(five, lambda t: t = five[3])) = 1 AND len(list_filter(five, lambda t: t = five[5])) = 1""")
def candidate_set(spark, sf_dir):
    text = lambda i: F.md5(F.get("candidates", F.lit(i))["text"])
    return hardeval.candidate_set(windows(spark, sf_dir)).select("path", "section_key", "unit", "window_start", text(1).alias("joined"), text(2).alias("split"), text(4).alias("reversed"))


def words_and_marks(text):
    """Stands for a tokenizer: words, and other characters than blanks."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))


def _tokens(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


POOL = f"""{WINDOWS.replace('(SELECT path, section_key, ', '(SELECT project_id, path, section_key, paragraph_count_source, paragraph_count_edited, ').replace('SELECT path, section_key, ', 'SELECT project_id, path, section_key, paragraph_count_source, paragraph_count_edited, ')},
  h AS (SELECT *, string_split(human, {NL})[1] AS head, {_paragraphs('human')} AS ps, {_tokens('base')} AS tb, {_tokens('human')} AS th FROM w),
  c AS (SELECT *, {_headed('head', f"array_to_string(ps, {NL})")} AS joined, {_headed('head', f"array_to_string(list_reverse(ps), {NL} || {NL})")} AS reversed,
    {_headed('head', f"array_to_string(list_filter(string_split(array_to_string(ps, {NL}), {NL}), lambda l: {D.strip('l')} <> ''), {NL} || {NL})")} AS split FROM h WHERE len(ps) >= 3 AND 2 * tb <= 512 AND tb + th <= 512),
  five AS (SELECT *, list_transform([human, joined, split, base, reversed], lambda t: {D.strip('t')}) AS f FROM c),
  pool AS (SELECT project_id, path, section_key, unit, window_start, CASE WHEN unit = 'window' THEN 3 ELSE paragraph_count_edited END AS np,
    row_number() OVER (PARTITION BY project_id, section_key ORDER BY -abs(paragraph_count_edited - paragraph_count_source), unit <> 'section', length(base), tie) AS rn,
    row_number() OVER (ORDER BY -abs(paragraph_count_edited - paragraph_count_source), unit <> 'section', length(base), tie) AS ord
    FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', project_id, path, section_key, unit, window_start)), 1, 15))::BIGINT AS tie FROM five)
    WHERE len(list_filter(f, lambda t: t = f[2])) = 1 AND len(list_filter(f, lambda t: t = f[3])) = 1 AND len(list_filter(f, lambda t: t = f[5])) = 1)"""


@query(f"""WITH RECURSIVE {POOL.replace('  pool AS (', '  pool AS MATERIALIZED (')},
  fold AS (SELECT DISTINCT project_id, section_key, 0::BIGINT AS rn, []::STRUCT(u VARCHAR, s INTEGER, p BIGINT)[] AS taken, NULL::BIGINT AS chosen FROM pool
    UNION ALL SELECT f.project_id, f.section_key, x.rn, CASE WHEN clash THEN taken ELSE list_append(taken, {{'u': x.unit, 's': x.window_start, 'p': x.np}}) END, CASE WHEN clash THEN NULL ELSE x.ord END
    FROM (SELECT f.*, x.rn AS nrn, len(list_filter(f.taken, lambda t: (t.s = x.window_start AND t.p = x.np) OR (t.u = 'window' AND x.unit = 'window' AND abs(t.s - x.window_start) < 3))) > 0 AS clash FROM fold f JOIN pool x ON x.project_id = f.project_id AND x.section_key = f.section_key AND x.rn = f.rn + 1) f
    JOIN pool x ON x.project_id = f.project_id AND x.section_key = f.section_key AND x.rn = f.nrn),
  capped AS (SELECT p.*, row_number() OVER (PARTITION BY p.project_id ORDER BY p.ord) AS k FROM fold JOIN pool p ON p.ord = fold.chosen)
  SELECT path, section_key, unit, window_start FROM capped WHERE k <= 8 ORDER BY ord LIMIT 50""")
def greedy_pick(spark, sf_dir):
    """The whole build: best sections, windows, candidate sets, token limit, pick."""
    return hardeval.build_hard_eval(section_rows(spark, sf_dir), n_items=50, pieces=words_and_marks).select("path", "section_key", "unit", "window_start")


def _preview(t: str) -> str:
    flat = FLAT.replace("(text,", f"({t},")
    return f"CASE WHEN length({flat}) <= 120 THEN {flat} ELSE left({flat}, 119) || '…' END"


@query(f"""WITH {PV}, t AS (SELECT doc_id AS id, text AS source_text, replace(text, 'e', 'E') AS edited_text FROM documents WHERE text IS NOT NULL),
  h AS (SELECT v.*, t.source_text, t.edited_text FROM v JOIN t ON v.id = t.id WHERE {D.usable('t.source_text', 't.edited_text', 1800)}),
  p AS (SELECT *, {_p('a', 'src', 'len_src', 'len_a', 'len_src')} AS p_ab, {_p('src', 'a', 'len_src', 'len_src', 'len_a')} AS p_ba FROM h),
  s AS (SELECT *, (p_ab + 1 - p_ba) / 2 AS score_edit, (1 - p_ab + p_ba) / 2 AS score_base, p_ab - p_ba AS margin FROM p)
  SELECT project_id AS file, id AS line_no, row_number() OVER (PARTITION BY project_id ORDER BY id) AS index, round(score_edit, 6) AS score_edit, round(score_base, 6) AS score_base,
    CASE WHEN margin >= 0.12 THEN 'preferred_edit' WHEN margin <= -0.25 THEN 'reject_edit' WHEN margin <= -0.12 THEN 'preferred_base' ELSE 'uncertain' END AS verdict,
    {_preview('source_text')} AS source_preview, {_preview('edited_text')} AS edited_preview FROM s""")
def check_report(spark, sf_dir):
    """Hunks of documents' texts, scored by the vectors of the same number."""
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("source_text"), F.replace("text", F.lit("e"), F.lit("E")).alias("edited_text"))
    hunks = view(spark, sf_dir, "pref_vectors").join(texts, "id").withColumnRenamed("project_id", "file").withColumn("line_no", F.col("id"))
    return scoring.check(hunks, literal_sines(N_PAIR)).select("file", "line_no", "index", F.round("score_edit", 6).alias("score_edit"), F.round("score_base", 6).alias("score_base"), "verdict", "source_preview", "edited_preview")


def items(spark, sf_dir):
    """Hard-eval items of the candidates; some are broken on purpose."""
    c = view(spark, sf_dir, "candidates")
    one = F.struct("gold_rank", F.struct(F.when((F.col("item") % 7 == 0) & (F.col("cand_index") == 2), "c1").otherwise(F.col("cand")).alias("id"), F.concat(F.lit("text "), "cand").alias("text")).alias("c"))
    df = c.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("candidates"))
    ids = F.transform("candidates", lambda x: x["id"])
    best = F.when(F.col("item") % 5 == 0, "zz").otherwise(ids[0])
    rank = F.when(F.col("item") % 11 == 0, F.slice(ids, 1, 2)).otherwise(ids)
    return df.select(F.col("item").alias("id"), "candidates", F.struct(best.alias("best_id"), rank.alias("rank")).alias("human"), F.when(F.col("item") % 3 == 0, "pending").otherwise("labeled").alias("status"), F.when(F.col("item") % 13 == 0, " ").otherwise("base").alias("base_text"))


@query(f"""WITH i AS (SELECT item, count(*) AS n, count_if(cand_index IN (1, 2)) AS pair FROM {duck('candidates')} GROUP BY item)
  SELECT item AS id, CASE WHEN item % 3 = 0 THEN NULL WHEN n < 2 THEN 'few_candidates' WHEN item % 7 = 0 AND pair = 2 THEN 'duplicate_ids' WHEN item % 5 = 0 THEN 'unknown_best' WHEN item % 11 = 0 AND n <> 2 THEN 'bad_rank' WHEN item % 13 = 0 THEN 'blank_base' END AS error FROM i""")
def hard_eval_errors(spark, sf_dir):
    return hardeval.validate(items(spark, sf_dir)).select("id", "error")


@query(f"SELECT a.item AS id, a.cand AS better, b.cand AS worse FROM {duck('candidates')} a JOIN {duck('candidates')} b ON a.item = b.item AND a.gold_rank < b.gold_rank")
def rank_pairs(spark, sf_dir):
    c = view(spark, sf_dir, "candidates").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("gold_rank", "cand"))), lambda x: x["cand"]).alias("rank"))
    return hardeval.rank_pairs(c.withColumnRenamed("item", "id"))


@query(f"WITH i AS (SELECT DISTINCT item FROM {duck('candidates')}) SELECT item AS id, CASE WHEN item % 4 = 0 THEN NULL ELSE 'model ' || item END AS model, item % 4 = 0 AS missing FROM i")
def three_way(spark, sf_dir):
    own = items(spark, sf_dir)
    texts = own.where("id % 4 <> 0").select("id", F.concat(F.lit("model "), "id").alias("text"))
    return hardeval.three_way(own, texts).select("id", F.get("candidates", F.lit(1))["text"].alias("model"), "missing")


def previews(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    block = F.concat(F.lit("### `"), "cand", F.lit("` (script)\n\n"), F.lit("text "), "cand", F.lit("\n"))
    body = c.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gold_rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    return body.select(F.concat(F.lit("# Preview\n\n## he-"), "item", F.lit("\n\nnote\n\n"), "b").alias("text"))


@query(f"SELECT 'he-' || item AS item, CAST(row_number() OVER (PARTITION BY item ORDER BY gold_rank) AS INT) AS position, cand, 'text ' || cand AS body FROM {duck('candidates')}")
def preview_parse(spark, sf_dir):
    return hardeval.parse_ranked_preview(previews(spark, sf_dir))


@query(f"""WITH i AS (SELECT item, arg_min(cand, gold_rank) AS best FROM {duck('candidates')} GROUP BY item) SELECT 'he-' || item AS id, CASE WHEN item % 6 = 0 THEN NULL ELSE best END AS best_id, CASE WHEN item % 6 = 0 THEN 'not_in_preview' END AS error FROM i""")
def apply_ranks(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    own = c.groupBy("item").agg(F.collect_list(F.struct(F.col("cand").alias("id"), F.concat(F.lit("text "), "cand").alias("text"))).alias("candidates")).select(F.concat(F.lit("he-"), "item").alias("id"), "candidates")
    shown = hardeval.parse_ranked_preview(previews(spark, sf_dir)).where(F.substring("item", 4, 20).cast("long") % 6 != 0)
    return hardeval.apply_ranks(own, shown).select("id", "best_id", "error")


# --- fits: rows only -----------------------------------------------------------------------------------------------


def _features(spark, sf_dir):
    df = view(spark, sf_dir, "pref_vectors")
    return df.select("project_id", "label", V.preference_features("src", "a", "b", "len_src", "len_a", "len_b").alias("features"), V.pointwise_features("src", "a", "len_src", "len_a").alias("fa"), V.pointwise_features("src", "b", "len_src", "len_b").alias("fb"))


@query()
def lopo_pairwise(spark, sf_dir):
    return models.lopo(_features(spark, sf_dir).select("project_id", "label", "features"))


@query()
def lopo_bt(spark, sf_dir):
    first = F.col("label") == 1
    df = _features(spark, sf_dir).select("project_id", F.when(first, F.col("fa")).otherwise(F.col("fb")).alias("better"), F.when(first, F.col("fb")).otherwise(F.col("fa")).alias("worse"))
    return models.lopo(df, "bt")


@query(f"""WITH t AS (SELECT DISTINCT unnest([source_text, edited_text]) AS text FROM {duck('examples')}), c AS (SELECT text, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS c FROM t),
  g AS (SELECT text, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] + 131 * c[i + 1] + 17161 * c[i + 2]) % 256)) AS b FROM c WHERE len(c) >= 3),
  n AS (SELECT text, b, count(*)::DOUBLE AS x FROM g GROUP BY text, b), v AS (SELECT text, b, (x / sqrt(sum(x * x) OVER (PARTITION BY text)))::FLOAT::DOUBLE AS x FROM n)
  SELECT md5(t.text) AS digest, 256 AS size, round(coalesce(sum(x), 0), 5) AS total, round(coalesce(sum(x * sin(b) / 10), 0), 5) AS weighed FROM t LEFT JOIN v USING (text) GROUP BY t.text""")
def encoded_texts(spark, sf_dir):
    e = view(spark, sf_dir, "examples").select(F.explode(F.array("source_text", "edited_text")).alias("text"))
    return hooks.encode_texts(e).select(F.md5("text").alias("digest"), *digest(V.doubles("vec")))


FEATURES = f"""{PV}, f AS (SELECT {D.preference('src', 'a', 'b', 'len_src', 'len_a', 'len_b')} AS x, 2 * label - 1 AS y FROM v),
  p AS (SELECT unnest(x) AS x, generate_subscripts(x, 1) AS pos, -y / (1 + exp(y * (list_dot_product({D.weights(N_PAIR)}, x) + 0.25))) AS pull FROM f)"""


@query(f"""WITH {FEATURES}, s AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, sum(pull) AS pulls, sum(pull * x) AS pulled FROM p GROUP BY pos)
  SELECT pos, round(sin(pos - 1) / 10 * std, 6) AS weight, round(0.5 * (pulled - mean * pulls) / std + sin(pos - 1) / 10 * std, 6) AS gradient FROM s UNION ALL SELECT 0, 0.25, round(0.5 * pulls, 6) FROM s WHERE pos = 1""")
def objective_gradient(spark, sf_dir):
    """The gradient of the fits' objective, at given weights."""
    weights = models.LinearModel([math.sin(i) / 10 for i in range(N_PAIR)], 0.25)
    return models.optimality(_features(spark, sf_dir).select("label", "features"), weights, c=0.5).select("pos", F.round("weight", 6).alias("weight"), F.round("gradient", 6).alias("gradient"))


@query(f"""WITH {FEATURES} SELECT kind, features, true AS optimal, n FROM (SELECT count(DISTINCT pos) AS features, count(*) // count(DISTINCT pos) AS n FROM p), (VALUES ('pairwise')) k(kind)
  UNION ALL SELECT 'bt', {N_POINT}, true, count(*) FROM v""")
def fit_optimality(spark, sf_dir):
    """Both fits on whole features; optimal where the gradient at the fitted weights is under a thousandth of that at zero."""
    df = _features(spark, sf_dir).persist()
    first = F.col("label") == 1
    pairs = df.select(F.when(first, F.col("fa")).otherwise(F.col("fb")).alias("better"), F.when(first, F.col("fb")).otherwise(F.col("fa")).alias("worse"))
    found = None
    for kind, data, fit, n in (("pairwise", df, models.fit_pairwise, N_PAIR), ("bt", pairs, models.fit_bt, N_POINT)):
        size = lambda model: models.optimality(data, model, kind).agg(F.sqrt(F.sum(F.col("gradient") ** 2)).alias("size"), F.count_if(F.col("pos") > 0).alias("features"))  # noqa: B023, E731
        at, start = size(fit(data)), size(models.LinearModel([0.0] * n, 0.0)).select(F.col("size").alias("start"))
        row = at.crossJoin(start).select(F.lit(kind).alias("kind"), "features", (F.col("size") <= F.col("start") / 1000).alias("optimal"))
        found = row if found is None else found.union(row)
    return found.crossJoin(df.agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT project_id, path, md5(text) AS text FROM {duck('revisions')} WHERE ref = 'edit/x'")
def edit_hunks(spark, sf_dir):
    """Each edited file made again from its base and the hunks between the two."""
    revisions = view(spark, sf_dir, "revisions")
    rebuilt = mining.apply_hunks(revisions.where("ref = 'x'").drop("ref"), mining.edit_hunks(revisions, "x", "edit/x"))
    return rebuilt.select("project_id", "path", F.md5("rebuilt").alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pref_by_split(spark, sf_dir)
