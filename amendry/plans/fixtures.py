"""Views over the driver tables that feed the queries, as one SQL text for Spark and DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "embeddings", "orders", "labels")


@dataclass(frozen=True)
class Dialect:
    """Where the two engines differ."""

    spark: bool

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def day(self, n: str) -> str:
        return f"date_add(DATE '2026-01-01', CAST({n} AS INT))" if self.spark else f"(DATE '2026-01-01' + CAST({n} AS INT))"

    def split(self, text: str, by: str) -> str:
        return f"split({text}, '{by}')" if self.spark else f"string_split({text}, '{by}')".replace("\\n", "' || chr(10) || '")

    @property
    def nl(self) -> str:
        return "char(10)" if self.spark else "chr(10)"

    def map(self, items: str, var: str, body: str) -> str:
        return f"transform({items}, {var} -> {body})" if self.spark else f"list_transform({items}, lambda {var}: {body})"

    def keep(self, items: str, var: str, body: str) -> str:
        return f"filter({items}, {var} -> {body})" if self.spark else f"list_filter({items}, lambda {var}: {body})"

    def upto(self, n: str) -> str:
        """0 to n - 1."""
        return f"filter(sequence(0, CAST({n} AS INT)), q -> q < {n})" if self.spark else f"range(CAST({n} AS INT))"

    def at(self, items: str, i: str) -> str:
        """The item with number i from 0, or null."""
        return f"get({items}, CAST({i} AS INT))" if self.spark else f"{items}[CAST({i} AS INT) + 1]"

    def join(self, items: str, by: str) -> str:
        return f"array_join({items}, {by})" if self.spark else f"array_to_string({items}, {by})"

    def size(self, items: str) -> str:
        return f"size({items})" if self.spark else f"len({items})"

    def doubles(self, v: str) -> str:
        return f"CAST({v} AS ARRAY<DOUBLE>)" if self.spark else f"CAST({v} AS DOUBLE[])"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)" if self.spark else f"list_dot_product({a}, {b})"

    def agg_text(self, text: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {text} AS x))), z -> z.x), char(10))" if self.spark else f"string_agg({text}, chr(10) ORDER BY {order})"


SPARK, DUCK = Dialect(True), Dialect(False)


def examples(d: Dialect) -> str:
    """User turns and the assistant turns that follow; some again under the same id, some under a new one."""
    columns = "id, conv_id, project_id, source_text, edited_text, source_reference, review_result, created_at, line_no"
    return f"""
WITH base AS (
  SELECT concat('c', u.conv_id, '-', u.turn) AS id, u.conv_id, concat('p', u.conv_id % 13) AS project_id,
    u.text AS source_text, a.text AS edited_text,
    CASE WHEN u.conv_id % 5 = 0 THEN concat('ref', u.conv_id % 3) ELSE '' END AS source_reference,
    CASE WHEN u.conv_id % 10 = 0 THEN 'rejected' WHEN u.conv_id % 10 = 1 THEN 'pending' ELSE 'accepted' END AS review_result,
    {d.day('u.conv_id % 2000')} AS created_at, u.conv_id * 100 + u.turn AS line_no
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT {columns} FROM base
UNION ALL SELECT id, conv_id, project_id, source_text, concat(edited_text, ' again'), source_reference, 'accepted', created_at, line_no + 1000000000000 FROM base WHERE conv_id % 7 = 0
UNION ALL SELECT concat(id, '-b'), conv_id, project_id, source_text, edited_text, source_reference, review_result, created_at, line_no + 2000000000000 FROM base WHERE conv_id % 11 = 0"""


def revisions(d: Dialect) -> str:
    """Markdown files of five documents, one section each with two lines a paragraph; branch edit/x changes some paragraphs."""
    lines = d.split("text", "\\n")
    pair = d.map(d.upto("ceil(" + d.size("ls") + " / 2.0)"), "i", f"concat_ws({d.nl}, {d.at('ls', 'i * 2')}, {d.at('ls', 'i * 2 + 1')})")
    edited = d.keep(d.map(d.upto(d.size("ps")), "i", f"CASE WHEN i % 7 = 6 THEN '' WHEN i % 3 = 2 THEN replace({d.at('ps', 'i')}, 'e', 'E') ELSE {d.at('ps', 'i')} END"), "p", "p <> ''")
    body = lambda items: f"concat(head, {d.nl}, {d.nl}, {d.join(items, f'concat({d.nl}, {d.nl})')}, {d.nl})"
    return f"""
WITH a AS (SELECT doc_id, {lines} AS ls, concat(substring('###', 1, CAST(1 + doc_id % 3 AS INT)), ' Doc ', doc_id % 4) AS head FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, head, {pair} AS ps FROM a),
c AS (SELECT doc_id, {body('ps')} AS base_text, {body(edited)} AS edit_text FROM b),
f AS (SELECT {d.div('doc_id', 5)} AS file, {d.agg_text('base_text', 'doc_id')} AS base_text, {d.agg_text('edit_text', 'doc_id')} AS edit_text FROM c GROUP BY {d.div('doc_id', 5)})
SELECT concat('p', file % 20) AS project_id, concat('f', file, '.md') AS path, 'x' AS ref, base_text AS text FROM f
UNION ALL SELECT concat('p', file % 20), concat('f', file, '.md'), 'edit/x', edit_text FROM f"""


def diffs(d: Dialect) -> str:
    """Unified diffs of documents against copies with E for e, a hunk for each line; some hunks only add."""
    rows = d.map(
        d.upto(d.size("ls")), "i",
        f"concat('@@ -', i + 1, ',1 +', i + 1, ',1 @@', {d.nl}, CASE WHEN i % 4 = 3 THEN '' ELSE concat('-', {d.at('ls', 'i')}, {d.nl}) END, CASE WHEN i % 5 = 4 THEN concat('--- gone', {d.nl}) ELSE '' END, ' same', {d.nl}, '+', replace({d.at('ls', 'i')}, 'e', 'E'), '  ')",
    )
    return f"""
WITH a AS (SELECT doc_id, {d.split('text', chr(92) + 'n')} AS ls FROM documents WHERE text IS NOT NULL)
SELECT concat('p', doc_id % 13) AS project_id, concat('f', doc_id, '.md') AS path,
  concat('diff --git a b', {d.nl}, '--- a', {d.nl}, '+++ b', {d.nl}, {d.join(rows, d.nl)}, {d.nl}) AS diff FROM a"""


def pref_vectors(d: Dialect) -> str:
    """Three neighbouring embeddings as source and two candidates; label 1 where a is nearer to the source."""
    third = d.div("vec_id", 3)
    part = lambda k: f"SELECT {third} AS id, {d.doubles('embedding')} AS v, label, vec_id FROM embeddings WHERE vec_id % 3 = {k}"
    return f"""
SELECT s.id, concat('p', s.label) AS project_id, s.v AS src, a.v AS a, b.v AS b,
  CAST(s.vec_id % 100 AS DOUBLE) AS len_src, CAST(a.vec_id % 70 AS DOUBLE) AS len_a, CAST(b.vec_id % 90 AS DOUBLE) AS len_b,
  CASE WHEN {d.dot('s.v', 'a.v')} >= {d.dot('s.v', 'b.v')} THEN 1 ELSE 0 END AS label
FROM ({part(0)}) s JOIN ({part(1)}) a ON s.id = a.id JOIN ({part(2)}) b ON s.id = b.id"""


def candidates(d: Dialect) -> str:
    """Six neighbouring embeddings: a source and five candidates, with the length of a document's text."""
    sixth = d.div("vec_id", 6)
    return f"""
WITH v AS (SELECT {sixth} AS item, vec_id % 6 AS k, {d.doubles('embedding')} AS v, vec_id FROM embeddings)
SELECT c.item, CAST(c.k AS INT) AS cand_index, concat('c', c.k) AS cand, CAST((c.k * 7 + c.item) % 5 + 1 AS INT) AS gold_rank, s.v AS src, c.v AS cand_vec,
  CAST(c.vec_id % 50 AS DOUBLE) AS len_src, CAST(coalesce(length(t.text), 0) AS DOUBLE) AS len_cand, {d.dot('s.v', 'c.v')} AS cosine
FROM v c JOIN v s ON c.item = s.item AND s.k = 0 LEFT JOIN documents t ON t.doc_id = c.vec_id WHERE c.k > 0"""


def activations(d: Dialect) -> str:
    return f"""
SELECT concat('a', {d.div('x.vec_id', 2)}) AS pair_id, concat('p', x.label) AS project_id, CAST({d.div('x.vec_id', 2)} % 4 AS INT) AS layer,
  {d.doubles('x.embedding')} AS draft, {d.doubles('y.embedding')} AS revised
FROM embeddings x JOIN embeddings y ON x.vec_id % 2 = 0 AND y.vec_id = x.vec_id + 1"""


def generations(d: Dialect) -> str:
    """First, second and third assistant turn of each conversation as two modes and a reference text."""
    return """
WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user')
SELECT concat('g', r.conv_id) AS id, concat('p', r.conv_id % 13) AS project_id,
  CASE r.k WHEN 1 THEN 'adapter' WHEN 2 THEN 'base_norms' ELSE 'gold' END AS mode, r.text AS generated, CAST(r.k AS INT) AS line_no,
  CAST(length(r.text) % 17 AS DOUBLE) AS score, u.text AS draft FROM r LEFT JOIN u ON u.conv_id = r.conv_id AND u.k = 1 WHERE r.k <= 3"""


def commits(d: Dialect) -> str:
    """Order keys of one customer as a chain of commits; every fifth merges an older one from an edit branch."""
    return """
WITH n AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT concat('p', o_custkey) AS project_id, k, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS n_parents,
  CASE WHEN k % 10 = 0 THEN concat('Merge pull request #', k, ' from me/edit/b', k % 7) WHEN k % 5 = 0 THEN concat('Merge branch ''edit/l', k % 3, '''') ELSE concat('work ', k) END AS subject FROM n"""


def history(d: Dialect) -> str:
    """Commits in blocks of seven: three of the mainline, two of a branch, one more of the mainline, and their merge.
    Every third block is criss-cross, every third ends in an octopus; some blocks begin with a merge of what they hold."""
    name = lambda k: f"substring(md5(concat('p', p, '-', {k})), 1, 12)"
    block = d.div("k", 7)
    items = lambda *xs: ("array(" if d.spark else "[") + ", ".join(xs) + (")" if d.spark else "]")
    parents = f"""CASE WHEN k % 7 = 6 AND {block} % 3 = 2 THEN {items('k - 1', 'k - 2', 'k - 6')} WHEN k % 7 = 6 THEN {items('k - 1', 'k - 2')}
    WHEN k % 7 = 5 AND {block} % 3 = 1 THEN {items('k - 3', 'k - 2')} WHEN k % 7 = 5 THEN {items('k - 3')} WHEN k % 7 = 4 AND {block} % 3 = 1 THEN {items('k - 1', 'k - 2')}
    WHEN k % 7 = 3 THEN {items('k - 2')} WHEN k % 7 = 0 AND {block} % 4 = 3 THEN {items('k - 1', 'k - 5')} ELSE {items('k - 1')} END"""
    return f"""
WITH n AS (SELECT CAST(o_custkey % 40 AS INT) AS p, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INT) AS k FROM orders),
x AS (SELECT p, k, {parents} AS xs FROM n)
SELECT concat('p', p) AS project_id, {name('k')} AS commit, {d.map(d.keep('xs', 'x', 'x >= 1'), 'y', name('y'))} AS parents, k, {block} AS block,
  CASE WHEN k % 7 IN (0, 6) AND k % 2 = 0 THEN concat('Merge pull request #', k, ' from me/edit/b', {block}) WHEN k % 7 IN (0, 6) THEN concat('Merge branch ', chr(39), 'edit/l', {block}, chr(39)) ELSE concat('work ', k) END AS subject FROM x"""


def snapshots(d: Dialect) -> str:
    """The files of `revisions` at the fork and at the last commit of a block's branch; some miss one side, some don't change."""
    at = lambda k: f"substring(md5(concat(project_id, '-', 7 * (n % 9) + {k})), 1, 12)"
    number = d.div("CAST(substring(path, 2, length(path) - 4) AS INT)", 20)
    return f"""
WITH r AS ({revisions(d)}),
s AS (SELECT project_id, path, ref AS label, text, {number} AS n FROM r)
SELECT project_id, CASE WHEN n % 5 = 4 THEN concat(path, '.png') ELSE path END AS path, CASE WHEN label = 'x' THEN {at(1)} ELSE {at(4)} END AS ref, CASE WHEN n % 6 = 5 THEN 'same' ELSE text END AS text
FROM s WHERE NOT (n % 7 = 6 AND label = 'x')"""


def folds(d: Dialect) -> str:
    """Documents of a source as folds of their language's report."""
    return """
SELECT lang AS model, source AS project_id, count(*) AS n, avg(CASE WHEN n_chars % 3 > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy, avg(n_chars % 7) / 10.0 AS log_loss
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source"""


VIEWS = {f.__name__: f for f in (examples, revisions, diffs, pref_vectors, candidates, activations, generations, commits, history, snapshots, folds)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name](SPARK)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    for t in tables:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(f"{lead}{t} ", f"{lead}{{{t}}} ").replace(f"{lead}{t}\n", f"{lead}{{{t}}}\n").replace(f"{lead}{t})", f"{lead}{{{t}}})")
    return spark.sql(sql, **tables)


def duck(name: str) -> str:
    return f"({VIEWS[name](DUCK)})"
