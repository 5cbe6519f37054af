"""Draft and revised texts from diffs, from Markdown sections of two revisions, and from commits and branches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amendry.functions import text as T
from amendry.operators.curation import first_by

SIDES = ("base_label", "edit_label", "base_commit", "edit_commit")
TEXT_SUFFIXES = ("md", "rst", "txt", "adoc", "org")


def text_paths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).isin(*TEXT_SUFFIXES)).select(path).distinct()


def parse_unified_diff(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """One row for each usable hunk of each diff: its number, line numbers, and both sides without blank lines.

    Works inside each row, without a shuffle. File headers are skipped wherever they stand, so a removed line that
    starts with "-- " is lost. Diffs that name labels and commits of both sides give each hunk its source_reference.
    """
    lines = T.split_lines(diff)
    numbered = F.filter(F.transform(F.col("_lines"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda s: F.startswith(s["x"], F.lit("@@ ")))
    df = diffs.withColumn("_lines", lines).withColumn("_heads", numbered)
    after = lambda i: F.coalesce(F.get(F.col("_heads"), i + 1)["at"], F.size("_lines") + 1)
    hunks = F.transform("_heads", lambda h, i: F.struct((i + 1).alias("hunk_no"), h["x"].alias("head"), F.slice(F.col("_lines"), h["at"] + 1, after(i) - h["at"] - 1).alias("body")))
    df = df.withColumn("_hunk", F.explode(hunks)).drop("_lines", "_heads")
    side = lambda mark, header: F.array_join(
        T.clean_lines(F.transform(F.filter(F.col("_hunk.body"), lambda x: F.startswith(x, F.lit(mark)) & ~F.startswith(x, F.lit(header))), lambda x: F.substring(x, 2, 1 << 30))), "\n"
    )
    number = lambda sign: F.nullif(F.regexp_extract("_hunk.head", rf"\A@@ .*?\{sign}(\d+)", 1), F.lit("")).cast("int")
    out = df.withColumn("source_text", side("-", "--- ")).withColumn("edited_text", side("+", "+++ "))
    if set(SIDES) <= set(diffs.columns):
        out = out.withColumn("source_reference", T.source_reference(F.col("path"), *map(F.col, SIDES)))
    out = out.withColumn("hunk_no", F.col("_hunk.hunk_no")).withColumn("line_old", number("-")).withColumn("line_new", number("+"))
    return out.where(T.usable_pair("source_text", "edited_text")).drop("_hunk", diff)


def _meeting(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (from, to in both) in the middle of a shortest edit script, found from both ends at once.

    Only the furthest points of each diagonal are kept, so memory grows with the lines, not with their product.
    """
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        diagonals = range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2)
        for from_start, own, other in ((True, ahead, back), (False, back, ahead)):
            for k in diagonals:
                down, right = own.get(k + 1, -1), own.get(k - 1, -1) + 1
                x = begin = down if k == -d or (k != d and right <= down) else right
                y = x - k
                while x < n and y < m and (a[x] == b[y] if from_start else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                own[k] = x
                turns = d - 1 if from_start else d  # of the other side so far
                if (delta % 2 == 1) == from_start and abs(delta - k) <= turns and x + other.get(delta - k, -1 - n) >= n:
                    return (begin, begin - k, x, y) if from_start else (n - x, m - y, n - begin, m - begin + k)
    raise AssertionError


def changed_blocks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Blocks (a, b, c, d): lines a to b of `old` are replaced by lines c to d of `new`, as few lines as possible."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in lines] for lines in (old, new))
    todo, found = [(0, len(x), 0, len(y))], []
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
        if a == b or c == d:
            if a < b or c < d:
                found.append((a, b, c, d))
            continue
        begin, low, end, high = _meeting(x[a:b], y[c:d])
        todo += [(a + end, b, c + high, d), (a, a + begin, c, c + low)]
    blocks: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(found):
        if blocks and blocks[-1][1] == a and blocks[-1][3] == c:
            blocks[-1] = (blocks[-1][0], b, blocks[-1][2], d)
        else:
            blocks.append((a, b, c, d))
    return blocks


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            old, new = (row.base_text or "").split("\n"), (row.edit_text or "").split("\n")
            rows += [(row.project_id, row.path, k + 1, a + 1, c + 1, old[a:b], new[c:d]) for k, (a, b, c, d) in enumerate(changed_blocks(old, new))]
        yield pd.DataFrame(rows, columns=["project_id", "path", "hunk_no", "line_old", "line_new", "removed", "added"])


def edit_hunks(revisions: DataFrame, base: str, edit: str) -> DataFrame:
    """(project_id, path, hunk_no, line_old, line_new, removed, added): a shortest line edit script of each file.

    Files that one side lacks have no rows; null texts are empty. Applied to the base the hunks give the edited text.
    """
    schema = "project_id string, path string, hunk_no int, line_old int, line_new int, removed array<string>, added array<string>"
    return pair_revisions(revisions, base, edit).mapInPandas(_edits, schema)


def apply_hunks(files: DataFrame, hunks: DataFrame, text: str = "text") -> DataFrame:
    """Files (project_id, path, text) with `rebuilt`: the text after its hunks; files without hunks stay as they are."""
    own = hunks.groupBy("project_id", "path").agg(F.array_sort(F.collect_list(F.struct("line_old", F.size("removed").alias("gone"), "added"))).alias("_hunks"))
    df = files.join(own, ["project_id", "path"], "left").withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda s, h: F.struct((h["line_old"] + h["gone"]).alias("at"), F.concat(s["out"], F.slice(F.col("_lines"), s["at"], h["line_old"] - s["at"]), h["added"]).alias("out"))
    done = F.aggregate(F.coalesce("_hunks", F.array()), start, step, lambda s: F.concat(s["out"], F.slice(F.col("_lines"), s["at"], F.size("_lines") + 1)))
    return df.withColumn("rebuilt", F.array_join(done, "\n")).drop("_hunks", "_lines")


def diff_hunks(revisions: DataFrame, base: str, edit: str) -> DataFrame:
    """Replaced blocks of lines between two revisions of each file, without blank lines; borders of ambiguous edits may
    differ from git's."""
    both = edit_hunks(revisions, base, edit).where("size(removed) > 0 AND size(added) > 0")
    clean = lambda x: F.array_join(T.clean_lines(x), "\n")
    found = both.select("project_id", "path", "line_old", "line_new", clean(F.col("removed")).alias("source_text"), clean(F.col("added")).alias("edited_text"))
    return found.where(T.usable_pair("source_text", "edited_text"))


def pair_revisions(revisions: DataFrame, base: str, edit: str) -> DataFrame:
    side = lambda ref, name: revisions.where(F.col("ref") == ref).select("project_id", "path", F.col("text").alias(name))
    return side(base, "base_text").join(side(edit, "edit_text"), ["project_id", "path"])


def split_sections(files: DataFrame, text: str = "text", keys: tuple[str, ...] = ("project_id", "path", "ref")) -> DataFrame:
    """(keys, section_no, section_key, body): Markdown sections under breadcrumbs of their open headings.

    Works inside each row; only the last-wins rule for repeated headings needs a shuffle, on digests. Text before the
    first heading is `__preamble__`; fences are not special.
    """
    heading = r"\A(#{1,6})\s+(.*)\z"
    heads = F.filter(
        F.transform("_lines", lambda x, i: F.struct((i + 1).alias("at"), F.length(F.regexp_extract(x, heading, 1)).alias("level"), T.normalize_heading(F.regexp_extract(x, heading, 2)).alias("title"))),
        lambda h: h["level"] > 0,
    )
    df = files.select(*keys, T.split_lines(text).alias("_lines")).withColumn("_heads", heads)
    none = F.expr("cast(array() as array<struct<at:int,level:int,title:string>>)")

    def key(i: Column) -> Column:
        open_heads = F.aggregate(F.slice(F.col("_heads"), 1, i + 1), none, lambda stack, h: F.concat(F.filter(stack, lambda x: x["level"] < h["level"]), F.array(h)))
        return F.array_join(F.transform(open_heads, lambda x: x["title"]), " > ")

    body = lambda start, stop: F.concat(T.rstrip(F.array_join(F.slice(F.col("_lines"), start, stop - start), "\n")), F.lit("\n"))
    end = F.size("_lines") + 1
    first = F.coalesce(F.get(F.col("_heads"), F.lit(0))["at"], end)
    preamble = F.array(F.struct(F.lit(0).alias("section_no"), F.lit("__preamble__").alias("section_key"), body(F.lit(1), first).alias("body")))
    sections = F.transform("_heads", lambda h, i: F.struct((i + 1).alias("section_no"), key(i).alias("section_key"), body(h["at"], F.coalesce(F.get(F.col("_heads"), i + 1)["at"], end)).alias("body")))
    out = df.select(*keys, F.explode(F.concat(preamble, sections)).alias("s")).select(*keys, "s.*").where(T.strip("body") != "")
    return first_by(out, [*keys, "section_key"], F.desc("section_no"))


def section_pairs(revisions: DataFrame, base: str, edit: str, max_chars: int = 12000) -> DataFrame:
    """Sections with one key in both revisions whose texts are usable and differ, with shapes and ids."""
    both = revisions.where(F.col("ref").isin(base, edit))
    found = split_sections(both)
    side = lambda ref, name: found.where(F.col("ref") == ref).select("project_id", "path", "section_key", F.col("body").alias(name))
    df = section_rows(side(base, "source_text").join(side(edit, "edited_text"), ["project_id", "path", "section_key"], "full_outer"), max_chars)
    if "commit" in revisions.columns:
        named = lambda ref, name: revisions.where(F.col("ref") == ref).select("project_id", "path", F.col("commit").alias(name))
        df = df.join(named(base, "_base"), ["project_id", "path"]).join(named(edit, "_edit"), ["project_id", "path"])
        whence = T.source_reference(F.col("path"), F.lit(base), F.lit(edit), F.col("_base"), F.col("_edit"), F.col("section_key"))
        df = df.withColumn("source_reference", whence).drop("_base", "_edit")
    return df


def section_rows(both: DataFrame, max_chars: int = 12000) -> DataFrame:
    """Of matched sections (project_id, path, section_key, source_text, edited_text, ...) those with usable, different
    texts, stripped, with their shapes and ids."""
    df = both.withColumns({x: T.strip(F.coalesce(x, F.lit(""))) for x in ("source_text", "edited_text")})
    df = df.where(T.usable_section("source_text", "edited_text", max_chars))
    digest = F.substring(F.sha2(F.concat_ws("\n---\n", "section_key", "source_text", "edited_text"), 256), 1, 12)
    shapes = [f(x).alias(f"{n}_count_{s}") for n, f in (("paragraph", T.paragraph_count), ("line", T.line_count)) for s, x in (("source", "source_text"), ("edited", "edited_text"))]
    key = F.substring(T.slug("section_key"), 1, 48)
    return df.select("*", F.concat_ws("-", "project_id", T.slug("path"), key, digest).alias("id"), *shapes)


def section_stats(pairs: DataFrame) -> DataFrame:
    """Shares of paragraph and line changes, and lengths of both sides (mean cut to int, median, positional 90 %).

    Rows are counted by side and length first; percentiles come from running sums over the lengths, of which there are
    as many as the longest text has characters.
    """
    flags = {
        "boundary_share": F.contains("source_text", F.lit("\n\n")) | F.contains("edited_text", F.lit("\n\n")),
        "multi_share": (F.col("paragraph_count_source") > 1) | (F.col("paragraph_count_edited") > 1),
        "paragraphs_changed": F.col("paragraph_count_source") != F.col("paragraph_count_edited"),
        "lines_changed": F.col("line_count_source") != F.col("line_count_edited"),
    }
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.length(f"{s}_text").alias("length")) for s in ("source", "edited")))
    rows = pairs.select(*(c.alias(name) for name, c in flags.items()), F.explode(sides).alias("s")).select(*flags, "s.*")
    by = rows.groupBy("side", "length").agg(F.count(F.lit(1)).alias("c"), *(F.count_if(F.col(x)).alias(x) for x in flags))
    own = Window.partitionBy("side")
    by = by.withColumn("upto", F.sum("c").over(own.orderBy("length"))).withColumn("all", F.sum("c").over(own))
    n = F.sum(F.when(F.col("side") == "source", F.col("c")).otherwise(0))

    def lengths(side: str) -> list[Column]:
        here = F.col("side") == side
        at = lambda place: F.min(F.when(here & (F.col("upto") >= place), F.col("length")))  # noqa: E731  the length with this number, from 1
        total = F.col("all")
        median = (at(F.floor((total + 1) / 2)) + at(F.floor(total / 2) + 1)) / 2
        mean = F.floor(F.sum(F.when(here, F.col("length") * F.col("c")).otherwise(0)) / F.nullif(n, F.lit(0)))
        return [mean.alias(f"{side}_mean"), median.alias(f"{side}_median"), at(F.floor(total * 0.9) + 1).alias(f"{side}_p90")]

    share = lambda x: F.sum(F.when(F.col("side") == "source", F.col(x))) / F.nullif(n, F.lit(0))
    return by.agg(F.coalesce(n, F.lit(0)).alias("n"), *(share(x).alias(x) for x in flags), *lengths("source"), *lengths("edited"))


def boundary_shares(pairs: DataFrame, compare: DataFrame) -> DataFrame:
    """(side, n, with_boundary, share) of both tables: rows whose source or edited text holds a blank line; null counts
    as empty. `compare` is the contrast, such as hunk pairs against section pairs."""
    blank = F.contains(F.coalesce("source_text", F.lit("")), F.lit("\n\n")) | F.contains(F.coalesce("edited_text", F.lit("")), F.lit("\n\n"))
    rows = [df.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("with_boundary")).select(F.lit(name).alias("side"), "*") for name, df in (("pairs", pairs), ("compare", compare))]
    return rows[0].union(rows[1]).withColumn("share", F.col("with_boundary") / F.nullif("n", F.lit(0)))


def edit_merges(commits: DataFrame, prefix: str = "edit/") -> DataFrame:
    """Commits of two parents whose subject names a branch under the prefix."""
    df = commits.where(F.size("parents") == 2).withColumn("branch", T.branch_of_subject("subject"))
    return df.where(F.startswith("branch", F.lit(prefix))).withColumn("base", T.base_of_branch("branch", prefix))


def edit_branches(branches: DataFrame, prefix: str = "edit/") -> DataFrame:
    name = F.regexp_replace("branch", r"\Aorigin/", "")
    return branches.select("project_id", name.alias("branch")).where(F.startswith("branch", F.lit(prefix))).distinct()


def resolve_refs(pairs: DataFrame, branches: DataFrame) -> DataFrame:
    """For each wanted (project_id, ref) the branch that exists: the name itself, else its origin/ form, else null."""
    known = branches.select("project_id", F.col("branch").alias("name")).distinct()
    own = known.select("project_id", F.col("name").alias("ref"), F.lit(True).alias("_own"))
    remote = known.where("name LIKE 'origin/%'").select("project_id", F.substring("name", 8, 1 << 30).alias("ref"), F.lit(True).alias("_remote"))
    df = pairs.join(own, ["project_id", "ref"], "left").join(remote, ["project_id", "ref"], "left")
    return df.withColumn("resolved", F.when(F.col("_own"), F.col("ref")).when(F.col("_remote"), F.concat(F.lit("origin/"), "ref"))).drop("_own", "_remote")


def manifest_pairs(manifest: DataFrame) -> DataFrame:
    return manifest.select("project_id", F.explode("branch_pairs").alias("p")).select("project_id", "p.base", "p.edit")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
