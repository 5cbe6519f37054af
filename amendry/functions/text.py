"""Text functions as Column expressions; no Python runs per row.

White space is Unicode's (`(?U)\\s`), lengths are in code points, and "strip" removes all white space of an end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marks that results depend on.
TARGET_SCRIPT = r"[぀-ヿ一-鿿]"
ENGLISH_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
USABLE_CHARACTER = r"[぀-ヿ一-鿿A-Za-z0-9]"
RULE_LINE = r"\A[=\-~^`_*:#.\s]+\z"
DIRECTIVE_LINE = r"\A\.\.\s+\S+"
PLACEHOLDER = r"(要確認|原著者に確認|著者に確認|真意を.*確認|念の為.*確認|と思われるが|確認する必要|確認が必要)"
AUTHOR_DATE = r"\A[A-Z][A-Za-z .'\-]+,\s+[A-Z][A-Za-z]+\s+\d{4}\z"
NUMBER_CITATION = r"\[\d+\]"
BIBLIOGRAPHY_KEY = r"\[@(?:book|article|inproceedings|misc):[^\]]+\]"
REFERENCE_MARK = "\n\n[参照]\n"
BAD_MARKERS = ("```", "~~~", "|--", "af://", "★", "<!--", "TODO", "FIXME")
DEFAULT_PROMPT = (
    "次の日本語テキストを、意味保持を最優先に技術文書として推敲してください。"
    "\n修正前にない含意を追加せず、段落内の主題連鎖を意識してください。"
)

#: Characters of Unicode's White_Space, which `(?U)\s` stands for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_LINE_END = r"\r\n|[\n\r\u000B\f\u001C\u001D\u001E\u0085  ]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(t: Column | str) -> Column:
    return F.btrim(_c(t), F.lit(WHITE))


def rstrip(t: Column | str) -> Column:
    return F.rtrim(_c(t), F.lit(WHITE))


def split_lines(t: Column | str) -> Column:
    """Lines at any line end; a final end opens no line, and an empty text has none."""
    # Inside one lambda the text is split once; as a plain expression it would be split wherever `parts` is read.
    own = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.get(F.transform(F.array(F.split(_c(t), _LINE_END)), own), F.lit(0))


def trim_ends(t: Column | str) -> Column:
    """Without the line feeds at both ends."""
    return F.btrim(_c(t), F.lit("\n"))


def normalize(t: Column | str) -> Column:
    return F.regexp_replace(_c(t), r"(?U)\s+", "")


def slug(t: Column | str) -> Column:
    """Runs of other characters become one dash; outer dashes go; nothing left is x."""
    dashed = F.regexp_replace(F.regexp_replace(_c(t), r"[^A-Za-z0-9._-]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("x"))


def clean_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, rstrip), lambda x: x != "")


def strip_reference(t: Column | str, both: bool = True) -> Column:
    """Text before the reference block, stripped at both ends or only the right one."""
    before = F.substring_index(_c(t), REFERENCE_MARK, 1)
    return strip(before) if both else rstrip(before)


def english_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(ENGLISH_WORD))


def has_language(t: Column | str, script: str = TARGET_SCRIPT) -> Column:
    return plain_has_language(strip_reference(t), script)


def plain_has_language(plain: Column, script: str) -> Column:
    """Of a text without its reference block."""
    return plain.rlike(script) | (english_words(plain) >= 4)


def filled_lines(plain: Column) -> Column:
    """Stripped lines that aren't empty, of a text without its reference block."""
    return F.filter(F.transform(split_lines(plain), strip), lambda x: x != "")


def is_directive_only(t: Column | str) -> Column:
    return lines_are_directives(filled_lines(strip_reference(t)))


def lines_are_directives(lines: Column) -> Column:
    return F.forall(lines, lambda x: x.rlike(RULE_LINE) | x.rlike(DIRECTIVE_LINE))


def is_short_fragment(t: Column | str, script: str = TARGET_SCRIPT) -> Column:
    return lines_are_fragment(filled_lines(strip_reference(t)), script)


def lines_are_fragment(lines: Column, script: str) -> Column:
    line = F.element_at(lines, 1)
    foreign, size = ~line.rlike(script), F.length(normalize(line))
    short = line.rlike(AUTHOR_DATE) | (line.rlike(r"\A[-*]") & foreign) | (foreign & (english_words(line) <= 3) & (size < 40)) | (size < 12)
    return F.when(F.size(lines) == 1, short).otherwise(False)


def strip_markup(t: Column | str) -> Column:
    return normalize(F.regexp_replace(F.regexp_replace(strip_reference(t), NUMBER_CITATION, ""), BIBLIOGRAPHY_KEY, ""))


def is_citation_only(a: Column | str, b: Column | str) -> Column:
    return (normalize(a) != normalize(b)) & (strip_markup(a) == strip_markup(b))


def bad_length_ratio(inp: Column | str, *texts: Column | str, low: float = 0.15, high: float = 6.0) -> Column:
    size = lambda x: F.greatest(F.length(x), F.lit(1))
    base = size(normalize(strip_reference(inp)))
    ratios = [size(normalize(t)) / base for t in texts]
    return reduce(lambda a, b: a | b, [(r > high) | (r < low) for r in ratios])


def paragraph_count(t: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(t), "\n\n"), lambda x: strip(x) != ""))


def line_count(t: Column | str) -> Column:
    return F.size(F.filter(split_lines(t), lambda x: strip(x) != ""))


def preview(t: Column | str, most: int = 120) -> Column:
    flat = strip(F.regexp_replace(_c(t), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def flat_preview(t: Column | str, most: int = 120) -> Column:
    return F.substring(F.replace(_c(t), F.lit("\n"), F.lit(" ")), 1, most)


def normalize_heading(t: Column | str) -> Column:
    return strip(F.regexp_replace(_c(t), r"(?U)\s*\{#[^}]*\}\s*\z", ""))


def heading_and_body(t: Column | str) -> tuple[Column, Column]:
    """The first line if it is a heading, else nothing; and the rest without line ends around it."""
    first = F.get(F.split(_c(t), _LINE_END, 2), F.lit(0))
    is_heading = F.coalesce(first.rlike(r"\A#{1,6}\s"), F.lit(False))
    rest = F.coalesce(F.get(F.split(_c(t), _LINE_END, 2), F.lit(1)), F.lit(""))
    body = F.when(is_heading, F.regexp_replace(rest, _LINE_END, "\n")).otherwise(_c(t))
    return F.when(is_heading, first).otherwise(""), trim_ends(body)


def paragraphs(body: Column) -> Column:
    filled = F.filter(F.split(body, "\n\n"), lambda p: strip(p) != "")
    return F.transform(filled, trim_ends)


def with_heading(heading: Column, body: Column) -> Column:
    text = F.concat(trim_ends(body), F.lit("\n"))
    return F.when(heading == "", text).otherwise(F.concat(heading, F.lit("\n\n"), text))


def degrade_join(t: Column | str) -> Column:
    heading, body = heading_and_body(t)
    return with_heading(heading, F.array_join(paragraphs(body), "\n"))


def degrade_split(t: Column | str) -> Column:
    heading, body = heading_and_body(t)
    return with_heading(heading, F.array_join(F.filter(split_lines(body), lambda x: strip(x) != ""), "\n\n"))


def degrade_reverse(t: Column | str) -> Column:
    heading, body = heading_and_body(t)
    return with_heading(heading, F.array_join(F.reverse(paragraphs(body)), "\n\n"))


def window(heading: Column, parts: Column, start: Column, n: int) -> Column:
    return with_heading(heading, F.array_join(F.slice(parts, start + 1, n), "\n\n"))


def has_markers(t: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_c(t), F.lit(m)) for m in BAD_MARKERS])


def strip_thinking(t: Column | str) -> Column:
    """Closed think blocks, then an open one to the end, then stray tags."""
    text = F.regexp_replace(F.regexp_replace(_c(t), r"(?is)<think>.*?</think>\s*", ""), r"(?is)<think>.*\z", "")
    return strip(F.replace(F.replace(text, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit("")))


def _up_to(t: Column, pattern: str) -> Column:
    """Text before the first match, stripped; the text itself where nothing matches."""
    return F.when(t.rlike(pattern), strip(F.split(t, pattern, 2)[0])).otherwise(t)


def strip_meta_revision(t: Column | str) -> Column:
    """Lead-ins before a revision, rules and explanations after it, in this order."""
    # The patterns and their order.
    text = strip(t)
    marked = r"(?s)\A.*?\*\*推敲後[^*]*\*\*[：:]*(?U)\s*\n+(.*)\z"
    text = F.when(text.rlike(marked), strip(F.regexp_extract(text, marked, 1))).otherwise(text)
    ruled, gap = F.split(text, r"\n---\n+", 2), F.split(text, r"(?U)\n\s*\n", 2)
    lead = F.when(F.size(ruled) == 2, strip(ruled[1])).when(F.size(gap) == 2, strip(gap[1])).otherwise(text)
    text = F.when(text.rlike(r"\A以下は[^\n]{0,200}推敲"), lead).otherwise(text)
    for pattern in (
        r"(?U)\n---\s*\n+(?:##?#?\s*)?(?:説明|解説|根拠|変更点|推敲の根拠)",
        r"\n\*\*(?:説明|解説|根拠|変更点|推敲の根拠)[^*]*\*\*",
        r"(?U)\n(?:##?#?\s*)?(?:説明|解説|根拠|変更点)[：:]",
    ):
        text = _up_to(text, pattern)
    for pattern in (r"(?U)\A\*\*推敲後[^*]*\*\*[：:]*\s*\n*", r"(?U)\A推敲後の(?:文|本文)[：:]\s*\n*", r"(?U)(?:\n\s*)?---\s*\z"):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def clean_generation(t: Column | str) -> Column:
    return strip_meta_revision(strip_thinking(t))


def input_text(source: Column, reference: Column) -> Column:
    return F.when(F.coalesce(reference, F.lit("")) == "", source).otherwise(F.concat(source, F.lit(REFERENCE_MARK), reference))


def rejected_text(mode: str, source: Column, edited: Column) -> Column:
    """The source, or a slightly worse copy of the edit where that differs from it."""
    if mode == "source":
        return source
    weak = F.replace(F.replace(edited, F.lit("。"), F.lit("。 ")), F.lit("，"), F.lit("、"))
    return F.when(weak == edited, source).otherwise(weak)


def content_id(*prefix: Column, source: Column, edited: Column) -> Column:
    """First 12 digits of the SHA-256 of both texts, after the slugs of what they come from."""
    digest = F.substring(F.sha2(F.concat(source, F.lit("\n---\n"), edited), 256), 1, 12)
    return F.concat_ws("-", *(slug(p) for p in prefix), digest)


def bucket(key: Column | str) -> Column:
    """A number from 0 to 1 from the first 12 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(_c(key), 256), 1, 12), 16, 10).cast("double") / float(16**12 - 1)


def choose_split(score: Column, train: float = 0.8, valid: float = 0.1) -> Column:
    if train <= 0 or valid <= 0 or train + valid >= 1:
        raise ValueError("train and valid must be positive and leave a rest")
    return F.when(score < train, "train").when(score < train + valid, "valid").otherwise("test")


def verdict(margin: Column | str, uncertain: float = 0.12, reject: float = 0.25) -> Column:
    m = _c(margin)
    return F.when(m >= uncertain, "preferred_edit").when(m <= -reject, "reject_edit").when(m <= -uncertain, "preferred_base").otherwise("uncertain")


def branch_of_subject(t: Column | str) -> Column:
    """The edit branch that a merge commit's subject names, or null."""
    pull = F.regexp_extract(_c(t), r"Merge pull request #\d+ from [^ ]*?(edit/[^\s']+)", 1)
    local = F.regexp_extract(_c(t), r"Merge branch '(edit/[^']+)'", 1)
    return F.coalesce(F.nullif(pull, F.lit("")), F.nullif(local, F.lit("")))


def base_of_branch(t: Column | str, prefix: str = "edit/") -> Column:
    return F.when(F.startswith(_c(t), F.lit(prefix)), F.substring(_c(t), len(prefix) + 1, 1 << 30)).otherwise(_c(t))


def length_ratio(revised: Column, draft: Column) -> Column:
    return F.length(revised) / F.greatest(F.length(draft), F.lit(1))


def project_id_of(repo_name: Column | str, explicit: Column | str | None = None) -> Column:
    """The given id, or else the slug of the repository's name."""
    named = slug(repo_name)
    return named if explicit is None else F.coalesce(F.nullif(_c(explicit), F.lit("")), named)


def source_reference(path: Column, base: Column, edit: Column, base_commit: Column, edit_commit: Column, section: Column | None = None) -> Column:
    """path:base@commit->edit@commit with 8 digits of each commit; of sections with their mark and key."""
    side = lambda name, commit: F.concat(name, F.lit("@"), F.substring(commit, 1, 8))
    span = F.concat(side(base, base_commit), F.lit("->"), side(edit, edit_commit))
    return F.concat(path, F.lit(":"), span) if section is None else F.concat(path, F.lit(":section:"), span, F.lit(":"), section)


def project_of(t: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(t), F.lit("")), F.lit("(unknown)"))


def usable_pair(source: Column | str, edited: Column | str, most: int = 1800) -> Column:
    s, e = _c(source), _c(edited)
    return (s != "") & (e != "") & (F.length(s) <= most) & (F.length(e) <= most) & F.concat(s, e).rlike(USABLE_CHARACTER)


def usable_section(source: Column | str, edited: Column | str, most: int = 12000) -> Column:
    s, e = strip(source), strip(edited)
    return usable_pair(s, e, most) & (s != e)
