"""DuckDB expressions that equal the text functions, for the oracle queries."""

from __future__ import annotations

SPACE = r"[\s\x{3000}\x{00A0}]"
SCRIPT = "[A-Za-zÀ-ÿ]"
WORD = "[A-Za-z]+(?:''[A-Za-z]+)?"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rstrip(t: str) -> str:
    return f"regexp_replace({t}, '{SPACE}+$', '', 'g')"


def normalize(t: str) -> str:
    return f"regexp_replace({t}, '{SPACE}+', '', 'g')"


def slug(t: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({t}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"


def before_reference(t: str) -> str:
    return strip(f"string_split({t}, chr(10) || chr(10) || '[参照]' || chr(10))[1]")


def filled_lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({before_reference(t)}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{WORD}'))"


def directive_only(t: str) -> str:
    return f"(len(list_filter({filled_lines(t)}, lambda l: NOT (regexp_full_match(l, '[=\\-~^`_*:#.\\s]+') OR regexp_matches(l, '^\\.\\.\\s+\\S+')))) = 0)"


def short_fragment(t: str) -> str:
    line = f"{filled_lines(t)}[1]"
    foreign, size = f"NOT regexp_matches({line}, '{SCRIPT}')", f"length({normalize(line)})"
    author = f"regexp_full_match({line}, '[A-Z][A-Za-z .''\\-]+,\\s+[A-Z][A-Za-z]+\\s+\\d{{4}}')"
    return f"(CASE WHEN len({filled_lines(t)}) = 1 THEN {author} OR (left({line}, 1) IN ('-', '*') AND {foreign}) OR ({foreign} AND {words(line)} <= 3 AND {size} < 40) OR {size} < 12 ELSE false END)"


def has_language(t: str) -> str:
    return f"(regexp_matches({before_reference(t)}, '{SCRIPT}') OR {words(before_reference(t))} >= 4)"


def usable(s: str, e: str, most: int) -> str:
    return f"({s} <> '' AND {e} <> '' AND length({s}) <= {most} AND length({e}) <= {most} AND regexp_matches({s} || {e}, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9]'))"


def markup_free(t: str) -> str:
    return normalize(f"regexp_replace(regexp_replace({before_reference(t)}, '\\[\\d+\\]', '', 'g'), '\\[@(?:book|article|inproceedings|misc):[^\\]]+\\]', '', 'g')")


def citation_only(a: str, b: str) -> str:
    return f"({normalize(a)} <> {normalize(b)} AND {markup_free(a)} = {markup_free(b)})"


#: Text of a generation in one line, without marks that cleaning looks for.
LINES = "regexp_replace(generated, '[\\n#*-]+', ' ', 'g')"


def reject_reason(citations: bool = False) -> str:
    three = ("input", "chosen", "rejected")
    some = lambda f: "(" + " OR ".join(f(t) for t in three) + ")"
    blob = "concat_ws(chr(10), input, chosen, rejected, source_reference)"
    ratio = lambda t: f"(greatest(length({normalize(t)}), 1) / greatest(length({normalize(before_reference('input'))}), 1)::DOUBLE)"
    return f"""CASE
  WHEN {some(lambda t: f"length({strip(t)}) NOT BETWEEN 5 AND 2500")} THEN 'bad_length'
  WHEN {normalize('chosen')} = {normalize('rejected')} THEN 'same_choice'
  WHEN {citation_only('chosen', 'rejected') if citations else 'false'} THEN 'citation_or_bib_only'
  WHEN regexp_matches({blob}, 'zz9') THEN 'user_exclude_pattern'
  WHEN regexp_matches({blob}, '(要確認|原著者に確認|著者に確認|真意を.*確認|念の為.*確認|と思われるが|確認する必要|確認が必要)') THEN 'placeholder_note'
  WHEN {some(directive_only)} THEN 'directive_only'
  WHEN {some(short_fragment)} THEN 'short_fragment'
  WHEN NOT regexp_matches(chosen, '{SCRIPT}') AND NOT regexp_matches(rejected, '{SCRIPT}') THEN 'no_japanese_target'
  WHEN {some(lambda t: f"NOT {has_language(t)}")} THEN 'non_paragraph'
  WHEN {' OR '.join(f"{ratio(t)} > 6.0 OR {ratio(t)} < 0.15" for t in ("chosen", "rejected"))} THEN 'bad_length_ratio' END"""


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def zipped(a: str, b: str, body: str) -> str:
    """Of x and y, the items of both lists."""
    items = body.replace("x", f"{a}[i]").replace("y", f"{b}[i]")
    return f"list_transform(range(1, len({a}) + 1), lambda i: {items})"


def minus(a: str, b: str) -> str:
    return zipped(a, b, "x - y")


def pointwise(s: str, c: str, ls: str, lc: str) -> str:
    diff = minus(s, c)
    return f"list_concat({s}, {c}, {diff}, list_transform({diff}, lambda z: abs(z)), [{dot(s, c)}, {ls}, {lc}, {lc} - {ls}, abs({lc} - {ls})])"


def preference(s: str, a: str, b: str, ls: str, la: str, lb: str) -> str:
    ab, sa, sb = minus(a, b), minus(s, a), minus(s, b)
    positive = lambda v: f"list_transform({v}, lambda z: abs(z))"
    numbers = f"[{dot(s, a)}, {dot(s, b)}, {dot(a, b)}, {dot(s, a)} - {dot(s, b)}, {ls}, {la}, {lb}, {la} - {lb}, abs({la} - {lb})]"
    return f"list_concat({s}, {a}, {b}, {ab}, {positive(ab)}, {sa}, {sb}, {positive(sa)}, {positive(sb)}, {numbers})"


def weights(n: int) -> str:
    return f"list_transform(range({n}), lambda k: sin(k) / 10)"
