import re
from collections import Counter

from amendry.llm.quality_rules import line_frequency_rules

from .cases import SCHEMA, by_id, documents, words


def plain_base(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    repeated = set()
    for i in range(len(own) - 4):
        if windows[tuple(own[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_counts_and_verdicts_match_brute_force(spark):
    rows = documents()
    rows += [(2000 + i, f"shared header of the site here\nSHARED  footer of the site\nown words {i} " + "and more words " * (i % 3), "en", "hot", 1, 0, 0) for i in range(12)]
    found = by_id(line_frequency_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), max_docs=8, min_left=0.6))
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    lines = {id(r): [norm(x) for x in (r[1] or "").split("\n") if norm(x)] for r in rows}
    docs_with = Counter((h, x) for h, x, _ in {(r[3] or "", x, r[0]) for r in rows for x in lines[id(r)] if r[0] is not None})
    for r in rows:
        if r[0] is None:
            continue
        base = plain_base(r[1])
        got = found[r[0]]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base, r[0]
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        removed = sum(len(x.split(" ")) for x in lines[id(r)] if docs_with[r[3] or "", x] > 8)
        assert got.base_failed == failed
        assert got.kept == (not failed and base[0] - removed >= 0.6 * base[0])
    assert any(not r.kept and not r.base_failed for r in found.values())
    assert line_frequency_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows(spark):
    """Rows of one id are one document in the counts; each loses the lines of its own text, and equal rows lose the same."""
    common = "one common line of many words in every document here"
    rows = [(1, f"{common}\n{common}\nown words {i}" + " more" * 20, "s") for i in range(60)]
    kept = line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(kept) == 60 and all(r.n_removed_words == 0 for r in kept)
    rows += [(i, common, "s") for i in range(2, 60)] + [rows[0], rows[0], (1, "a different text " * 5, "s")]
    found = line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").collect()
    assert sorted((r.n_removed_words, r.n_removed_lines) for r in found) == [(0, 0)] + [(20, 2)] * 62
