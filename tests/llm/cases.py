"""Documents that hold the odd cases, and plain versions of the contracts."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, key long"


def documents(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, repeats, null and empty texts, other scripts, and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢🎉") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["The", "of", "a"] * 40
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts: list[str | None] = [None, "", " \n\t ", "x", "one two three four five", base, base, base]
    for _ in range(20):
        words = base.split()
        words[rng.randrange(len(words))] = "EDIT%d" % rng.randrange(99)
        texts.append(" ".join(words))
    texts += [prose(rng.randint(0, 40)) + "\n" + passage + "\n" + prose(rng.randint(0, 40)) for _ in range(15)]
    texts += [prose(rng.randint(5, 80)) for _ in range(40)]
    texts += ["ab " * 200, "aaaa" * 100, passage + " " + passage, prose(6000), "\x1c\x1f\x85​　 é", base.upper(), "line\nline\nline\n other"]
    rng.shuffle(texts)
    rows = [(i * 7 % 1000, t, "en", f"src{i % 3}", len(t or ""), -1, -1) for i, t in enumerate(texts)]
    return [*rows, (5000, base, None, None, None, 0, 0), (None, passage, "en", "src0", 1, 0, 0)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def by_id(df) -> dict:
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}
