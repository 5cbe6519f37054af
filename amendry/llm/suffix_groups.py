"""Suffix-array dedup, in bytes, with the suffix array built by linear grouping.

Method. Suffixes start in groups by their first symbol. Groups are processed in descending order; each suffix of the
group points to the nearest suffix before it that is in a smaller group, and the suffixes pointed to move, by how many
pointers they got, to new groups right above their own. In the end a group holds the suffixes that share a longest
Lyndon prefix, and one ascending pass along the pointers puts each group's suffixes in order. Nothing is renamed and
nothing recurs. (The members of a group are put in text order by Python's sort, so time is n log n here, not n.)

`windows` routes every segment of every document to its seed; whole segments that are equal count once, with their
least document. Of the others, pieces that share a core of 45 bytes or more are one text here, and neighbours in its
suffix array with 50 equal bytes are the repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .windows import Windows, cut_documents

BYTES = Windows("bytes", 50, 16, 6)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a row of integers, in order; an end sorts before every symbol."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    for at, i in enumerate(order):
        place[i] = at
        group[i] = at if not at or text[order[at - 1]] != text[i] else group[order[at - 1]]
        size[group[i]] += 1
    before = [-1] * n
    top = n
    while top:
        low = group[order[top - 1]]
        votes: dict[int, int] = {}
        for i in sorted(order[low:top]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                votes[j] = votes.get(j, 0) + 1
        by_votes: dict[int, list[int]] = {}
        for j, v in votes.items():
            by_votes.setdefault(v, []).append(j)
        for v in sorted(by_votes, reverse=True):
            moved: dict[int, int] = {}
            for j in by_votes[v]:
                g = group[j]
                moved[g] = moved.get(g, 0) + 1
                to, other = g + size[g] - moved[g], 0
                other, order[to], order[place[j]] = order[to], j, order[to]
                place[other], place[j] = place[j], to
            for g, m in moved.items():
                size[g] -= m
                new = g + size[g]
                size[new] = m
                for at in range(new, new + m):
                    group[order[at]] = new
        top = low
    out, free, done = [0] * n, list(range(n)), [False] * n
    for at in range(-1, n):
        j = n - 1 if at < 0 else out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out


def repeats(segments: list[tuple[int, bytes]], size: int) -> list[tuple[int, int, int]]:
    """Windows of each segment that a segment of a smaller document holds: (segment, start, length), runs joined."""
    return _repeats([(doc, list(data)) for doc, data in segments], size)


def _repeats(segments: list[tuple[int, list[int]]], size: int) -> list[tuple[int, int, int]]:
    m = len(segments)
    text: list[int] = []
    owner: list[int] = []
    base: list[int] = []
    for i, (_, data) in enumerate(segments):
        base.append(len(text))
        text += [x + m for x in data]
        text.append(i)  # a symbol of its own ends each segment
        owner += [i] * (len(data) + 1)
    found: list[list[int]] = [[] for _ in range(m)]
    equal: list[tuple[int, int]] = []
    last = None

    def close() -> None:
        if len(equal) > 1:
            least = min(segments[i][0] for i, _ in equal)
            for i, start in equal:
                if segments[i][0] > least:
                    found[i].append(start)

    for at in suffix_array(text):
        i = owner[at]
        start = at - base[i]
        if start + size > len(segments[i][1]):
            continue
        window = text[at : at + size]
        if window != last:
            close()
            equal, last = [], window
        equal.append((i, start))
    close()
    out = []
    for i, starts in enumerate(found):
        starts.sort()
        run = None
        for s in starts:
            if run is not None and s == run[0] + run[1]:
                run[1] += 1
                continue
            if run:
                out.append((i, run[0], run[1] + size - 1))
            run = [s, 1]
        if run:
            out.append((i, run[0], run[1] + size - 1))
    return out


_CORE = 256  # stands for the bytes that all pieces of a group share


def repeats_by_core(pieces: list[tuple[int, bytes, int, int]], size: int) -> list[tuple[int, int, int]]:
    """As `repeats`, for pieces (document, bytes, first byte and number of bytes of the core), in order of documents.

    Equal pieces count once, with their least document; different pieces with equal cores are one text for the suffix
    array, in which the core is a single symbol: every window of a piece holds it.
    """
    out: list[tuple[int, int, int]] = []
    groups: dict[bytes, dict[bytes, list[int]]] = {}
    for i, (doc, piece, at, length) in enumerate(pieces):
        holders = groups.setdefault(piece[at : at + length], {}).setdefault(piece, [])
        if holders and pieces[holders[0]][0] < doc:
            out.append((i, 0, len(piece)))
        else:  # new, or held twice by one document
            holders.append(i)
    for core, group in groups.items():
        if len(group) < 2:
            continue
        own, short = list(group.values()), []
        for holders in own:
            doc, piece, at, length = pieces[holders[0]]
            short.append((doc, [*piece[:at], _CORE, *piece[at + length :]]))
        for j, start, length in _repeats(short, size - len(core) + 1):
            out += [(i, start, length + len(core) - 1) for i in own[j]]
    return out


def remove_repeated_bytes(docs: DataFrame, windows: Windows = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each document.

    A byte goes when a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Null texts
    are empty. Rows come back one for one; rows that share a doc_id don't cover each other, and each loses what its own
    text repeats; rows without one keep everything. A cut may fall inside a character: digests are those of bytes.
    Long texts are worked through in parts.
    """
    return cut_documents(docs, windows, repeats_by_core, keep=False).withColumnRenamed("n_units", "n_bytes")
