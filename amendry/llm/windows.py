"""Windows that an earlier document also holds: routing of segments to where their equals meet.

A window is `size` neighbouring units (words or bytes) of one text. Each window has a seed, its least k-gram by hash;
neighbouring windows with one seed form a run, and the text of a run is a segment. Equal windows have equal seeds
wherever they stand, so they meet at the seed. Steps, of which only the first moves whole texts:

1. The documents are written once, in buckets by doc_id; all later joins go to these buckets.
2. `routed`: every task sends (seed, segment, flanks, document) as a few packed bytes to the seed's owner, equal
   segments of the task once, and gets back which of its segments an earlier document holds whole ("known") and
   which share their seed and a flank with a different segment. The flanks are the seed with the `side` units
   before or after it; a window with this seed holds one of them, so segments that share neither share no window.
   A segment that shares a flank with another one of its own task is told so at once, and of those of one flank
   the first one alone is sent: a seed that very many segments have costs a few entries a task.
3. `found`: segments that share a flank are split by longer seeds. The windows of `step` neighbouring places of the
   seed form a piece; all of them hold the piece's core, which is a seed of size - step + 1 units. Equal pieces of a
   task leave once, from their least document. Pieces with equal cores meet in one group, and a `matcher` (Lempel-Ziv
   factors, or a suffix array) finds what later documents repeat. What differs in a group are at most step - 1 units
   on either side of the core, so that groups stay small for a passage in any number of documents.
4. `cut`: the spans go to the documents' buckets, and covered units are cut.

Equal whole segments are told by 96 bits of hashes (seed and text) and count once, with their least document; all that
overlaps in part is decided by the matcher on texts. There is one path at every size, without a limit on groups.
Long texts are worked through in parts of `_SLICE` bytes that overlap by a window.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import beside, partitions, shared_folder, written
from .textarrays import RollingHash, Runs, covered, minimiser_runs, mix, slices, text_bytes, word_bytes, word_grams, words_of

#: Entries and pieces that a task holds before it sends them; bytes of text worked on at once; and bytes of text for
#: each bucket, whose entries one task holds.
_ENTRIES, _PIECES, _SLICE, _BUCKET_BYTES = 600_000, 200_000, 1_000_000, 32 << 20
_SEED = np.uint64((1 << 32) - 1)
_MOST_BUCKETS = 100_000  # of a table, by Spark's own setting; what is routed may have more

#: Takes the pieces of one core as (document, bytes, first byte of the core, bytes of the core) in order of documents,
#: and the window; gives (index, first unit, units).
Matcher = Callable[[list[tuple[int, bytes, int, int]], int], list[tuple[int, int, int]]]


@dataclass(frozen=True)
class Windows:
    """size, k and step in units; kind "words" or "bytes"."""

    kind: str
    size: int
    k: int
    step: int

    @property
    def side(self) -> int:
        return -(-(self.size - self.k) // 2)


@dataclass
class Units:
    """Units of several texts and their runs."""

    doc: np.ndarray
    begin: np.ndarray  # first byte of each unit in data
    end: np.ndarray
    data: np.ndarray
    first: np.ndarray  # index of each text's first unit, and the number of all
    runs: Runs
    seed: np.ndarray  # 32 bits for each run
    key: np.ndarray  # 64 bits for each run: its seed and its whole text
    flanks: np.ndarray  # twice 15 bits and a mark for each run; 0 where the run has no such flank
    rolling: RollingHash


def units_of(texts: list[bytes], windows: Windows) -> Units:
    if windows.kind == "words":
        words = words_of(texts)
        doc, begin, end, data, first = words.doc, words.start, words.end, words.data, words.first
        rolling = RollingHash(data)
        seeds = word_grams(rolling.of(begin, end), windows.k)
    else:
        data = np.frombuffer(b"".join(texts), np.uint8)
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        doc, first = np.repeat(np.arange(len(texts), dtype=np.int32), count), np.concatenate(([0], np.cumsum(count)))
        begin = np.arange(len(data))
        end = begin + 1
        rolling = RollingHash(data)
        seeds = rolling.grams(windows.k)
    runs = minimiser_runs(seeds, doc, windows.size, windows.k)
    last = runs.start + runs.length + windows.size - 2
    whole = rolling.of(begin[runs.start], end[last]) if len(runs.start) else runs.seed
    flanks = _flanks(rolling, begin, end, runs, last, windows)
    return Units(doc, begin, end, data, first, runs, mix(runs.seed) & _SEED, mix(whole + mix(runs.seed)), flanks, rolling)


def _flanks(rolling: RollingHash, begin: np.ndarray, end: np.ndarray, runs: Runs, last: np.ndarray, windows: Windows) -> np.ndarray:
    out = np.zeros((2, len(runs.at)), np.uint64)
    for row, (low, high) in zip(out, ((runs.at - windows.side, runs.at + windows.k - 1), (runs.at, runs.at + windows.k - 1 + windows.side))):
        inside = (low >= runs.start) & (high <= last)
        row[inside] = np.maximum(rolling.of(begin[low[inside]], end[high[inside]]) & np.uint64(0xFFFE), np.uint64(2))
    return out[0] << np.uint64(16) | out[1]


def _parts_of(text: bytes, kind: str, overlap: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(first unit, bytes) of parts of a long text, so that each window of overlap + 1 units lies in exactly one."""
    if kind == "bytes":
        for a in range(0, max(1, len(text) - overlap), most):
            yield a, text[a : a + most + overlap]
        return
    at = unit = 0
    while True:
        size, end = most, len(text)
        while at + size < len(text):
            ahead = text[at + size : at + size + 4096]
            blank = next((i for i, b in enumerate(ahead) if b in b" \t\n\v\f\r"), None)
            if blank is None:
                size += len(ahead)
                continue
            starts = np.flatnonzero(np.diff(word_bytes(text[at : at + size + blank]).view(np.int8), prepend=0) == 1)
            if len(starts) > overlap:
                end = at + size + blank
                break
            size *= 2
        yield unit, text[at:end]
        if end == len(text):
            return
        at, unit = at + int(starts[-overlap]), unit + len(starts) - overlap


def parts(batches: Iterator[pa.RecordBatch], windows: Windows, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """(rows, their texts, first unit of each), about `_SLICE` bytes at a time; a long text comes in several parts."""
    for batch in slices(batches, text, _SLICE):
        texts = text_bytes(batch.column(text))
        long = [i for i, t in enumerate(texts) if len(t) > 2 * _SLICE]
        if not long:
            yield batch, texts, np.zeros(len(texts), np.int64)
            continue
        short = [i for i, t in enumerate(texts) if len(t) <= 2 * _SLICE]
        if short:
            yield batch.take(pa.array(short)), [texts[i] for i in short], np.zeros(len(short), np.int64)
        for i in long:
            for unit, part in _parts_of(texts[i], windows.kind, windows.size - 1, _SLICE):
                yield batch.slice(i, 1), [part], np.array([unit])


def _packed(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_ROUTE_SCHEMA = pa.schema([("bucket", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("replies", pa.binary())])
_REPLY_SCHEMA = pa.schema([("bucket", pa.int32()), ("replies", pa.binary())])
_FLAG_SCHEMA = pa.schema([("doc", pa.int64()), ("flags", pa.binary())])
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
_KNOWN, _LEFT, _RIGHT = 1, 2, 4


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{x.name} {_DDL[x.type]}" for x in schema)


def _dealt(bucket: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, then by document (neighbouring ids compress well), and where each bucket begins."""
    by_doc = np.argsort(doc)
    small = np.uint16 if buckets < 1 << 16 else np.int64
    order = by_doc[np.argsort(bucket[by_doc].astype(small), kind="stable")]
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def _replies(doc: np.ndarray, key: np.ndarray, flag: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Flagged keys, packed for the owners of their documents."""
    bucket = doc % buckets
    order, cuts = _dealt(bucket, doc, buckets)
    doc, key, flag = doc[order].view(np.uint64), key[order], flag[order].astype(np.uint64)
    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return full, [_packed(doc[a:z], 8) + _packed(key[a:z], 8) + _packed(flag[a:z], 1) for a, z in ((cuts[b], cuts[b + 1]) for b in full)]


@dataclass
class Segments:
    """Distinct segments in order of their seeds, and the entries of later documents that hold one."""

    seed: np.ndarray
    key: np.ndarray
    doc: np.ndarray  # the least
    flanks: np.ndarray
    number: np.ndarray  # of the seed
    later: tuple[np.ndarray, np.ndarray]  # documents and keys

    @classmethod
    def of(cls, seed: np.ndarray, key: np.ndarray, doc: np.ndarray, flanks: np.ndarray) -> "Segments":
        # Should two segments of a seed agree in half of their bits, they may come apart here; their pieces meet again.
        order = np.argsort(seed << np.uint64(32) | (key & _SEED))
        seed, key, doc, flanks = seed[order], key[order], doc[order], flanks[order]
        if not len(seed):
            return cls(seed, key, doc, flanks, np.zeros(0, np.int64), (doc, key))
        start = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (key[1:] != key[:-1]))))
        least = np.minimum.reduceat(doc, start)
        later = doc > np.repeat(least, np.diff(np.append(start, len(doc))))
        own = seed[start]
        number = np.cumsum(np.concatenate(([True], own[1:] != own[:-1]))) - 1
        return cls(own, key[start], least, np.bitwise_or.reduceat(flanks, start), number, (doc[later], key[later]))

    def sharing(self) -> tuple[np.ndarray, np.ndarray]:
        """Which flanks (_LEFT, _RIGHT) each shares with a different segment, and whether it is the first of either.

        A flank with a mark was shared in the task that sent it.
        """
        flag, first = np.zeros(len(self.number), np.uint64), np.zeros(len(self.number), bool)
        for bit, flank in ((_LEFT, self.flanks >> np.uint64(16)), (_RIGHT, self.flanks & np.uint64(0xFFFF))):
            at = np.flatnonzero(flank > 0)
            _, place, index, count = np.unique(self.number[at].astype(np.uint64) << np.uint64(16) | flank[at] >> np.uint64(1), return_index=True, return_inverse=True, return_counts=True)
            shared = (count > 1) | (np.bincount(index, weights=flank[at] & np.uint64(1), minlength=len(count)) > 0)
            flag[at] |= np.where(shared[index], np.uint64(bit), np.uint64(0))
            first[at[place]] = True
        return flag, first


def _requests(windows: Windows, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            own = Segments.of(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            flag, first = own.sharing()
            told = flag > 0
            doc, key = np.append(own.later[0], own.doc[told]), np.append(own.later[1], own.key[told])
            full, blobs = _replies(doc, key, np.append(np.full(len(own.later[0]), _KNOWN, np.uint64), flag[told]), buckets)
            none = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(blobs, pa.binary())], schema=_ROUTE_SCHEMA)
            use = ~told | first
            marks = (flag & np.uint64(_LEFT)) // np.uint64(_LEFT) << np.uint64(16) | (flag & np.uint64(_RIGHT)) // np.uint64(_RIGHT)
            seed, key, flanks, doc = own.seed[use], own.key[use], (own.flanks | marks)[use], own.doc[use]
            order, cuts = _dealt((seed % np.uint64(buckets)).astype(np.int64), doc, buckets)
            width = 4 if not len(doc) or (doc.min() >= 0 and doc.max() < 1 << 32) else 8
            seed, key, flanks, doc = seed[order], key[order], flanks[order], doc[order].view(np.uint64)
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            blobs = [_packed(seed[a:z], 4) + _packed(key[a:z], 8) + _packed(flanks[a:z], 4) + _packed(doc[a:z], width) for a, z in ((cuts[b], cuts[b + 1]) for b in full)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([width] * len(full), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(full), pa.binary())], schema=_ROUTE_SCHEMA)

        for batch, texts, _ in parts(batches, windows, "text"):
            units = units_of(texts, windows)
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            held.append((units.seed, units.key, docs[units.doc[units.runs.start]], units.flanks))
            if sum(len(x[0]) for x in held) > _ENTRIES:
                yield from sent()
        if held:
            yield from sent()

    return run


def _answers(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            told = pc.is_valid(batch.column("replies"))
            yield batch.filter(told).select([0, 3])
            asked = batch.filter(pc.invert(told))
            for width, blob in zip(asked.column("width").to_pylist(), asked.column("entries").to_pylist()):
                n = len(blob) // (16 + width)
                for part, (a, b, w) in zip(parts, ((0, 4, 4), (4, 12, 8), (16, 16 + width, width), (12, 16, 4))):
                    part.append(_unpacked(blob[n * a : n * b], w))
        if not parts[0]:
            return
        seed, key, doc, flanks = (np.concatenate(x) for x in parts)
        parts.clear()
        own = Segments.of(seed, key, doc.view(np.int64), flanks)
        flag, _ = own.sharing()
        told = flag > 0
        docs, keys = np.append(own.later[0], own.doc[told]), np.append(own.later[1], own.key[told])
        full, blobs = _replies(docs, keys, np.append(np.full(len(own.later[0]), _KNOWN, np.uint64), flag[told]), buckets)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], schema=_REPLY_SCHEMA)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its flagged keys, nine bytes each."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for blob in batch.column("replies").to_pylist():
            n = len(blob) // 17
            for part, (a, b) in zip(parts, ((0, 8), (8, 16), (16, 17))):
                part.append(_unpacked(blob[n * a : n * b], b - a))
    if not parts[0]:
        return
    doc, key, flag = (np.concatenate(x) for x in parts)
    parts.clear()
    doc = doc.view(np.int64)
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    packed = np.empty((len(doc), 9), np.uint8)
    packed[:, :8] = key[order].astype("<u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = flag[order]
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    cuts = np.append(start, len(doc)).tolist()
    ids = doc[start]
    for a in range(0, len(ids), 10_000):
        blobs = [packed[x:y].tobytes() for x, y in zip(cuts[a : a + 10_000], cuts[a + 1 :])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10_000], pa.int64()), pa.array(blobs, pa.binary())], schema=_FLAG_SCHEMA)


def routed(docs: DataFrame, windows: Windows, buckets: int) -> DataFrame:
    """(doc, flags): the flagged segments of each document of (doc, text)."""
    asked = docs.mapInArrow(_requests(windows, buckets), _ddl(_ROUTE_SCHEMA))
    told = asked.repartition(buckets, "bucket").mapInArrow(_answers(buckets), _ddl(_REPLY_SCHEMA))
    return told.repartition(buckets, "bucket").mapInArrow(_by_document, _ddl(_FLAG_SCHEMA))


def _flags_of(units: Units, owner: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """The flags of each run among those of its own document."""
    flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 9)
    of = np.repeat(np.arange(len(blobs), dtype=np.uint64), [len(x) // 9 for x in blobs])
    keys = mix(np.ascontiguousarray(flat[:, :8]).view("<u8").ravel() ^ mix(of))
    out = np.zeros(len(units.key), np.uint8)
    if len(keys):
        wanted, index = np.unique(keys, return_inverse=True)
        flags = np.zeros(len(wanted), np.uint8)
        np.bitwise_or.at(flags, index, flat[:, 8])
        own = mix(units.key ^ mix(owner.astype(np.uint64)))
        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        out = np.where(wanted[at] == own, flags[at], 0).astype(np.uint8)
    return out


_FOUND_SCHEMA = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("core", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("piece", pa.binary())])
_FOUND = ", ".join(f"{x.name} {_DDL[x.type]}" for x in _FOUND_SCHEMA)


def _joined(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts in a row, overlapping ones joined; both bounds ascend in a text."""
    if not len(start):
        return doc, row, start, end
    new = np.flatnonzero(np.concatenate(([True], (start[1:] > end[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))))
    return doc[new], row[new], start[new], end[np.append(new[1:], len(start)) - 1]


def _spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows without a piece, spread by their documents."""
    n, spread = len(doc), mix(np.asarray(doc, np.int64).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, row, start, length, spread)] + [pa.nulls(n, x.type) for x in list(_FOUND_SCHEMA)[5:]], schema=_FOUND_SCHEMA)


def _found(windows: Windows) -> Callable:
    """Spans of known segments, and pieces of those that share a flank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[tuple[int, int, int, int, int, int]]] = {}
        number = 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows, later = [], []
            for (core, piece), holders in held.items():
                least = min(x[0] for x in holders)
                for doc, row, start, units, at, size in holders:
                    if doc > least:
                        later.append((doc, row, start, units))
                    else:
                        rows.append((doc, row, start, units, core, at, size, piece))
            held.clear()
            if later:
                yield _spans(*np.array(later, np.int64).T)
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 20_000]), _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)

        for batch, texts, offset in parts(batches, windows, "text"):
            units = units_of(texts, windows)
            runs = units.runs
            owner = units.doc[runs.start]
            flags = _flags_of(units, owner, batch.column("flags").to_pylist())
            docs, rows = (batch.column(x).to_numpy(zero_copy_only=False)[owner] for x in ("doc", "row"))
            shift = (offset - units.first[:-1])[owner] if len(owner) else owner  # from places in the batch to units of the text
            known = (flags & _KNOWN) > 0
            doc, row, start, end = _joined(docs[known], rows[known], (runs.start + shift)[known], (runs.start + shift + runs.length)[known] + windows.size - 1)
            yield _spans(doc, row, start, end - start)
            data = units.data.tobytes()
            for low in range(0, windows.size - windows.k + 1, windows.step):
                high = min(low + windows.step, windows.size - windows.k + 1) - 1
                wanted = (_LEFT if low >= windows.side else 0) | (_RIGHT if high <= windows.size - windows.k - windows.side else 0) or _LEFT | _RIGHT
                first, last = np.maximum(runs.start, runs.at - high), np.minimum(runs.start + runs.length - 1, runs.at - low)  # windows
                i = np.flatnonzero(~known & ((flags & wanted) > 0) & (first <= last))
                if not len(i):
                    continue
                first, last = first[i], last[i]
                begin, stop = units.begin[first], units.end[last + windows.size - 1]
                core_begin, core_stop = units.begin[runs.at[i] - low], units.end[runs.at[i] - high + windows.size - 1]
                core = mix(units.rolling.of(core_begin, core_stop) + np.uint64(low)).view(np.int64)
                columns = (core, begin, stop, docs[i], rows[i], first + shift[i], last - first + windows.size, core_begin - begin, core_stop - core_begin)
                for c, a, z, *holder in zip(*(x.tolist() for x in columns)):
                    held.setdefault((c, data[a:z]), []).append(tuple(holder))
                number += len(i)
            if number > _PIECES:
                yield from sent()
                number = 0
        yield from sent()

    return run


def _matched(windows: Windows, matcher: Matcher) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, group, out = None, [], []

        def close() -> None:
            if len(group) > 1 and group[0][0] != group[-1][0]:
                for i, start, length in matcher([x[:4] for x in group], windows.size):
                    out.append((group[i][0], group[i][4], group[i][5] + start, length))
            group.clear()

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc", "row", "start", "length"), zip(*out))})
            out.clear()
            return made

        for batch in batches:
            told = pc.is_null(batch.column("piece"))
            yield batch.filter(told).select(["doc", "row", "start", "length"])
            batch = batch.filter(pc.invert(told))
            for now, *entry in zip(*(batch.column(x).to_pylist() for x in ("core", "doc", "piece", "at", "size", "row", "start"))):
                if now != core:
                    close()
                    core = now
                group.append(tuple(entry))
            if len(out) > 50_000:
                yield batch_out()
        close()
        if out:
            yield batch_out()

    return run


def removed_spans(docs: DataFrame, windows: Windows, matcher: Matcher, buckets: int) -> DataFrame:
    """(doc, row, start, length) of what earlier documents of (doc, row, text) also hold; spans may overlap."""
    flagged = docs.join(routed(docs.select("doc", "text"), windows, buckets), "doc").select("doc", "row", "text", "flags")
    pieces = flagged.mapInArrow(_found(windows), _FOUND).repartition(buckets, "core").sortWithinPartitions("core", "doc", "row", "start")
    return pieces.mapInArrow(_matched(windows, matcher), "doc long, row long, start long, length long")


def _cut_text(text: bytes, gone: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """What is left of a text without the units that are gone: as the digest wants it, and as text."""
    data = np.frombuffer(text, np.uint8)
    if kind == "bytes":
        left = data[~gone].tobytes()
        return left, left
    inside = word_bytes(text)
    # A blank belongs to the word after it; blanks at the end to none.
    ended = np.cumsum(np.concatenate(([False], inside[:-1] & ~inside[1:])), dtype=np.int32) if len(data) else np.zeros(0, np.int32)
    keep = ~np.append(gone, False)[ended]
    kept = data[keep].tobytes().strip()
    before = np.append(inside[1:] & ~inside[:-1], False) if len(data) else inside  # the blank right before a word
    use = keep & (inside | before)
    joined = np.where(inside, data, 32)[use].astype(np.uint8).tobytes()
    return joined.removeprefix(b" "), kept


@dataclass(frozen=True)
class Names:
    """Columns of the written documents that hold what the operator adds."""

    doc: str
    row: str
    spans: str

    @classmethod
    def beside(cls, columns: list[str]) -> "Names":
        return cls(*beside(columns, "doc", "row", "spans"))


def _cut(windows: Windows, names: Names, output: pa.Schema | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            rows: list[tuple] = []
            texts = text_bytes(batch.column("text"))
            given = [batch.column(x).to_pylist() for x in ("doc_id", names.row, names.spans)]
            for doc, row, spans, text in zip(*given, texts):
                own = np.array([(s["start"], s["length"]) for s in spans or [] if s["row"] == row], np.int64).reshape(-1, 2)
                if not len(own) and output is not None:
                    rows.append((None,))
                    continue
                if len(own) or len(text) > _SLICE:
                    n = len(text) if windows.kind == "bytes" else int((np.diff(word_bytes(text).view(np.int8), prepend=0) == 1).sum())
                    gone = covered(own[:, 0], own[:, 1], n)
                    left, kept = _cut_text(text, gone, windows.kind)
                    removed, n_spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                else:
                    words = text.split() if windows.kind == "words" else []
                    left, n, removed, n_spans = (b" ".join(words), len(words), 0, 0) if windows.kind == "words" else (text, len(text), 0, 0)
                if output is None:
                    rows.append((doc, n, removed, n_spans, hashlib.sha256(left).hexdigest()))
                else:
                    rows.append((kept.decode("utf-8", "replace"),))
            if output is None:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(_DIGEST, map(list, zip(*rows)), (pa.int64(),) * 4 + (pa.string(),))})
            else:
                new = pc.coalesce(pa.array([x[0] for x in rows], batch.column("text").type), batch.column("text"))
                yield pa.RecordBatch.from_arrays([new if f == "text" else batch.column(f) for f in output], names=list(output))

    return run


_DIGEST = ("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")


def cut_documents(docs: DataFrame, windows: Windows, matcher: Matcher, keep: bool) -> DataFrame:
    """Each row after losing its units: with `keep` the row, its `text` cut; else doc_id and n_units, n_removed,
    n_spans and kept_sha256.

    A unit goes when a window that covers it also stands in a document with a smaller doc_id. Windows are judged on
    the input. Rows that share a doc_id don't cover each other, and each of them is cut on its own; rows without one
    lose nothing. Rows come back one for one. For words, the cut text is the text without the removed words and the
    blanks before them, trimmed; texts that lose nothing stay as they are, null ones too.

    The documents are written in buckets by doc_id once; the table's entry in the catalog goes when the result is
    written. A task holds the entries of one bucket and works on `_SLICE` bytes of text at a time.
    """
    spark = docs.sparkSession
    names = Names.beside(docs.columns)
    own = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("text", F.col("text").cast("string"))
    number, digest = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // _BUCKET_BYTES))
    tables = min(buckets, _MOST_BUCKETS)
    table = f"amendry_{uuid.uuid4().hex}"
    # Rows without doc_id are spread by their texts; they have no row number, so no span meets them.
    own = own.withColumns({names.doc: F.coalesce(number, digest), names.row: F.when(number.isNotNull(), digest)})
    own.repartition(tables, names.doc).write.bucketBy(tables, names.doc).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    try:
        stored = spark.table(table)
        plain = stored.where(F.col(names.row).isNotNull()).select(F.col(names.doc).alias("doc"), F.col(names.row).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        spans = removed_spans(plain, windows, matcher, buckets).groupBy("doc").agg(F.collect_list(F.struct("row", "start", "length")).alias(names.spans))
        spans = spans.withColumnRenamed("doc", names.doc)
        joined = stored.join(spans, names.doc, "left")
        if keep:
            cut = joined.mapInArrow(_cut(windows, names, docs.columns), docs.withColumn("text", F.col("text").cast("string")).schema)
        else:
            cut = joined.mapInArrow(_cut(windows, names, None), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")
        return written(cut, "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
