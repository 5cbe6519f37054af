"""Language-model scoring by a probabilistic suffix tree over words.

Method. Contexts of one to `depth` words are retained when they are frequent, by an absolute count, and the words after
them diverge from those after their longest retained suffix by a G test; their distribution is smoothed with that
suffix's, at last with the unigram's. A text is scored by the longest retained suffix of what was read so far.

Sizes. Grams of up to depth + 1 words are counted one length after the other: a gram is counted when both of its shorter
ones are frequent, which tasks look up in a map of fixed size that may say yes too often. Tasks combine their grams and
send them in packed rows to buckets by context, each context once; a hot one is dealt to many places by its suffixes.
A counted gram goes on with the keys of its context and its suffix. Contexts and the words after them stay in Spark
tables and grow with the corpus. Smoothing makes the log probability of a text the sum of one number for each of its
grams; the most frequent, a fixed number, are looked up in the task. The long tail, which has no hot keys, travels in packed
columns to buckets that hold the values, some megabytes of text in a row for each; what comes back are sums by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textarrays import mix, slices, text_bytes, words_of

END = np.uint64(1)
_ADD = 0.1
_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token, text) of all tokens: hashes of lower-cased words, then one end for each text."""
    words = words_of(texts, lower=True)
    hashes = words.hashes()
    hashes[hashes <= END] += np.uint64(2)
    token = np.insert(hashes, np.cumsum(words.count), END)
    return token, np.repeat(np.arange(len(texts)), words.count + 1)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        token, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return token, np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

    def sent() -> pa.RecordBatch:
        token, n = summed()
        held.clear()
        return pa.RecordBatch.from_pydict({"token": token.view(np.int64), "n": n})

    for batch in slices(batches, "text"):
        held.append(np.unique(tokens_of(text_bytes(batch.column("text")))[0], return_counts=True))
        if sum(len(x[0]) for x in held) > 2_000_000:
            held[:] = [summed()]
            if len(held[0][0]) > 1_000_000:
                yield sent()
    if held:
        yield sent()


def token_totals(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts; null texts count as empty."""
    return docs.select(F.col("text").cast("string")).mapInArrow(_count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Lookup:
    """Values of 64-bit keys; `missing` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order], values[order], missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.missing, self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


_BITS = 26  # of a key, in a map of fixed size


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2^26 bits, set where `key` may be: whatever the table, 2^20 rows at most come back. Others only cost rows."""
    place = F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64((1 << _BITS) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) > 0


def grams_of(token: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Text of each symbol (a BEGIN before each text), and for 1 to `most` symbols the key of those that end there, and whether they lie in one text.

    The key of one symbol is itself, 0 for BEGIN. A longer gram's key comes from those of its context (the gram without
    the last symbol, which ends one place earlier) and its suffix (without the first, which ends at the same place).
    """
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    symbol, text = np.insert(token, starts, 0), np.insert(doc, starts, doc[starts])
    n = len(symbol)
    at = np.arange(n) - np.repeat(starts + np.arange(len(starts)), np.bincount(text, minlength=1)[np.bincount(text, minlength=1) > 0]) if n else np.zeros(0, np.int64)
    out = [(symbol, np.ones(n, bool))]
    for m in range(2, most + 1):
        key = np.zeros(n, np.uint64)
        key[1:] = _key(out[-1][0][:-1], out[-1][0][1:])
        out.append((key, at >= m - 1))
    return text, out


def _key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return mix(mix(context + _SALT) * _BASE + suffix)


_COUNTED = 2_000_000  # tokens of the corpus for each bucket of counts
_GRAMS = "bucket int, contexts binary, runs binary, suffixes binary, places binary, times binary"
_HOT = 2000  # of all tokens, one in this many after one context makes it hot


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of one, two or four bytes each."""
    most = x.max(initial=0)
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {n: np.uint8, 2 * n: np.uint16, 4 * n: np.uint32}[len(blob)]).astype(np.int64) if n else np.zeros(0, np.int64)


def _spread(context: np.ndarray, suffix: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """32 bits that tell the bucket: those of the context, and of hot ones 64 by the suffix."""
    is_hot = hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context if len(hot) else np.zeros(len(context), bool)
    return mix(context + np.where(is_hot, (mix(suffix) >> np.uint64(58)) * _BASE + _SALT, np.uint64(0))) >> np.uint64(32)


def _combined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (spread, context, suffix, count) the distinct grams and their sums, in order of spread and context. The order
    has 64 bits of both, so a gram may rarely stay in two parts."""
    spread, context, suffix, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(spread << np.uint64(32) | mix(context * _BASE + suffix) >> np.uint64(32))
    spread, context, suffix, n = spread[order], context[order], suffix[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1])))) if len(n) else np.zeros(0, np.int64)
    return spread[new], context[new], suffix[new], np.add.reduceat(n, new) if len(n) else n


def _pack_grams(spread: np.ndarray, context: np.ndarray, suffix: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: each context once with the number of its suffixes, and these by their place in a list of
    different ones where that is shorter."""
    rows, cuts = [], np.searchsorted(spread * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[j], cuts[j + 1])
        first = np.flatnonzero(np.concatenate(([True], context[own][1:] != context[own][:-1])))
        listed, at = np.unique(suffix[own], return_inverse=True)
        at = _narrow(at)
        if 8 * len(listed) + len(at) >= 8 * len(n[own]):
            listed, at = suffix[own], b""
        rows.append((j, context[own][first].tobytes(), _narrow(np.diff(np.append(first, len(n[own])))), listed.tobytes(), at, _narrow(n[own])))
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), *[pa.binary()] * 5])], names=["bucket", "contexts", "runs", "suffixes", "places", "times"])


def _count_grams(shared, m: int, buckets: int) -> Callable:
    """Packed rows by bucket of the grams of m symbols whose two grams of m - 1 symbols may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bitmap, hot), held = shared.value, []
        for batch in slices(batches, "text"):
            _, grams = grams_of(*tokens_of(text_bytes(batch.column("text"))), m)
            fine = grams[-1][1]
            shorter = grams[-2][0]
            may = _maybe(bitmap, shorter)
            fine[1:] &= may[1:] & may[:-1]
            at = np.flatnonzero(fine)
            context, suffix = shorter[at - 1], shorter[at]
            held.append((_spread(context, suffix, hot), context, suffix, np.ones(len(at), np.int64)))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held[:] = [_combined(held)]
                if len(held[0][0]) > 1_000_000:
                    yield _pack_grams(*held.pop(), buckets)
        if held:
            yield _pack_grams(*_combined(held), buckets)

    return run


def _frequent_grams(least: int) -> Callable:
    """(key, context, suffix, n) of the grams of each bucket that `least` occurrences reach; rows come sorted by bucket."""

    def counted(held: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        contexts, suffixes, times = [], [], []
        for context, runs, suffix, places, n in held:
            context, suffix = np.frombuffer(context, np.uint64), np.frombuffer(suffix, np.uint64)
            contexts.append(np.repeat(context, runs := _wide(runs, len(context))))
            suffixes.append(suffix[_wide(places, int(runs.sum()))] if places else suffix)
            times.append(_wide(n, int(runs.sum())))
        context, suffix, times = map(np.concatenate, (contexts, suffixes, times))
        del contexts, suffixes
        key = _key(context, suffix)
        order = np.argsort(key)
        new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        n = np.add.reduceat(times[order], new)
        at, n = order[new[n >= least]], n[n >= least]
        return pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (key, context, suffix)), pa.array(n)], names=["key", "context", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "contexts", "runs", "suffixes", "places", "times"))):
                if bucket != now and held:
                    yield counted(held)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield counted(held)

    return run


def fit_contexts(train: DataFrame, totals: DataFrame, n: int, v: int, depth: int = 3, min_count: int = 5, smoothing: float = 50.0, strength: float = 3.0) -> DataFrame:
    """(m, key, n, value): what a gram of m symbols adds to log10 of the probability of a text, where it isn't 0.

    Contexts of 1 to `depth` words, and the words after one, count from `min_count` occurrences on, however large the
    corpus. After a retained context c with total t a word x seen k times has (k + (s + r) P(x | suffix)) / (t + s): s is
    `smoothing`, r the occurrences after c of words with fewer, the suffix the longest retained one and at last the
    unigram. So c adds log10((s + r) / (t + s)) wherever it stands and (c, x) log10(1 + k / ((s + r) P(x | suffix))).
    c is retained when 2 sum k log(k / (t P(x | suffix))), the r as one symbol, is at least `strength` times the symbols.
    """
    sc, z = train.sparkSession.sparkContext, n + _ADD * (v + 1)
    text, buckets = train.select(F.col("text").cast("string")), max(8, n // _COUNTED)
    words = totals.select(F.when(F.col("token") == int(END), 0).otherwise(F.col("token")).cast("long").alias("key"), "n")  # as many begins as ends
    frequent = [written(words.where(F.col("n") >= min_count), "grams")]
    bitmap = _bitmap(totals.where(F.col("n") >= min_count).select(F.col("token").alias("key")).union(frequent[0].select("key")))
    for m in range(2, depth + 2):
        hot = frequent[-1].where(F.col("n") > F.lit(n // _HOT)).select("key").toArrow().column("key").to_numpy().view(np.uint64)  # few more than _HOT
        shared = sc.broadcast((bitmap, np.sort(hot)))
        packed = text.mapInArrow(_count_grams(shared, m, buckets), _GRAMS).repartition(min(buckets, 50_000), "bucket").sortWithinPartitions("bucket")
        frequent.append(written(packed.mapInArrow(_frequent_grams(min_count), "key long, context long, suffix long, n long"), "grams"))
        shared.destroy()  # its copies would stay on every executor's disk
        bitmap = _bitmap(frequent[-1])
    known = totals.select(F.col("token").alias("suffix"), ((F.col("n") + F.lit(_ADD)) / F.lit(z)).alias("p"))  # P of the last symbol after its longest retained context
    backs, deltas = [], []
    for m in range(2, depth + 2):
        cells = frequent[m - 1].join(known, "suffix")
        cells = written(cells.select("key", "context", "n", "p"), "cells")
        sums = cells.groupBy("context").agg(F.sum("n").alias("seen"), F.sum("p").alias("mass"), F.count(F.lit(1)).alias("symbols"), F.sum(F.col("n") * F.log(F.col("n") / F.col("p"))).alias("g"))
        sums = sums.join(frequent[m - 2].select(F.col("key").alias("context"), F.col("n").alias("total")), "context").withColumn("rest", F.col("total") - F.col("seen"))
        pooled = F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
        g = 2 * (F.col("g") + pooled - F.col("total") * F.log("total"))
        kept = sums.where(g >= F.lit(strength) * (F.col("symbols") + (F.col("rest") > 0).cast("int"))).select("context", "total", (F.lit(smoothing) + F.col("rest")).alias("free"))
        kept = written(kept, "contexts")
        backs.append(kept.select(F.lit(m - 1).alias("m"), F.col("context").alias("key"), F.col("total").alias("n"), F.log10(F.col("free") / (F.col("total") + F.lit(smoothing))).alias("value")))
        cells = written(cells.join(kept, "context", "left"), "cells")
        deltas.append(cells.where("total IS NOT NULL").select(F.lit(m).alias("m"), "key", "n", F.log10(1 + F.col("n") / (F.col("free") * F.col("p"))).alias("value")))
        after = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.col("n") + F.col("free") * F.col("p")) / (F.col("total") + F.lit(smoothing)))
        known = cells.select(F.col("key").alias("suffix"), after.alias("p"))
    values = backs[0]
    for part in (*backs[1:], *deltas):
        values = values.union(part)
    return written(values.groupBy("m", "key").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "values")


_COLUMNS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<token:long,n:int>>, bucket int, keys binary, docs binary"
_PACKED = "bucket int, row long, keys binary, docs binary"
_BUCKET = 4_000_000  # tokens of the corpus for each bucket of grams


def _times(doc: np.ndarray, key: np.ndarray, n: int) -> pa.ListArray:
    """Distinct keys of each of n texts, with how often they stand there."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key))).astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(key[new].view(np.int64)), pa.array(times)], names=["token", "n"]))


def _dealt(keys: np.ndarray, beside: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, keys, what stands beside them), packed."""
    part = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(part, kind="stable")
    keys, beside, cuts = keys[order], beside[order], np.searchsorted(part[order], np.arange(buckets + 1))
    return [(j, keys[cuts[j] : cuts[j + 1]].tobytes(), beside[cuts[j] : cuts[j + 1]].tobytes()) for j in np.flatnonzero(np.diff(cuts)).tolist()]


def _packed(rows: list[tuple[int, bytes, bytes]], row: int) -> list[pa.Array]:
    bucket, keys, beside = zip(*rows) if rows else ((), (), ())
    return [pa.array(bucket, pa.int32()), pa.array([row] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(beside, pa.binary())]


def _score_grams(shared, z: float, buckets: int) -> Callable:
    """A row for each text, and for each batch of texts one for each bucket that it asks: `row` is that of its first text,
    `docs` the text of each key, counted from there."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
    kinds |= {"tail": pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32())])), "bucket": pa.int32(), "keys": pa.binary(), "docs": pa.binary()}

    def rows(number: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(number, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, finds, bitmaps = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            token, doc = tokens_of(text_bytes(batch.column("text")))
            n = batch.num_rows
            count = common(token)
            looked_up = count >= 0
            base = np.bincount(doc, weights=np.where(looked_up, np.log10((np.maximum(count, 0) + _ADD) / z), 0), minlength=n)
            value, docs, keys = np.zeros(n), [], []
            text, grams = grams_of(token, doc, len(finds))
            for (key, fine), find, bitmap in zip(grams, finds, bitmaps):
                fine = np.flatnonzero(fine & _maybe(bitmap, key))
                found = find(key[fine])
                sure = ~np.isnan(found)
                value += np.bincount(text[fine[sure]], weights=found[sure], minlength=n)
                docs.append(text[fine[~sure]])
                keys.append(key[fine[~sure]])
            yield rows(
                n, row=pa.array(row + np.arange(n)), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=pa.array(np.bincount(doc, minlength=n)),
                n_known=pa.array(np.bincount(doc, weights=looked_up, minlength=n).astype(np.int64)), base=pa.array(base), score=pa.array(base + value), tail=_times(doc[~looked_up], token[~looked_up], n),
            )
            asked = _dealt(np.concatenate(keys), np.concatenate(docs).astype(np.uint32), buckets)
            yield rows(len(asked), **dict(zip(("bucket", "row", "keys", "docs"), _packed(asked, row))))
            row += n

    return run


def _pack_values(buckets: int, most: int = 500_000) -> Callable:
    """(key, value) as packed rows of each bucket: `row` is -1, and the values stand in the place of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            made = _packed(_dealt(*map(np.concatenate, zip(*held)), buckets), -1)
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=["bucket", "row", "keys", "docs"])

        for batch in batches:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("value").to_numpy()))
            if sum(len(k) for k, _ in held) > most:
                yield sent()
        if held:
            yield sent()

    return run


def _ask_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, values first: for what each batch of texts asks, sums by text."""
    now, held, find = None, [], None
    for batch in batches:
        out = []
        for bucket, row, keys, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "keys", "docs"))):
            if bucket != now:
                now, held, find = bucket, [], None
            if row < 0:
                held.append((keys, docs))
                continue
            if find is None:
                find = Lookup(*(np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held) if held else ((), ()), (np.uint64, np.float64))), 0.0)
            doc, at = np.unique(np.frombuffer(docs, np.uint32), return_inverse=True)
            out.append((row, doc.tobytes(), np.bincount(at, find(np.frombuffer(keys, np.uint64))).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["row", "docs", "sums"])


def _sum_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by `row`: one sum for each text that has any."""

    def added(first: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        doc, at = np.unique(np.frombuffer(b"".join(d for d, _ in held), np.uint32), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(first + doc.astype(np.int64)), pa.array(np.bincount(at, np.frombuffer(b"".join(s for _, s in held))))], names=["row", "gram_log10"])

    now, held = None, []
    for batch in batches:
        for row, docs, sums in zip(*(batch.column(c).to_pylist() for c in ("row", "docs", "sums"))):
            if row != now and held:
                yield added(now, held)
                held = []
            now = row
            held.append((docs, sums))
    if held:
        yield added(now, held)


def _added(parts: DataFrame, values: DataFrame, buckets: int) -> DataFrame:
    """(row, gram_log10): sums of the values of (key, value) over all that the rows of `parts` ask for."""
    told = values.mapInArrow(_pack_values(buckets), _PACKED)
    asked = parts.where("bucket IS NOT NULL").select("bucket", "row", "keys", "docs")
    both = told.union(asked).repartition(min(buckets, 50_000), "bucket").sortWithinPartitions("bucket", "row")
    sums = both.mapInArrow(_ask_values, "row long, docs binary, sums binary")
    return sums.repartition("row").sortWithinPartitions("row").mapInArrow(_sum_by_text, "row long, gram_log10 double")


def _least(counts: DataFrame, most: int, share: float) -> float:
    """The least n that at most `most` rows of (.., n) reach, or `share` where more than that reach 10,000."""
    found = counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().toArrow().sort_by([("n", "descending")])
    fits = np.flatnonzero(np.cumsum(found.column("count").to_numpy()) <= most)
    return min(share, float(found.column("n")[int(fits[-1])].as_py()) if len(fits) else share)


def score_texts(docs: DataFrame, held_out: Column, common_share: float = 2e-6, looked_up: int = 1_500_000, words_looked_up: int = 200_000, depth: int = 3, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of each whole text.

    The model learns from the rows where `held_out` is false. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1)));
    score is the suffix tree's of `fit_contexts`, which sums to 1 over all words, one unknown word and the end. Null
    texts are empty and consist of an end. Without training rows N = V = 0. Rows come back one for one, repeated ones
    too. Words and grams of more than `common_share` of the tokens, and others down to `words_looked_up` and `looked_up`
    in all, are looked up in the task; scores don't depend on it. A task holds some 25 to 35 bytes for each byte of its
    longest text.
    """
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = df.where("NOT held_out")
    totals = written(token_totals(train), "totals")
    n, v = (x or 0 for x in totals.agg(F.sum("n"), F.count(F.lit(1))).first())
    z = n + _ADD * (v + 1)
    values = fit_contexts(train, totals, n, v, depth, **options)
    least_word, least = (_least(x, most, max(1.0, n * common_share)) for x, most in ((totals, words_looked_up), (values, looked_up)))
    known = totals.where(F.col("n") >= least_word).toArrow()  # at most words_looked_up or 1 / common_share rows
    common = Lookup(known.column("token").to_numpy().view(np.uint64), known.column("n").to_numpy(), -1)
    finds, bitmaps = [], []
    for m in range(1, depth + 2):
        own = values.where(F.col("m") == m)
        hot = own.where(F.col("n") >= least).select("key", "value").toArrow()  # likewise, for each m
        finds.append(Lookup(hot.column("key").to_numpy().view(np.uint64), hot.column("value").to_numpy(), np.nan))
        bitmaps.append(_bitmap(own))
    shared = spark.sparkContext.broadcast((common, finds, bitmaps))
    buckets = max(8, n // _BUCKET)
    parts = written(df.mapInArrow(_score_grams(shared, z, buckets), _COLUMNS), "scores")
    shared.destroy()
    rare = (
        parts.select("row", F.explode("tail").alias("x")).select("row", "x.*")
        .join(totals.where(F.col("n") < least_word).select("token", F.col("n").alias("c")), "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(_ADD)) / F.lit(z))).alias("tail_log10"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        )
    )
    added = _added(parts, values.where(F.col("n") < least).groupBy("key").agg(F.sum("value").alias("value")), buckets)
    more, known_more, grams_more = F.coalesce("tail_log10", F.lit(0.0)), F.coalesce("tail_known", F.lit(0)), F.coalesce("gram_log10", F.lit(0.0))
    return parts.where("bucket IS NULL").drop("tail", "bucket", "keys", "docs").join(rare, "row", "left").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known_more).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more + grams_more).alias("score"),
    )
