"""Documents that share most of their word shingles, by a grouped prefix join.

Method. The shingles of a set are put in one order for all documents, frequent ones last. Two sets as similar as asked for
share one of the first n - ceil(t n) + 1 shingles of each, their prefixes. Documents with the same prefix and size are one
group; groups that share a prefix shingle are candidates, which positions, sizes and the overlap of both prefixes thin
out; what is left is expanded to the members, whose whole sets decide.

Before that, documents that can have no partner go: one that holds more than n - ceil(t n) shingles of its own can't
share enough with any other. Shingles travel once for this, 4 bytes each, to buckets by their hash; a shingle that
several documents of one batch hold is sent once. What frequent shingles a bucket sees becomes the order.

Only what joins components is verified. Each group is first held against one leader of a block (a prefix shingle and a
band of sizes): the group whose prefix most others share, such as the text that near copies were made from; members are
held against one of their group. Two more rounds take other leaders for what is still apart. Then pairs are made between
different components only: in a block everything outside its largest component meets the whole block. So thousands of
near copies cost a few pairs each, and every link between documents that aren't connected otherwise is still tried; the
components are exact. Pairs also pass a filter by 512 bits of each set, where each shingle turns a bit by its hash: sets
differ in at least as many shingles as their bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .simhash import _digests, _shingles, components
from .textarrays import slices, text_bytes, words_of

#: Shingles that a bucket's task holds at once, and the most frequent shingles that all tasks know.
_BUCKET, _KNOWN = 2_000_000, 4_000_000
#: Documents whose ids are sent to all tasks instead of being joined by a shuffle.
_SENT = 500_000

#: Rounds of leaders, and the words of 64 bits of a set's sketch.
_ROUNDS, _WORDS = 3, 8
_SKETCH = [f"s{j}" for j in range(_WORDS)]

_ROUTED = "bucket int, keys binary, counts binary, hashes binary, seen binary, times binary"
_COUNTED = "doc_id long, mark long, digest binary, n int, key long, part int, keys binary, own binary, code long, df long"


def _place(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and remaining 32 bits of each hash."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _codes(grams: np.ndarray, buckets: int) -> np.ndarray:
    bucket, low = _place(grams, buckets)
    return bucket << 32 | low.astype(np.int64)


def _routed(width: int, buckets: int):
    """Rows of a batch for each bucket: the shingles that one document alone holds here, by document, and those of
    several once. Rows of negative buckets carry the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in slices(batches, "text", 2_000_000):
            words = words_of(text_bytes(batch.column("text")), lower=True)
            grams, count = _shingles(words, width)
            digests = b"".join(_digests(words))
            keys = np.frombuffer(digests, np.int64)[::2]
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            doc = np.repeat(np.arange(len(keys)), count)
            order = np.lexsort((doc, grams))
            g, d = grams[order], doc[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            n = np.bincount(d[new], minlength=len(keys)).astype(np.int32)
            chosen = np.zeros(len(keys), bool)  # of equal texts one
            places = np.flatnonzero(known)
            chosen[places[np.unique(keys[places], return_index=True)[1]]] = True
            use = new & chosen[d]
            g, d = g[use], d[use]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
            times = np.diff(np.append(first, len(g)))
            alone, several = first[times == 1], first[times > 1]
            bucket, low = _place(g[alone], buckets)
            at = np.lexsort((d[alone], bucket))
            bucket, low, owner = bucket[at], low[at], d[alone][at]
            seen_bucket, seen = _place(g[several], buckets)
            times = times[times > 1].astype(np.uint32)
            cuts, seen_cuts = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(seen_bucket, np.arange(buckets + 1))
            rows = [(-1 - turn % buckets, digests, n.tobytes(), np.asarray(ids.fill_null(0)).tobytes(), known.tobytes(), np.asarray(batch.column("mark")).tobytes())]
            turn += 1
            for j in range(buckets):
                own, z = slice(cuts[j], cuts[j + 1]), slice(seen_cuts[j], seen_cuts[j + 1])
                if own.start == own.stop and z.start == z.stop:
                    continue
                docs, number = np.unique(owner[own], return_counts=True)
                rows.append((j, keys[docs].tobytes(), number.astype(np.uint32).tobytes(), low[own].tobytes(), seen[z].tobytes(), times[z].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])], names=["bucket", "keys", "counts", "hashes", "seen", "times"])

    return run


def _rows(number: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "digest": pa.binary(), "n": pa.int32(), "key": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "own": pa.binary(), "code": pa.int64(), "df": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns and isinstance(columns[c], pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(number, t) for c, t in kinds.items()], names=list(kinds))


def _bucket_counts(bucket: int, rows: list[tuple], frequent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    join = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
    keys, place = np.unique(join(0, np.int64), return_inverse=True)
    both = join(2, np.uint32).astype(np.uint64) << np.uint64(32) | np.repeat(place, join(1, np.uint32)).astype(np.uint64)
    both = np.unique(both)  # equal texts of several batches count once
    seen, at = np.unique(join(3, np.uint32), return_inverse=True)
    times = np.bincount(at, join(4, np.uint32), minlength=len(seen)).astype(np.int64)
    hashes, which, df = np.unique((both >> np.uint64(32)).astype(np.uint32), return_inverse=True, return_counts=True)
    if len(seen) and len(hashes):
        spot = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
        df = df + np.where(seen[spot] == hashes, times[spot], 0)
    own = np.bincount((both & np.uint64(0xFFFFFFFF)).astype(np.int64)[df[which] == 1], minlength=len(keys))
    has = np.flatnonzero(own)
    part = (keys[has].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    has, cuts = has[order], np.searchsorted(part[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    packed = [(keys[at := has[cuts[p] : cuts[p + 1]]].tobytes(), own[at].astype(np.uint32).tobytes()) for p in full]
    yield _rows(len(full), part=np.array(full, np.int32), keys=pa.array([x for x, _ in packed], pa.binary()), own=pa.array([x for _, x in packed], pa.binary()))
    rest = ~np.isin(seen, hashes)
    values, df = np.concatenate((hashes, seen[rest])), np.concatenate((df, times[rest]))
    many = np.flatnonzero(df >= frequent)
    yield _rows(len(many), code=np.int64(bucket) << 32 | values[many].astype(np.int64), df=df[many])


def _counted(frequent: int, buckets: int):
    """Rows come sorted by bucket; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts", "hashes", "seen", "times"))):
                if bucket < 0:
                    digests, n, (ids, marks) = row[0], np.frombuffer(row[1], np.int32), (np.frombuffer(row[k], np.int64) for k in (2, 4))
                    digest = pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary())
                    yield _rows(len(n), doc_id=pa.array(ids, mask=~np.frombuffer(row[3], bool)), mark=marks, digest=digest, n=n, key=np.frombuffer(digests, np.int64)[::2])
                    continue
                if bucket != now and held:
                    yield from _bucket_counts(now, held, frequent, buckets)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield from _bucket_counts(now, held, frequent, buckets)

    return run


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by key of the shingles that are a document's own, a part of the keys at a time; rows come sorted by part."""

    def summed(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, at = np.unique(np.frombuffer(b"".join(k for k, _ in held), np.int64), return_inverse=True)
        own = np.bincount(at, np.frombuffer(b"".join(x for _, x in held), np.uint32), minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own.astype(np.int64))], names=["key", "alone"])

    now, held = None, []
    for batch in batches:
        for part, keys, own in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "own"))):
            if part != now and held:
                yield summed(held)
                held = []
            now = part
            held.append((keys, own))
    if held:
        yield summed(held)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            words = words_of(text_bytes(batch.column("text")), lower=True)
            grams, count = _shingles(words, width)
            own = [np.unique(x).view(np.int64) for x in np.split(grams, np.cumsum(count)[:-1])]
            made = pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(own, pa.list_(pa.int64()))], names=["digest", "own"])
            yield made.filter(pa.array([a == b for a, b in zip(_digests(words), batch.column("digest").to_pylist())], pa.bool_()))

    return run


def _prefixes(known, buckets: int, per_cent: int):
    """Each set's first shingles in the order (level of frequency, hash), and its group: their hash with the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, levels = known.value
        for batch in slices(batches, "digest", 64_000):
            sets = batch.column("own")
            n = np.asarray(sets.value_lengths()).astype(np.int64)
            grams = np.asarray(sets.flatten()).view(np.uint64)
            level = np.zeros(len(grams), np.int64)
            if len(codes) and len(grams):
                code = _codes(grams, buckets)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                level = np.where(codes[at] == code, levels[at], 0)
            token = level << 58 | (grams >> np.uint64(6)).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            token = token[np.lexsort((token, doc))]
            length, start = n + (-per_cent * n // 100) + 1, np.cumsum(n) - n
            own = [token[a : a + p] for a, p in zip(start.tolist(), length.tolist())]
            bits = np.bincount(doc * 64 * _WORDS + (grams % np.uint64(64 * _WORDS)).astype(np.int64), minlength=len(n) * 64 * _WORDS) & 1
            sketch = np.packbits(bits.astype(np.uint8).reshape(len(n), -1), axis=1).view(np.int64)
            group = np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for p, k in zip(own, n.tolist())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n.astype(np.int32)), pa.array(group), pa.array(own, pa.list_(pa.int64())), *map(pa.array, sketch.T)], names=["digest", "n", "group", "prefix", *_SKETCH])

    return run


def _least_shared(per_cent: int, a: Column, b: Column) -> Column:
    """Fewest common shingles of two sets of these sizes that are as similar as asked for."""
    return F.ceil(per_cent * (a + b) / F.lit(100 + per_cent)).cast("int")


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ, whose columns end in `a` and `b`."""
    return sum((F.bit_count(F.col(f"{x}{a}").bitwiseXOR(F.col(f"{x}{b}"))) for x in _SKETCH[1:]), F.bit_count(F.col(f"s0{a}").bitwiseXOR(F.col(f"s0{b}"))))


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (a, b) of digests those whose whole sets are similar enough."""
    one, two = sets.select(F.col("digest").alias("a"), F.col("own").alias("own_a")), sets.select(F.col("digest").alias("b"), F.col("own").alias("own_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * shared >= per_cent * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b")


def _labels(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with their component; those without edges are their own."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = components(ends, edges).select(F.col("node").alias("digest"), "component")
    return written(members.join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "labels")


def _grouped(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups with their component, null where members are in several."""
    state = labels.groupBy("group").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    return written(groups.join(state, "group").withColumn("component", F.when(F.col("component") == F.col("other"), F.col("component"))).drop("other"), "grouped")


def _leader_pairs(groups: DataFrame, labels: DataFrame, per_cent: int, turn: int) -> DataFrame:
    """Each group's first member with the leader of one of its blocks, of those in another component and near enough by
    size and sketch the nearest; and each member with another one of its group. Leaders are what most shingles lead to at
    first, others by hash in later turns."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / per_cent)))
    if turn:
        by = F.xxhash64("group", F.lit(turn))
    else:
        slim = groups.select("group", F.explode("prefix").alias("token"))
        sizes = slim.groupBy("token").agg(F.log(F.count(F.lit(1)).cast("double")).alias("size"))
        groups, by = groups.join(slim.join(sizes, "token").groupBy("group").agg(F.avg("size").alias("weight")), "group"), F.struct("weight", "group")
    at = groups.select("group", "leader", "n", "component", *_SKETCH, band.alias("band"), by.alias("by"), F.explode("prefix").alias("token"))
    of_lead = [F.col("group").alias("lead"), F.col("leader").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of_b"), *(F.col(x).alias(f"{x}_b") for x in _SKETCH)]
    lead = at.groupBy("token", "band").agg(F.max_by(F.struct(*of_lead), "by").alias("x"), F.min("group").alias("least"), F.max("group").alias("most"))
    lead = lead.where("least < most").select("token", "band", "x.*")
    apart = F.coalesce(F.col("component") != F.col("of_b"), F.lit(True)) & (F.col("group") != F.col("lead"))
    over = _apart("", "_b") - (F.col("n") + F.col("n_b") - 2 * _least_shared(per_cent, F.col("n"), F.col("n_b")))  # over 0 they can't be linked
    met = at.join(lead, ["token", "band"]).where(apart).select("group", "leader", "b", over.alias("over")).where("over <= 0")
    across = met.groupBy("group").agg(F.first("leader").alias("a"), F.min_by("b", F.struct("over", "b")).alias("b")).select("a", "b")
    inside = labels.groupBy("group").agg(F.max_by(F.struct(F.col("digest").alias("b"), F.col("component").alias("of_b")), F.xxhash64("digest", F.lit(turn))).alias("x"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    inside = inside.where("least < most").select("group", "x.*")
    return across.union(labels.join(inside, "group").where("component <> of_b").select(F.col("digest").alias("a"), "b"))


def _group_pairs(held: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of different groups (g, h) that may hold a link between different components."""
    firsts = held.select("group", *(F.col(x).alias(f"{x}_first") for x in _SKETCH))
    spread = labels.join(firsts, "group").groupBy("group").agg(F.max(_apart("", "_first")).alias("spread"))
    columns = ["group", "n", "component", "spread", *_SKETCH]
    at = held.join(spread, "group").select(*columns, F.posexplode("prefix").alias("pos", "token"))
    # A token's largest component; groups of several components stand for themselves.
    sizes = at.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    blocks = sizes.groupBy("token").agg(F.max_by("component", F.when(F.col("component").isNotNull(), F.col("size"))).alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total"))
    blocks = blocks.where("total > 1 AND (parts > 1 OR largest IS NULL)").select("token", "largest")
    alive = written(at.join(blocks, "token"), "blocks")
    side = lambda df, x: df.select("token", *(F.col(c).alias(f"{c}_{x}") for c in (*columns, "pos")))
    outside = alive.where("component IS NULL OR largest IS NULL OR component <> largest")
    need = _least_shared(per_cent, F.col("n_a"), F.col("n_b"))
    differ = F.coalesce(F.col("component_a") != F.col("component_b"), F.lit(True)) & (F.col("group_a") != F.col("group_b"))
    near = (100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b")) & (F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need)
    alike = _apart("_a", "_b") - F.col("spread_a") - F.col("spread_b") <= F.col("n_a") + F.col("n_b") - 2 * need
    met = side(alive, "a").join(side(outside, "b"), "token").where(differ & near & alike).select(F.least("group_a", "group_b").alias("g"), F.greatest("group_a", "group_b").alias("h")).distinct()
    one, two = [held.select(F.col("group").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}")) for x in "gh"]
    last = F.least(F.element_at("prefix_g", -1), F.element_at("prefix_h", -1))
    need = _least_shared(per_cent, F.col("n_g"), F.col("n_h"))
    shared = F.size(F.array_intersect("prefix_g", "prefix_h"))
    misses = [F.size(F.filter(f"prefix_{x}", lambda t: t <= F.col("last"))) - F.col("shared") <= F.col(f"n_{x}") - need for x in "gh"]
    both = met.join(one, "g").join(two, "h").withColumns({"last": last, "shared": shared})
    return both.where(misses[0] & misses[1]).select("g", "h")


def _member_pairs(pairs: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Members of paired groups, and of one group, that are in different components."""
    side = lambda df, x, name: df.select(F.col("group").alias(name), F.col("digest").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("component", "n", *_SKETCH)))
    need = _least_shared(per_cent, F.col("n_a"), F.col("n_b"))
    fits = (F.col("component_a") != F.col("component_b")) & (_apart("_a", "_b") <= F.col("n_a") + F.col("n_b") - 2 * need)
    across = pairs.join(side(labels, "a", "g"), "g").join(side(labels, "b", "h"), "h").where(fits).select("a", "b")
    # Within a group only what lies outside one component, its largest, meets all members.
    sizes = labels.groupBy("group", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("group").agg(F.max_by("component", "size").alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("group", "largest")
    inner = labels.join(mixed, "group")
    inside = side(inner, "a", "g").join(side(inner.where("component <> largest"), "b", "g"), "g").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.union(inside).distinct()


def linked_sets(docs: DataFrame, width: int, per_cent: int, proposed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, mark, digest, n), different texts with shingles (digest, doc_id, n), and of those with partners
    (digest, component_id, component_mark), as `similar_sets` has them; the mark is that of the first text under the id. `proposed` are pairs (a, b) of digests that are held against each
    other in the first round, beside its leaders."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    about = (own.agg(F.sum(F.octet_length("text")).alias("x")).first().x or 0) // 6  # shingles, roughly; a plan choice alone
    buckets, frequent = max(8, -(-about // _BUCKET)), max(16, -(-about // _KNOWN))
    routed = own.mapInArrow(_routed(width, buckets), _ROUTED).repartition(min(buckets, 50_000), "bucket").sortWithinPartitions("bucket")
    counted = written(routed.mapInArrow(_counted(frequent, buckets), _COUNTED), "counted")

    rows = counted.where("digest IS NOT NULL").select("doc_id", "mark", "digest", "n", "key")
    texts = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("n").alias("n"), F.first("key").alias("key"))
    texts = written(texts.select("digest", "one.*", "n", "key"), "texts")
    alone = counted.where("part IS NOT NULL").select("part", "keys", "own").repartition(min(buckets, 50_000), "part").sortWithinPartitions("part").mapInArrow(_alone, "key long, alone long")
    spare = F.col("n") - F.ceil(F.col("n") * per_cent / F.lit(100))
    kept = written(texts.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= spare).select("doc_id", "mark", "digest"), "kept")

    wanted = F.broadcast(kept) if kept.limit(_SENT + 1).count() <= _SENT else kept
    sets = written(own.join(wanted, ["doc_id", "mark"]).select("digest", "text").mapInArrow(_sets(width), "digest binary, own array<long>").dropDuplicates(["digest"]), "sets")
    known = counted.where("code IS NOT NULL").select("code", "df").toArrow()
    codes, df = (np.asarray(known.column(c).combine_chunks()) for c in ("code", "df"))
    order = np.argsort(codes)
    known = spark.sparkContext.broadcast((codes[order], (np.minimum(15, 1 + np.log2(np.maximum(1, df[order] // frequent)))).astype(np.int64)))
    prefixes = written(sets.mapInArrow(_prefixes(known, buckets, per_cent), "digest binary, n int, group long, prefix array<long>, " + ", ".join(f"{x} long" for x in _SKETCH)), "prefixes")
    known.destroy()

    first = F.min(F.struct(F.col("digest").alias("leader"), "n", "prefix", *_SKETCH)).alias("x")
    groups = written(prefixes.groupBy("group").agg(first).select("group", "x.*"), "groups")
    members = prefixes.select("digest", "group", "n", *_SKETCH)
    labels, edges = members.withColumn("component", F.col("digest")), None
    for turn in range(_ROUNDS):
        pairs = _leader_pairs(_grouped(groups, labels), labels, per_cent, turn)
        if proposed is not None and not turn:
            pairs = pairs.union(proposed).distinct()
        more = written(_verified(pairs, sets, per_cent), "links")
        edges = more if edges is None else edges.union(more)
        labels = _labels(members, edges)
    held = _grouped(groups, labels)
    more = written(_verified(_member_pairs(_group_pairs(held, labels, per_cent), labels, per_cent), sets, per_cent), "more-links")
    found = _labels(members, edges.union(more)).select("digest", "component")

    least = found.join(texts, "digest").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    linked = written(found.join(least, "component").select("digest", F.col("first.doc_id").alias("component_id"), F.col("first.mark").alias("component_mark")), "linked")
    return rows, texts, linked


def similar_sets(docs: DataFrame, width: int = 4, per_cent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    A set holds a whole text's distinct shingles of `width` words, A-Z lower-cased; fewer words are one shingle. Two sets
    are linked when 100 * common >= per_cent * all; component_id is the least doc_id that links reach. Null and texts
    without words have no shingles and are linked with nothing. Rows without doc_id come back without component; rows
    that repeat an id come back each, and take part with each text of theirs. Empty tables give an empty result; other
    columns are ignored. A task holds some 50 bytes for each byte of its longest text.
    """
    rows, texts, linked = linked_sets(docs, width, per_cent)
    each = texts.join(linked, "digest", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    result = rows.join(each, "digest", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own_id.alias("component_id"))
