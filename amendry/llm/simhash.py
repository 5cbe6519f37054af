"""SimHash fingerprints, and near-duplicate groups by anchor-point covering.

Method. Two fingerprints of 64 bits that differ in at most 3 bits differ in at most one bit of one of their halves.
For each half the anchors are a covering code of radius 1: the Hamming code of 31 bits times one free bit. Every
fingerprint has a home, the anchor within 1 of its half, and visits every anchor within radius + threshold = 2 of it
(17 at most). If two halves differ in at most one bit, the home of either is an anchor that the other visits; so
comparing homes with visitors at each anchor finds every pair and, at 2^27 anchors a half, few others.

`near_duplicate_groups` links fingerprints by their bits alone. `similar_groups` links documents by the share of their
shingles: longer fingerprints propose pairs at the same anchors, and an exact join of prefixes checks them on the shingles
and finds the links that no fingerprint proposed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textarrays import Words, mix, slices, text_bytes, word_grams, words_of

_CODE_BITS = 31


def _fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    words = words_of(texts, lower=True)
    n_shingles = np.where(words.count == 0, 0, np.maximum(1, words.count - width + 1))
    first = words.first[:-1][n_shingles > 0]
    shingles = n_shingles[n_shingles > 0]
    begin = np.repeat(first - np.concatenate(([0], np.cumsum(shingles)[:-1])), shingles) + np.arange(shingles.sum())
    last = np.minimum(begin + width - 1, np.repeat(first + words.count[n_shingles > 0] - 1, shingles))
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], 42) for a, b in zip(words.start[begin].tolist(), words.end[last].tolist())), np.uint64, len(begin))
    out = np.zeros(len(texts), np.uint64)
    if len(hashes):
        out[n_shingles > 0] = np.packbits(2 * _ones(hashes, shingles) > shingles[:, None], axis=1).view(">u8").ravel()
    return out


def _ones(hashes: np.ndarray, number: np.ndarray, most: int = 500_000) -> np.ndarray:
    """How many of each text's hashes have each bit; `number` of them belong to each, one at least. Bits of `most`
    hashes are laid out at a time."""
    out, first = np.zeros((len(number), 64), np.int64), np.cumsum(number) - number
    for a in range(0, len(hashes), most):
        bits = np.unpackbits(hashes[a : a + most].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        low = int(np.searchsorted(first, a, "right")) - 1
        high = int(np.searchsorted(first, a + len(bits)))
        out[low:high] += np.add.reduceat(bits, np.maximum(first[low:high] - a, 0), axis=0, dtype=np.int32)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text, A-Z lower-cased, over its word shingles, repeats included.

    A bit is set when more than half of the shingles' XXH64 (seed 42) have it. Texts with fewer words than `width`
    are one shingle; texts without words, and null, have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            found = _fingerprints_of(text_bytes(batch.column("text")), width)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(half: Column) -> Column:
    """Number of the bit (from 1) whose flip makes the low 31 bits a code word; 0 for code words."""
    masks = [sum(1 << (p - 1) for p in range(1, _CODE_BITS + 1) if p >> j & 1) for j in range(5)]
    return reduce(lambda a, b: a + b, [F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)])


def _flip(number: Column) -> Column:
    """A long with bit `number` set, counted from 1; none for 0."""
    return F.when(number > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (number - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def _half(fp: Column, which: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if which else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def homes(nodes: DataFrame) -> DataFrame:
    """Each fingerprint at its two home anchors."""
    parts = [F.struct(F.lit(w).alias("half"), _half(F.col("fp"), w).alias("bits")) for w in (0, 1)]
    df = nodes.select("*", F.explode(F.array(*parts)).alias("part")).select(*nodes.columns, "part.*")
    return df.select(*nodes.columns, "half", F.col("bits").bitwiseXOR(_flip(_syndrome(F.col("bits")))).alias("anchor"))


def visits(nodes: DataFrame) -> DataFrame:
    """Each fingerprint at every anchor within 2 of one of its halves."""
    parts = [F.struct(F.lit(w).alias("half"), _half(F.col("fp"), w).alias("bits")) for w in (0, 1)]
    df = nodes.select("*", F.explode(F.array(*parts)).alias("part")).select(*nodes.columns, "part.*")
    df = df.withColumn("syn", _syndrome(F.col("bits")).cast("int"))
    home = F.col("bits").bitwiseXOR(_flip(F.col("syn")))
    free = F.lit(1 << _CODE_BITS)
    # Two flips reach a code word when their numbers XOR to the syndrome.
    pairs = F.filter(F.sequence(F.lit(1), F.lit(_CODE_BITS)), lambda i: (i.bitwiseXOR(F.col("syn")) > i) & (F.col("syn") > 0))
    two = F.transform(pairs, lambda i: F.col("bits").bitwiseXOR(_flip(i)).bitwiseXOR(_flip(i.bitwiseXOR(F.col("syn")))))
    return df.select(*nodes.columns, "half", F.explode(F.concat(F.array(home, home.bitwiseXOR(free)), two)).alias("anchor"))


def links(nodes: DataFrame, most: int = 3, salts: int = 8) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) whose different fingerprints differ in at most `most` (3 or fewer) bits.

    Visitors of an anchor are dealt to `salts` keys, with a copy of the residents at each, so that a crowded anchor
    is compared by several tasks; nothing is gathered, the join streams.
    """
    if most > 3:
        raise ValueError("the anchors cover 3 differing bits")
    salt = F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")
    at_home = homes(nodes).select("half", "anchor", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    visiting = visits(nodes).select("half", "anchor", salt.alias("salt"), F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    close = (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= most)
    return at_home.join(visiting, ["half", "anchor", "salt"]).where(close).select("a", "b")


def _flat(parents: DataFrame) -> DataFrame:
    """Each node's last ancestor, by doubling: (node, parent)."""
    while True:
        up = parents.select(F.col("node").alias("via"), F.col("parent").alias("above"))
        higher = parents.join(up, F.col("parent") == F.col("via"), "left").select("node", F.coalesce("above", "parent").alias("parent"), F.coalesce(F.col("above") < F.col("parent"), F.lit(False)).alias("moved"))
        higher = written(higher, "parents")
        if not higher.where("moved").limit(1).count():
            return higher.select("node", "parent")
        parents = higher.select("node", "parent")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches over `edges` (a, b).

    In each round every node with edges takes its least neighbour as parent, if that is less, and the edges move to the
    ends of these chains; edges inside a tree vanish. All of it is joins on Spark, written to the shared folder; the
    driver sees whether anything is left. Rounds grow with the logarithm of the longest chain.
    """
    labels = nodes.select("node", F.col("node").alias("component"))
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parents = _flat(written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")), "parents"))
        labels = written(labels.join(parents.withColumnRenamed("node", "at"), F.col("component") == F.col("at"), "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        ends = [parents.select(F.col("node").alias(f"old_{x}"), F.col("parent").alias(f"new_{x}")) for x in "ab"]
        moved = edges.join(ends[0], F.col("a") == F.col("old_a")).join(ends[1], F.col("b") == F.col("old_b")).where("new_a <> new_b")
        edges = written(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
    return labels


def _attached(own: DataFrame, found: DataFrame, crowd: int) -> DataFrame:
    """Each row (doc_id, fp) with its group; `found` has the number of copies of each fingerprint."""
    found = found.withColumn("parts", F.ceil(F.col("copies") / crowd).cast("int"))
    crowded = found.where("parts > 1").select("fp", "parts")  # one row for `crowd` documents at most; Spark sends it out where it is small
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))
    dealt = own.where("doc_id IS NOT NULL").join(crowded, "fp", "left").select("doc_id", "fp", part.alias("part"))
    return dealt.join(found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["fp", "part"])


def _least_ids(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, least_id): the least doc_id of each node's component, from (node, component) and (node, least)."""
    of = groups.join(ids, "node").groupBy("component").agg(F.min("least").alias("least_id"))
    return groups.join(of, "component").select("node", "least_id")


def near_duplicate_groups(docs: DataFrame, width: int = 3, most: int = 3, crowd: int = 100_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) and n_links of the fingerprint.

    Equal fingerprints are one node, so copies are never paired with each other. n_links counts the other fingerprints
    within `most` bits. Rows without doc_id have their fingerprint alone; rows that repeat an id come back each, with the
    group of their own text, and an empty table gives an empty result. Long texts take some 30 bytes a byte in their task.

    The last join has one row for each fingerprint on one side. Copies of a fingerprint beyond `crowd` go to as many
    more keys as they need, by their doc_id, so that a text with very many copies is no hot key.
    """
    own = written(fingerprints(docs, width), "fp")
    nodes = written(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    edges = written(links(nodes.select("fp", F.col("fp").alias("node")), most).distinct(), "links")
    ends = written(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links")), "ends")
    groups = _least_ids(components(ends.select("node"), edges), nodes.select(F.col("fp").alias("node"), "least"))
    found = nodes.join(groups.join(ends, "node").withColumnRenamed("node", "fp"), "fp", "left")
    found = found.select("fp", "copies", F.coalesce("least_id", "least").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    result = _attached(own, written(found, "groups"), crowd)
    alone = own.where("doc_id IS NULL").select("doc_id", digits, F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return result.select("doc_id", digits, F.col("component").alias("component_id"), "n_links").union(alone)


# --- documents that share most of their shingles -----------------------------------------------------------------------

_PROPOSING = 2  # words of the shingles behind the longer fingerprints: word edits turn fewer of their bits


def _digests(words: Words) -> list[bytes]:
    """MD5 of each text's words joined by spaces."""
    data, first = words.data.tobytes(), words.first.tolist()
    start, end = words.start.tolist(), words.end.tolist()
    return [hashlib.md5(data[start[a] : end[z - 1]] if z > a else b"").digest() for a, z in zip(first, first[1:])]


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words, and how many each text has; shorter texts are one, those without words have none."""
    hashes = words.hashes()
    count = np.where(words.count < width, np.minimum(words.count, 1), words.count - width + 1)
    grams = np.zeros(int(count.sum()), np.uint64)
    first, base = words.first[:-1], np.cumsum(count) - count
    long = words.count >= width
    every = word_grams(hashes, width)
    at = np.arange(int(count[long].sum())) + np.repeat(first[long] - (np.cumsum(count[long]) - count[long]), count[long])
    grams[np.repeat(long, count)] = every[at]
    for i in np.flatnonzero(~long & (count > 0)).tolist():
        grams[base[i]] = word_grams(hashes[first[i] : first[i] + words.count[i]], int(words.count[i]))[0]
    return grams, count


def _sketch(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1_000_000):
        words = words_of(text_bytes(batch.column("text")), lower=True)
        grams, count = _shingles(words, _PROPOSING)
        full, columns, digests = count > 0, [], _digests(words)
        for j in range(parts):
            out = np.zeros(len(count), np.uint64)
            if len(grams):
                out[full] = np.packbits(2 * _ones(mix(grams + np.uint64(j)), count[full]) > count[full][:, None], axis=1).view(">u8").ravel()
            columns.append(pa.array(out.view(np.int64)))
        name = pa.array(np.frombuffer(b"".join(digests), np.int64)[::2])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), name, *columns], names=["doc_id", "mark", "digest", "node", *(f"f{j}" for j in range(parts))])


def _met(nodes: DataFrame, parts: int, most: int) -> DataFrame:
    """(node, least) for each anchor that a node visits and some other one with a lesser name too; repeated pairs stay.

    Visits are dealt by anchor once, and sorted, in one kind of plan at every size. Few anchors have several visitors, so
    counting them would hold nearly all visits of a task; tasks have some `most` visits each instead, however large the
    table is and however few files it comes in.
    """
    tasks = max(1, -(-nodes.count() * 34 * parts // most))  # 17 visits a half
    each = nodes.repartition(tasks, "node").select("node", F.posexplode(F.array(*(F.col(f"f{j}") for j in range(parts)))).alias("print", "fp"))
    at = visits(each).select("node", ((F.col("print") * 2 + F.col("half")).cast("long") * (1 << 32) + F.col("anchor")).alias("at"))
    least = F.min("node").over(Window.partitionBy("at"))
    return at.repartition(tasks, "at").select("node", least.alias("least")).where("node <> least")


def proposed(nodes: DataFrame, parts: int, most: int = 1_000_000) -> DataFrame:
    """Pairs (node, least): each node of (node, f0, ...) with the least node of each anchor that both visit.

    An anchor proposes one pair for each of its visitors, not all pairs of them.
    """
    return _met(nodes, parts, most).distinct()


def nearest(nodes: DataFrame, parts: int, most: int = 1_000_000) -> DataFrame:
    """Of the pairs that `proposed` has, for each node the one that most anchors propose; of several the least.

    Strangers meet at one anchor, the more of them the larger the table; texts alike meet at many. So there is one pair a
    node at most, whatever the size.
    """
    times = _met(nodes, parts, most).groupBy("node", "least").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("node").agg(F.min_by("least", F.struct(-F.col("times"), "least")).alias("least"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, parts: int = 4, most_apart: float = 0.22) -> DataFrame:
    """(doc_id, mark, component_id, component_mark): the least doc_id that links reach, a link being a Jaccard similarity of
    the sets of `width`-word shingles of at least `similarity`, A-Z lower-cased; mark is xxhash64 of the text, and
    component_mark the least mark of the group's texts under component_id, which tells rows of one id apart.

    Texts with equal words are one node, named by 64 bits of their digest; texts of fewer words are one shingle, those
    without words, and null, one node. Pairs come from fingerprints of `parts` times 64 bits over two-word shingles, at
    the anchors of each half: each document is proposed with the one that it shares most anchors with, and dropped where
    more than `most_apart` of all bits differ. Proposed pairs are linked exactly when their shingles say so. Fingerprints
    alone miss some pairs, so the prefix join, which checks the proposals on its sets, finds all links between documents
    that these haven't connected; `similarity` is in whole hundredths. Crowds of copies compare few shingles.
    Rows without doc_id are left out, rows that repeat one come back each, with the group of their own text. Long texts
    take some 50 bytes a byte in their task.
    """
    from .prefix_join import linked_sets  # it builds on this module

    per_cent = round(100 * similarity)
    if abs(100 * similarity - per_cent) > 1e-9:
        raise ValueError("similarity must be a whole number of hundredths")
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, digest binary, node long, " + ", ".join(f"f{j} long" for j in range(parts))
    sketches = written(own.mapInArrow(lambda batches: _sketch(batches, parts), schema), "sketches")
    nodes = sketches.groupBy("digest").agg(F.first("node").alias("node"), F.min(F.struct("doc_id", "mark")).alias("first"), *(F.first(f"f{j}").alias(f"f{j}") for j in range(parts)))
    nodes = written(nodes, "nodes")
    # Strangers that met at an anchor differ in far more of all bits than texts at the similarity do.
    prints = nodes.select("node", F.col("digest").alias("a"), F.array(*(F.col(f"f{j}") for j in range(parts))).alias("own"))
    others = prints.select(F.col("node").alias("least"), F.col("a").alias("b"), F.col("own").alias("other"))
    apart = F.aggregate(F.zip_with("own", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    near = nearest(nodes, parts).join(prints, "node").join(others, "least").where(apart <= int(most_apart * 64 * parts))
    linked = linked_sets(own.select("doc_id", "text"), width, per_cent, written(near.select("a", "b"), "near"))[-1]
    found = nodes.join(linked, "digest", "left").select("digest", F.coalesce("component_id", "first.doc_id").alias("component_id"), F.coalesce("component_mark", "first.mark").alias("component_mark"))
    return sketches.select("doc_id", "mark", "digest").join(found, "digest").select("doc_id", "mark", "component_id", "component_mark")
