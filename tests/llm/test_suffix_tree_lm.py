import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from amendry.llm.suffix_tree_lm import score_texts

from .cases import SCHEMA, by_id, documents, fold, words


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


OPTIONS = {"smoothing": 5.0}


def tokens(text):
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.mark.parametrize("common_share", [2e-6, 1 / 200])
def test_base_score_matches_brute_force(spark, common_share):
    """Also when most words count as tail, which a join resolves."""
    rows = [r for r in documents() if r[0] is not None]
    found = by_id(score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3), held_out(), common_share=common_share, **OPTIONS))
    counts = Counter(t for r in rows if fold(r[0], 10) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own, got = tokens(r[1]), found[r[0]]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (fold(r[0], 10) == 0, len(own), sum(counts[t] > 0 for t in own), n)
        want = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert got.base_score == pytest.approx(want, rel=1e-9)
        assert got.score < 0


def test_scores_do_not_depend_on_where_counts_are_looked_up(spark):
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    one, two = (by_id(score_texts(df, held_out(), common_share=s, **OPTIONS)) for s in (2e-6, 1 / 200))
    assert all(one[d].score == pytest.approx(two[d].score, rel=1e-9) for d in one)


def test_odd_tables(spark):
    df = spark.createDataFrame([(10, None), (10, None), (3, "a"), (None, "a a")], "doc_id long, text string")
    none = score_texts(df, F.lit(True)).collect()
    assert len(none) == 4 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
    assert score_texts(df.limit(0), held_out()).count() == 0
    assert sorted(r.n_tokens for r in score_texts(df, held_out()).collect()) == [1, 1, 2, 3]


def plain_model(texts, least, s, strength=3.0, depth=3):
    """log10 of the probability of each next word by explicit contexts."""
    seqs = [["<s>", *tokens(t)] for t in texts]
    grams = Counter(tuple(q[i : i + m]) for q in seqs for m in range(1, depth + 2) for i in range(len(q) - m + 1))
    count = Counter({g[0]: k for g, k in grams.items() if len(g) == 1 and g[0] != "<s>"})
    n, v = sum(count.values()), len(count)
    after = {}
    for g, k in grams.items():
        if len(g) > 1 and k >= least:
            after.setdefault(g[:-1], {})[g[-1]] = k
    kept = {}

    def p(context, x):
        for i in range(len(context)):
            if context[i:] in kept:
                free, total = kept[context[i:]]
                return (after[context[i:]].get(x, 0) + free * p(context[i + 1 :], x)) / (total + s)
        return (count[x] + 0.1) / (n + 0.1 * (v + 1))

    for c in sorted(after, key=len):
        total, own = grams[c], after[c]
        rest, base = total - sum(own.values()), {x: p(c[1:], x) for x in own}
        g = 2 * sum(k * math.log(k / (total * base[x])) for x, k in own.items())
        g += 2 * rest * math.log(rest / (total * max(1e-12, 1 - sum(base.values())))) if rest else 0
        if g >= strength * (len(own) + (rest > 0)):
            kept[c] = (s + rest, total)
    return p, kept


@pytest.mark.parametrize("common_share, looked_up", [(2e-6, 2_000_000), (1 / 50, 5)])
def test_contexts_count_by_absolute_numbers(spark, common_share, looked_up):
    """A phrase seen eight times in a corpus of which it is a vanishing share is learned; scores equal plain ones."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(i, 400)}" for i in rng.zipf(1.3, 400)) for _ in range(60)] + [f"x{i} quick brown fox jumps" for i in range(8)] + ["quick brown cat", None]
    texts += [f"{a} b c {x}" for a, x in (("one", "d"), ("two", "e")) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    p, kept = plain_model(texts, 5, 5.0)
    assert ("brown",) in kept and ("one", "b", "c") in kept and max(map(len, kept)) == 3
    for r in score_texts(df, F.lit(False), common_share=common_share, looked_up=looked_up, words_looked_up=looked_up, smoothing=5.0).collect():
        own = ["<s>", *tokens(texts[r.doc_id])]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(own[max(0, i - 3) : i]), own[i])) for i in range(1, len(own))), rel=1e-9)
    assert sum(p(("one", "b", "c"), x) for x in {t for q in texts for t in tokens(q)}) + p(("one", "b", "c"), "?") == pytest.approx(1)


def test_rare_grams_travel_packed(spark, monkeypatch):
    """Rows of a batch of texts for each bucket, not one for each gram of each text; sums by text are whole."""
    from amendry.llm import suffix_tree_lm as S

    monkeypatch.setattr(S, "_BUCKET", 500)
    made, keep = [], S._added
    monkeypatch.setattr(S, "_added", lambda parts, values, buckets: (made.append((parts, buckets)), keep(parts, values, buckets))[1])
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"w{i}" for i in rng.integers(0, 60, 4)) for _ in range(40)]
    texts = [" ".join(phrases[i] for i in rng.integers(0, 40, 15)) for _ in range(90)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    few, all_ = (by_id(score_texts(df, F.lit(False), common_share=s, looked_up=k, **OPTIONS)) for s, k in ((1.0, 5), (2e-6, 2_000_000)))
    assert set(few) == set(range(92)) and all(few[d].score == pytest.approx(all_[d].score, rel=1e-9) for d in few)
    parts, buckets = made[0]
    asked = parts.where("bucket IS NOT NULL").agg(F.count("*").alias("rows"), F.sum(F.octet_length("keys") / 8).alias("grams")).first()
    assert buckets > 8 and parts.where("bucket IS NULL").count() == 92 and asked["rows"] <= 3 * buckets < asked.grams / 10


def test_counts_travel_packed_by_context():
    """Far less than two hashes a gram is sent, a hot context goes to many buckets, and counts are exact."""
    import pyarrow as pa

    from amendry.llm import suffix_tree_lm as S

    class Shared:
        value = None

    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 3000) % 300) for _ in range(40)] + ["", None]
    token, doc = S.tokens_of([(t or "").encode() for t in texts])
    _, grams = S.grams_of(token, doc, 2)
    key, fine = grams[1]
    want = {k: n for k, n in Counter(key[fine].tolist()).items() if n >= 5}
    hot = np.array([Counter(token.tolist()).most_common(1)[0][0]], np.uint64)
    Shared.value = np.full(1 << 20, ~np.uint64(0)), hot
    sent = [r for part in (texts[::2], texts[1::2]) for r in S._count_grams(Shared, 2, 8)(iter([pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())})]))]
    rows = pa.Table.from_batches(sent).sort_by("bucket")
    holders = {r["bucket"] for r in rows.to_pylist() if hot[0] in np.frombuffer(r["contexts"], np.uint64)}
    assert len(holders) == 8
    size = sum(len(v) for r in rows.to_pylist() for k, v in r.items() if k != "bucket")
    assert size < 10 * len(set(key[fine].tolist()))
    found = [r for b in S._frequent_grams(5)(iter(rows.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert {r["key"] % 2**64: r["n"] for r in found} == want and len(found) == len(want)
    again = S._key(*(np.array([r[x] for r in found], np.int64).view(np.uint64) for x in ("context", "suffix")))
    assert again.tolist() == [r["key"] % 2**64 for r in found]
