"""Places where a user's encoder, tokenizer, scorer or generator enters; each has a plain default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashed_ngrams(texts: list[str], dim: int = 256, n: int = 3) -> np.ndarray:
    """Counts of hashed character n-grams; no dependency, the same on every machine."""
    out = np.zeros((len(texts), dim), np.float32)
    weights = np.array([131**i for i in range(n)], np.int64)
    for row, text in zip(out, texts):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(points) >= n:
            grams = np.lib.stride_tricks.sliding_window_view(points, n) @ weights
            np.add.at(row, grams % dim, 1)
    return out


def ngram_vectors(texts: DataFrame, dim: int = 0, n: int = 3, buckets: int = 256, prefix: str = "", normalize: bool = True) -> DataFrame:
    """(text, vec) as `encode_texts` with `hashed_ngrams` gives, in expressions: characters to n-grams to buckets, counted
    by text and bucket. The counts travel under a digest of the text; the text itself is shuffled once, to be distinct."""
    own = texts.select("text").distinct().withColumn("_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    codes = F.transform(F.split(F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))), ""), lambda c: F.ascii(c).cast("long"))
    chars = own.select("_id", F.explode(F.array(codes)).alias("c")).where(F.size("c") >= n)
    gram = lambda i: sum((F.get(F.col("c"), i + k) * 131**k for k in range(1, n)), F.get(F.col("c"), i))
    placed = chars.select("_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - n), lambda i: (gram(i) % buckets).cast("int"))).alias("bucket"))
    counts = placed.groupBy("_id", "bucket").agg(F.count(F.lit(1)).alias("x"))
    found = counts.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("x").cast("double")))).alias("m"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit((dim or buckets) - 1)), lambda b: F.coalesce(F.element_at(m, b), F.lit(0.0)))
    vec = dense(F.coalesce("m", F.expr("cast(map() as map<int,double>)")))
    df = own.join(found, "_id", "left").select("text", vec.alias("vec"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    if normalize:
        df = df.withColumn("_size", size).withColumn("vec", F.when(F.col("_size") > 0, F.transform("vec", lambda x: x / F.col("_size"))).otherwise(F.col("vec"))).drop("_size")
    return df.withColumn("vec", F.col("vec").cast("array<float>"))


def encode_texts(texts: DataFrame, encoder: Encoder | None = None, prefix: str = "", dim: int = 0, normalize: bool = True) -> DataFrame:
    """(text, vec) of each distinct text, encoded once; `dim` keeps the first numbers before scaling to length 1.

    Without an encoder of the user's, counts of hashed character n-grams, which need no Python.
    """
    if encoder is None:
        return ngram_vectors(texts, dim, prefix=prefix, normalize=normalize)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encoder([prefix + (t or "") for t in batch["text"]]), np.float32).reshape(len(batch), -1)
            vectors = vectors[:, :dim] if dim else vectors
            if normalize:
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(size > 0, size, 1)
            yield pd.DataFrame({"text": batch["text"], "vec": list(vectors)})

    return texts.select("text").distinct().mapInPandas(run, "text string, vec array<float>")


def attach_vectors(pref: DataFrame, vectors: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Join each text column with its vector, on a digest and the text."""
    df = pref
    for text, name in columns.items():
        side = vectors.select(F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"), F.col("vec").alias(name))
        df = df.join(side, (F.xxhash64(text) == F.col("_hash")) & (F.col(text) == F.col("_text")), "left").drop("_hash", "_text")
    return df


def token_count(base: str, cand: str) -> Column:
    """Stand-in for a tokenizer's joint count: code points of both texts, an upper estimate for most scripts."""
    return F.length(base) + F.length(cand)


def fits_tokens(items: DataFrame, most: int = 512, count: Callable[[str, str], int] | None = None) -> DataFrame:
    """Items all of whose candidates fit with the base; `count` is a user's tokenizer, run in Arrow batches."""
    if count is None:
        return items.where(F.forall("candidates", lambda c: F.length("base_text") + F.length(c["text"]) <= most))

    @F.pandas_udf("boolean")
    def fits(base: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([all(count(b, t) <= most for t in own) for b, own in zip(base, texts)])

    return items.where(fits("base_text", F.transform("candidates", lambda c: c["text"])))


def generate(prompts: DataFrame, generator: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """Adds `generated`, from a user's function over batches of prompts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(generator(texts.tolist()))

    return prompts.withColumn("generated", run(prompt))


def score(df: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | Column, source: str = "source_text", candidate: str = "candidate") -> DataFrame:
    """Adds `score`, from a Column (linear weights) or a user's function over batches."""
    if isinstance(scorer, Column):
        return df.withColumn("score", scorer)

    @F.pandas_udf("double")
    def run(sources: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series(scorer(sources.tolist(), candidates.tolist()), dtype=float)

    return df.withColumn("score", run(source, candidate))


def mean_pool(tokens: DataFrame, by: str = "text_id", vector: str = "vec", mask: str = "mask") -> DataFrame:
    """(by, vec): masked mean of token vectors; an all-masked text gives zeros."""
    flat = tokens.select(by, F.posexplode(vector).alias("pos", "x"), F.col(mask).cast("double").alias("m"))
    means = flat.groupBy(by, "pos").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-6))).alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
