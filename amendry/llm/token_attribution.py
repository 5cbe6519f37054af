"""Token counts of a document's sections, from one encoding of the whole document.

Method: offset-mapped attribution. Each document is encoded once; the tokens' byte lengths give their character
spans; these are interval-joined to the sections' spans, and tokens that cross a border are allocated by a rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import KEPT, slices

RULES = ("first", "last", "most", "share")
OUTSIDE = -1


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    """The tokenizer of a rank file and each token's length in bytes; once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


KEPT["token-attribution"] = _tokenizer.cache_clear


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of each token; a token with part of a character spans that character."""
    encoding, sizes = _tokenizer(path, pattern)
    length = sizes[np.array(encoding.encode_ordinary(text), np.int64)]
    end = np.cumsum(length)
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80)  # of each byte, from 1
    return character[end - length] - 1, character[end - 1]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines, each with its line end; an empty text is one empty line."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return np.concatenate(([0], ends[:-1])), ends


def attribute(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens [start, end) of sections [low, high): counts, crossing tokens of each section, and tokens outside all.

    A token that meets one section only belongs to it. Of one that meets several, the rule "first" gives all to the
    first, "last" to the last, "most" to the one that holds most of its characters (the earlier on a tie), and
    "share" divides it by its characters.
    """
    n = len(low)
    count, crossing = np.zeros(n), np.zeros(n, np.int64)
    first, last = np.searchsorted(high, start, "right"), np.searchsorted(low, end, "left") - 1
    meets = first <= last
    one = meets & (first == last)
    count += np.bincount(first[one], minlength=n)[:n]
    for t in np.flatnonzero(meets & ~one).tolist():
        among = np.arange(first[t], last[t] + 1)
        held = np.minimum(high[among], end[t]) - np.maximum(low[among], start[t])
        among, held = among[held > 0], held[held > 0]
        crossing[among] += len(among) > 1
        if rule == "share":
            count[among] += held / held.sum()
        else:
            count[among[{"first": 0, "last": -1, "most": int(held.argmax())}[rule]]] += 1
    return count, crossing, float((~meets).sum())


def in_order(spans: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of sections by their starts; what an earlier one holds isn't part of a later one."""
    pairs = [(x["start"], x["end"], i) for i, x in enumerate(spans) if x and x["start"] is not None and x["end"] is not None]
    low, high, number = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
    reach = np.maximum.accumulate(np.maximum(high, low))
    low = np.maximum(low, np.concatenate(([0], reach[:-1])))[: len(low)]
    return number, low, np.maximum(high, low)


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "most", sections: str | None = None) -> DataFrame:
    """doc_id, section_no, char_start, char_end, n_tokens (double) and n_crossing of each section of each document.

    `sections` names a column array<struct<start:int,end:int>> of character spans, numbered as they stand there; they
    are taken by their starts, a later one begins where an earlier one ends, and those with a null bound are left out.
    Without it each line with its line end is a section. Tokens outside all sections come as section -1, if any.
    Null texts count as empty: one empty section without tokens. Null or absent sections leave all tokens outside.
    Counts of a document's rows sum to its tokens, whatever the rule. Rows that repeat a doc_id come back each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", owner="token-attribution"):
            spans = batch.column("sections").to_pylist() if sections else [None] * batch.num_rows
            parts: list[tuple] = []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans):
                text = text or ""
                if sections:
                    order, low, high = in_order(own or [])
                else:
                    low, high = line_spans(text)
                    order = np.arange(len(low))
                count, crossing, outside = attribute(*token_spans(text, path, pattern), low, high, rule) if text else (np.zeros(len(low)), np.zeros(len(low), np.int64), 0.0)
                number = order
                if outside or not len(low):
                    number, low, high = np.append(number, OUTSIDE), np.append(low, 0), np.append(high, len(text))
                    count, crossing = np.append(count, outside), np.append(crossing, 0)
                parts.append((doc, number, low, high, count, crossing))
            rows = [len(x[1]) for x in parts]
            docs_of = pa.array([x[0] for x in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), rows)))
            names = ("section_no", "char_start", "char_end", "n_tokens", "n_crossing")
            yield pa.RecordBatch.from_pydict({"doc_id": docs_of} | {name: np.concatenate([x[i + 1] for x in parts]) for i, name in enumerate(names)})

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")] + ([F.col(sections).alias("sections")] if sections else [])
    return docs.select(*columns).mapInArrow(run, "doc_id long, section_no long, char_start long, char_end long, n_tokens double, n_crossing long")
