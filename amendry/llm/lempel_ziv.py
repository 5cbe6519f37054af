"""Substring dedup by relative Lempel-Ziv parsing, in words.

Method. The corpus is a reference cut into blocks by content, one for each string of 12 words that can matter;
`windows` routes the pieces of every document to the blocks that can hold a match, and whole segments that are equal
count once, with their least document. In a block, each document's piece is factored greedily against the pieces of all
earlier documents, which an index of `size`-word strings makes searchable. A factor of `size` words or more is a
duplicate span. Parsing resumes `size` - 1 words before a factor's end, so windows over factor boundaries are checked too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .windows import Windows, cut_documents

WORDS = Windows("words", 13, 5, 2)


class ReferenceBlock:
    """Words of earlier documents and where each string of `size` words first starts among them."""

    def __init__(self, size: int):
        self.size, self.words, self.index = size, [], {}

    def add(self, words: list[bytes]) -> None:
        base = len(self.words)
        self.words += [*words, None]  # no match goes on past a piece
        for i in range(len(words) - self.size + 1):
            self.index.setdefault(tuple(words[i : i + self.size]), base + i)

    def factors(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, length) of greedy factors of at least `size` words; words between them are literals."""
        out, i, reference = [], 0, self.words
        while i + self.size <= len(words):
            at = self.index.get(tuple(words[i : i + self.size]))
            if at is None:
                i += 1
                continue
            length = self.size
            while i + length < len(words) and reference[at + length] == words[i + length]:
                length += 1
            out.append((i, length))
            i += length - self.size + 1
        return out


def parse_block(pieces: list[tuple[int, bytes, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Factor each piece (document, words, ..) against those of smaller documents; pieces come in order of documents."""
    block, out, waiting = ReferenceBlock(size), [], []
    for i, (doc, text, *_) in enumerate(pieces):
        if waiting and waiting[0][0] != doc:
            for _, words in waiting:
                block.add(words)
            waiting = []
        words = text.split(b" ")
        out += [(i, start, length) for start, length in block.factors(words)]
        waiting.append((doc, words))
    return out


def remove_repeated_windows(docs: DataFrame, windows: Windows = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of each document after cutting repeated windows of words.

    A word goes when a window of 13 words that covers it also starts in a document with a smaller doc_id. Null and
    short texts have nothing to cut. Rows come back one for one; rows that share a doc_id don't cover each other, and
    each loses what its own text repeats; rows without one keep everything. Long texts are worked through in parts.
    """
    return cut_documents(docs, windows, parse_block, keep=False).withColumnRenamed("n_units", "n_words")


def without_repeated_windows(docs: DataFrame, windows: Windows = WORDS) -> DataFrame:
    """The documents with repeated words cut from `text`; other columns stay, whatever their names, and so do documents
    left empty. Rows as in `remove_repeated_windows`; null texts stay null."""
    return cut_documents(docs, windows, parse_block, keep=True)
