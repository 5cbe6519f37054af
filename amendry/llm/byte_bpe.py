"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine.

Method. A token may follow another in a BPE encoding exactly if encoding both tokens' bytes together gives these
two tokens; a row of tokens is the encoding of its bytes exactly if all its neighbours are such pairs. That makes
encoding a finite relation: a nondeterministic transducer whose states are (last token, bytes of the next one so
far). It is determinised lazily, as weighted subsets are: a state of the deterministic machine is the set of states
still alive, each with the tokens it has not emitted yet; on a byte the machine moves every member on and emits the
tokens that all members agree on. So tokens leave after a bounded lookahead, the longest token's bytes at most past
the point where other readings die out. Transitions are kept when first used; when there are too many, the machine
starts again from an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import KEPT, slices


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Merges:
    """The merge rules of a rank file, for short byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, text: bytes, least_parts: int = 1) -> list[bytes]:
        """Merge the pair of least rank, leftmost first, until none is left or there are only `least_parts` parts."""
        rank, none = self.ranks.get, 1 << 60
        parts = [text[i : i + 1] for i in range(len(text))]
        pairs = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while len(parts) > least_parts and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts


class Transducer:
    """Bytes in, tokens out."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks, self.merges, self.most_states = ranks, Merges(ranks), most_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: The tree of all tokens: (node * 256 + byte) -> node, the rank of the token that a node spells, nodes with more below.
        self.below: dict[int, int] = {}
        self.rank_at: list[int | None] = [None]
        self.inner: set[int] = set()
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                edge = node << 8 | byte
                node = self.below.get(edge) or self.below.setdefault(edge, len(self.rank_at))
                if node == len(self.rank_at):
                    self.rank_at.append(None)
            self.rank_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int | None, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        #: A state's members: (last token or None, node of the next token so far, tokens not emitted).
        self.numbers: dict[tuple, int] = {}
        self.members: list[tuple] = []
        #: state * 256 + byte -> next state and what is emitted; one table, since small ones by state fill the memory.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._number(((None, 0, ()),))

    def _number(self, members: tuple) -> int:
        number = self.numbers.setdefault(members, len(self.members))
        if number == len(self.members):
            self.members.append(members)
        return number

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from, twice itself for a byte; None if merging doesn't make it."""
        if token not in self.halves:
            parts = self.merges.encode(self.bytes_of[token], 2)
            made = len(parts) == 1 or len(parts) == 2 and self.merges.encode(self.bytes_of[token]) == [self.bytes_of[token]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]]) if made else None
        return self.halves[token]

    def _apart(self, last: int, token: int) -> bool:
        """Whether merging never joins what lies on both sides of the border between two tokens.

        The last merge of the higher of both ranks is undone in turn, down to the bytes at the border; before it is done,
        a pair across the border of a lesser rank would have been merged.
        """
        limit, rank, bytes_of = 1 << 60, self.ranks.get, self.bytes_of
        while True:
            if rank(bytes_of[last] + bytes_of[token], limit) < limit:
                return False
            left, right = self.halves[last] if last in self.halves else self._halves(last), self.halves[token] if token in self.halves else self._halves(token)
            if (last > token or right[0] == token) and left[1] != last:
                limit, last = last, left[1]
            elif right[0] != token:
                limit, token = token + 1, right[0]
            else:
                return True

    def _may_follow(self, last: int | None, token: int) -> bool:
        key = (last, token)
        if key not in self.follows:
            if len(self.follows) > 4 * self.most_states:
                self.follows.clear()
            made = self._halves(token) is not None and (last is None or self._halves(last) is not None)
            self.follows[key] = made and (last is None or self._apart(last, token))
        return self.follows[key]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after, below, follows = [], self.below.get, self.follows.get
        for last, node, pending in self.members[state]:
            node = below(node << 8 | byte)
            if node is None:
                continue
            if node in self.inner:
                after.append((last, node, pending))
            token = self.rank_at[node]
            if token is not None:
                fits = follows((last, token))
                if fits if fits is not None else self._may_follow(last, token):
                    after.append((token, 0, (*pending, token)))
        pendings = [x[2] for x in after]
        common, least, most = 0, min(pendings), max(pendings)
        while common < len(least) and least[common] == most[common]:
            common += 1
        emitted = least[:common]
        move = self._number(tuple((last, node, p[common:]) for last, node, p in after) if common else tuple(after)), emitted
        self.moves[state << 8 | byte] = move
        return move

    def encode(self, text: bytes) -> list[int]:
        if len(self.members) > self.most_states:
            self._restart()
        state, out, moves = self.start, [], self.moves.get
        for byte in text:
            move = moves(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        for _, node, pending in self.members[state]:
            if not node:
                return out + list(pending)
        raise ValueError("the ranks lack a single byte of the text")


#: Incremental UTF-8: state -> {class of byte -> next state}. States: 0 between characters; 1 to 3 that many free
#: continuation bytes left; the others restrict the next byte (no overlong forms, surrogates or code points past the last).
_UTF8_NEXT = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
_BAD = 8


class Decoder:
    """Token ids in, bytes out, piece by piece: bytes are released up to the last whole character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        step = [[_BAD] * 256 for _ in range(_BAD + 1)]
        for state, rows in _UTF8_NEXT.items():
            for low, high, after in rows:
                step[state][low : high + 1] = [after] * (high - low + 1)
        self.step = step
        #: Ids that read from between characters to between characters; the machine need not look inside them.
        self.whole = np.array([bool(t) and self.state_after(0, t) == 0 for t in self.token], bool)

    def state_after(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.step[state][byte]
        return state

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def pieces(self, ids: np.ndarray) -> Iterator[tuple[bytes, bool]]:
        """(bytes, whether they are whole characters) in order: rows of tokens that end between characters at once, the
        others as soon as the machine is between characters again. After a byte that fits nowhere all follows as it is.
        """
        ids, at, n = np.asarray(ids, np.int64), 0, len(ids)
        odd = np.flatnonzero(~self.whole[ids]).tolist() + [n]
        for i in odd:
            if i < at:
                continue  # taken with the character before
            if i > at:
                yield self.bytes_of(ids[at:i]), True
            at, state, held = i, 0, b""
            while at < n:
                data = self.token[ids[at]]
                state, held, at = self.state_after(state, data), held + data, at + 1
                if state == _BAD:
                    yield held + self.bytes_of(ids[at:]), False
                    return
                if state == 0:
                    break
            if held:
                yield held, state == 0

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text of each id as soon as its last character is complete; ValueError where the bytes aren't UTF-8."""
        state, held = 0, b""
        for i in ids:
            data = self.token[i]
            state = 0 if state == 0 and self.whole[i] else self.state_after(state, data)
            held += data
            if state == _BAD:
                raise ValueError("the ids don't decode to UTF-8")
            if state == 0:
                yield held.decode()
                held = b""
        if held:
            raise ValueError("the ids end inside a character")

    def digest(self, ids: np.ndarray) -> tuple[str, bool]:
        """SHA-256 of the decoded bytes, taken piece by piece, and whether they are whole characters."""
        total, fine = hashlib.sha256(), True
        for piece, whole in self.pieces(ids):
            total.update(piece)
            fine &= whole
        return total.hexdigest(), fine


class Encoder:
    """Splits text by the pattern and encodes each match by the transducer; recent matches are remembered."""

    def __init__(self, path: str, pattern: str, most_known: int = 300_000):
        ranks = read_ranks(path)
        self.find, self.transducer, self.decoder = regex.compile(pattern).findall, Transducer(ranks), Decoder(ranks)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # of the matches before those in `known`
        self.most_known = most_known

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        matches = self.find(text)
        found = list(map(self.known.get, matches))
        if None in found:
            found = [self._missed(match) if ids is None else ids for match, ids in zip(matches, found)]
        return b"".join(found)

    def _missed(self, match: str) -> bytes:
        """Ids of a match that wasn't in `known`; when too many are, those that don't come again are let go."""
        ids = self.known.get(match) or self.before.get(match)
        if ids is None:
            ids = array("I", self.transducer.encode(match.encode())).tobytes()
        if len(match) <= 64:
            if len(self.known) > self.most_known // 2:
                self.before, self.known = self.known, {}
            self.known[match] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)


KEPT["byte-bpe"] = encoder.cache_clear


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and utf8 (the ids decode to whole characters) of each whole text.

    Null and empty texts have no tokens; hashes are those of the empty string. Rows come back one for one, repeated
    rows too. `path` is a rank file that every executor can open and `pattern` splits the text before the merges;
    special tokens are ordinary text. With `keep_ids` the ids follow as `ids`, an array of int.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, "text", owner="byte-bpe"):
            gc.disable()  # the tables hold no cycles, and going through them again and again costs a fifth of the time
            try:
                each = [own.packed(text or "") for text in batch.column("text").to_pylist()]
            finally:
                gc.enable()
            arrays = [np.frombuffer(x, "<u4") for x in each]
            decoded = [own.decoder.digest(x) for x in arrays]
            out = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) for x in arrays], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in each],
                "decoded_sha256": [x[0] for x in decoded], "utf8": [x[1] for x in decoded],
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([x.view("<i4") for x in arrays], pa.list_(pa.int32()))} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, utf8 boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
