import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from amendry.llm.byte_bpe import Decoder, Encoder, Merges, Transducer, encode_and_decode, encoder, read_ranks

from .cases import SCHEMA, by_id, documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_match_the_library(spark, library):
    rows = documents() + [(7000, "<|endoftext|> a\r\n\r\n  b ''s 'S 12345 ½ " * 3, "en", "s", 1, 0, 0), (7001, "x" * 3000, "en", "s", 1, 0, 0)]
    found = by_id(encode_and_decode(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, P.PATTERN, keep_ids=True))
    for doc, text, *_ in rows:
        if doc is None:
            continue
        ids = library.encode_ordinary(text or "")
        r = found[doc]
        assert r.ids == ids and r.n_tokens == len(ids) and r.utf8
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_and_decode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0


def test_transducer_equals_merging_and_restarts():
    ranks = {bytes([c]): c - 97 for c in range(97, 100)} | {b"ab": 3, b"bc": 4, b"aa": 5, b"abc": 6, b"aab": 7, b"aaaa": 8}
    merges, machine = Merges(ranks), Transducer(ranks, most_states=5)
    rng = np.random.default_rng(0)
    for _ in range(500):
        text = bytes(rng.integers(97, 100, rng.integers(0, 15)).astype(np.uint8))
        assert machine.encode(text) == [ranks[x] for x in merges.encode(text)]


def test_tokens_that_may_follow_are_those_that_merging_keeps_apart():
    ranks = read_ranks(PATH)
    machine, merges, rng = Transducer(ranks), Merges(ranks), np.random.default_rng(2)
    tokens, few = sorted(ranks), [t for t in ranks if len(t) < 4 and t.isalpha()]
    pairs = [(x[i], x[j]) for x in (tokens, few) for i, j in rng.integers(0, len(x), (4000, 2))]
    assert all(machine._may_follow(ranks[a], ranks[b]) == (merges.encode(a + b) == [a, b]) for a, b in pairs)
    odd = Transducer({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"cab": 6, b"bcab": 7})  # bcab comes from bc and ab, cab from c and ab
    assert all(odd._may_follow(odd.ranks[a], odd.ranks[b]) == (odd.merges.encode(a + b) == [a, b]) for a in odd.ranks for b in odd.ranks)


def test_the_machine_keeps_one_table_of_moves():
    machine = Transducer(read_ranks(PATH))
    machine.encode(b" tothnttition")
    assert machine.moves and not any(isinstance(x, dict) for x in machine.moves.values())
    text = "erblely 漢 🎉"
    own = encoder(PATH, P.PATTERN)
    assert np.frombuffer(own.packed(text), "<u4").tolist() == own.encode(text)


def test_matches_are_remembered_for_a_while(library):
    own = Encoder(PATH, P.PATTERN, most_known=6)
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B's", " ", "  ", "\n", "\u3000", "\xa0 ", "é", "漢 ", "12", "½", "...", "'ll", "\x85", "\x1c ", "🎉 x"], rng.integers(0, 30)))
        assert own.encode(text) == library.encode_ordinary(text)
    assert len(own.known) + len(own.before) < 10


def test_decoding_is_incremental():
    decoder = Decoder(read_ranks(PATH))
    text = "aé漢🎉 z"
    ids = encoder(PATH, P.PATTERN).encode(text)
    pieces = list(decoder.stream(iter(ids)))
    assert "".join(pieces) == text and len(pieces) > 3
    one_byte = {decoder.token[i]: i for i in range(len(decoder.token)) if len(decoder.token[i]) == 1}
    split = [one_byte[bytes([b])] for b in "🎉".encode()]
    assert list(decoder.stream(iter(split))) == ["🎉"] and list(decoder.pieces(split)) == [("🎉".encode(), True)]
    assert list(decoder.pieces([*ids, *split, *ids])) == [*decoder.pieces(ids), ("🎉".encode(), True), *decoder.pieces(ids)]
    for bad in (split[:3], [split[1]], [split[0], one_byte[b"a"]], [one_byte[b"\xed"], one_byte[b"\xa0"], one_byte[b"\x80"]]):
        digest, fine = decoder.digest(np.array([*ids, *bad]))
        assert not fine and digest == hashlib.sha256(text.encode() + b"".join(decoder.token[i] for i in bad)).hexdigest()
        with pytest.raises(ValueError):
            list(decoder.stream(iter(bad)))
