"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest

from infosieve.llm import queries, rank_bpe
from infosieve.llm.common import table

from .helpers import EDGES, SF, documents

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return rank_bpe.RankBPE(rank_bpe.read_ranks(PATH), P.PATTERN)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def plain(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_queue_gives_the_lowest_rank():
    rng, queue, held = random.Random(1), rank_bpe.RankQueue(300_000), {}
    for _ in range(3000):
        rank = rng.choice([rng.randrange(300_000), rng.randrange(70), 262_143, 262_144])
        if rank in held:
            queue.close(rank)
            held.pop(rank)
        else:
            queue.open(rank, [rank])
            held[rank] = True
        assert queue.lowest() == min(held, default=-1)
    assert set(queue.buckets) == set(held)


def test_every_code_point(library, codec):
    texts = [f"a{chr(i)}b 1{chr(i)}2 .{chr(i)}{chr(i)} {chr(i)}x" for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    assert codec.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "abc ", "etaoin", "é日本x", "\n \t", "'st're ", " \u0085 x"])
def test_texts_and_long_pieces(library, codec, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 2, 3, 9, 60, 700, 30_000)]
    ids = codec.encode(texts)
    assert ids == [packed(library.encode_ordinary(t)) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_lower_rank_first_within_a_piece():
    """A merge may bring a pair of a lower rank, which goes before the rest of its bucket."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"cab": 258, b"bc": 259}
    import tiktoken
    library = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    codec, rng = rank_bpe.RankBPE(ranks, r"[\s\S]+"), random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    assert codec.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_parts_and_forgetting_change_nothing(library, codec, monkeypatch):
    texts = [r["text"] for r in [{"text": "The quick  brown\n\nfox, it's 12 o'clock.\t　 " * 50}]] + ["x" * 500 + " y" * 300]
    monkeypatch.setattr(rank_bpe, "PART_CHARS", 37)
    monkeypatch.setattr(rank_bpe, "REMEMBERED", 5)
    assert codec.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_missing_bytes_raise():
    with pytest.raises(ValueError):
        rank_bpe.RankBPE({b"a": 0}, P.PATTERN)


def test_edges(spark, library):
    rows = [*EDGES, (30, "z" * 50_000, "en", None)]
    assert by_text(rank_bpe.digests(documents(spark, rows), PATH, P.PATTERN).collect()) == \
        by_text(plain(library, i, t) for i, t, *_ in rows)


def test_query(spark, library):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert by_text(queries.op12_rank_bpe(spark, SF).collect()) == by_text(plain(library, *r) for r in docs)


def test_empty_table(spark):
    assert rank_bpe.digests(documents(spark, []), PATH, P.PATTERN).count() == 0
