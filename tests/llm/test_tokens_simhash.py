import re
import zlib

import numpy as np
import pytest

from infosieve.llm import common, simhash, token_codec
from infosieve.llm.queries import tokenizer_path

from .helpers import EDGES, SF, documents, tuples


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, bits in ((1, 4), (2, 4), (7, 3), (60, 6), (300, 30), (300, 9)):
        counts = rng.integers(1, 10_000, n) ** 2
        lens = token_codec.code_lengths(counts, bits)
        assert lens.max() <= bits and (2.0 ** -lens).sum() <= 1
        if n > 1 and bits >= 30:
            heap, total = sorted(counts.tolist()), 0
            while len(heap) > 1:
                a, b, *heap = heap
                total += a + b
                heap = sorted([*heap, a + b])
            assert (lens * counts).sum() == total
    with pytest.raises(ValueError):
        token_codec.code_lengths(np.ones(9), 3)


def test_words_that_meet_in_polynomial_hashes_keep_their_ids():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    enc, word = token_codec.Encoder(tokenizer_path()), "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        texts = [word, word.translate(str.maketrans("ab", "ba"))]
        ids, lens = enc.encode(texts)
        assert [ids[:lens[0]].tolist(), ids[lens[0]:].tolist()] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_span_hashes_see_every_byte():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 6000, dtype=np.uint8)
    start = rng.integers(0, 5600, 4000)
    end = start + rng.integers(0, 40, 4000)
    end[:50] = start[:50] + 300
    h = common.span_hashes(data, start, end, 5)
    spans = [data[s:e].tobytes() for s, e in zip(start, end)]
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(h.tolist(), spans)))


def test_book_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 5, 1000, 5000):
        ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
        kinds, counts = np.unique(ids, return_counts=True)
        book = token_codec.Book(kinds, token_codec.code_lengths(counts, 16))
        payload, points = book.encode(ids, 64)
        assert len(points) == -(-n // 64)
        assert book.decode(payload, points, n, 64).tolist() == ids.tolist()


def test_pieces_encode_like_whole_texts():
    rng = np.random.default_rng(4)
    parts = ["a", "Bc", " ", "\n", "  ", ",", ".", "'s", "'", "é", "…", "1", "23", "\t", "\r\n", "日", "#", "×", " ", "ß",
             "<|endoftext|>", "!", " \n", "́", "α"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)] + [t or "" for _, t, _, _ in EDGES]
    enc = token_codec.Encoder(tokenizer_path())
    for at in range(0, len(texts), 700):
        ids, lens = enc.encode(texts[at:at + 700])
        cut = np.r_[0, np.cumsum(lens)]
        for t, a, z in zip(texts[at:at + 700], cut[:-1], cut[1:], strict=True):
            assert ids[a:z].tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_long_texts_are_cut_where_the_splitter_cuts(monkeypatch):
    monkeypatch.setattr(token_codec, "PART_CHARS", 40)
    rng = np.random.default_rng(9)
    words = ["ab", "Cd,", " e", "\n", "é…", "\t", "12", "日本", "'s", "  ", "x" * 50]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)] + ["", None, "y" * 300]
    enc, whole = token_codec.Encoder(tokenizer_path()), [[] for _ in texts]
    for rows, some in token_codec.parts(texts):
        ids, lens = enc.encode(some)
        for i, a, n in zip(rows, np.cumsum(lens) - lens, lens, strict=True):
            whole[i] += ids[a:a + n].tolist()
    assert whole == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def expected_digests(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    coded = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    start, out = 0, []
    for d, ids in sorted(coded, key=lambda x: (x[0] is None, x[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = [(d, t) for d, t, _, _ in EDGES]
    got = sorted(map(tuple, token_codec.token_digests(documents(spark), tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == expected_digests(rows)


def test_token_files_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, token_codec.token_digests(df.repartition(5), tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == expected_digests([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_read_back_ids(spark, tmp_path):
    encoded = token_codec.encode_documents(documents(spark), tokenizer_path())
    path = f"{tmp_path}/coded"
    token_codec.write_coded(encoded, path, row_ids=50)
    got = token_codec.read_coded(spark, path).collect()
    assert len({(r["part"], r["seq"]) for r in got}) > 2
    want = {(d, n, c) for d, _, n, c in expected_digests([(d, t) for d, t, _, _ in EDGES])}
    assert {(r["doc_id"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got} == want


def test_token_files_of_nothing(spark):
    assert token_codec.token_digests(documents(spark, []).limit(0), tokenizer_path()).count() == 0


def slow_fingerprint(text):
    import xxhash
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, max_bits=4):
    """Root of each place by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def check_components(spark, rows, **more):
    got = simhash.near_duplicates(documents(spark, rows), **more).collect()
    prints = [slow_fingerprint(t) for _, t, _, _ in rows]
    roots = slow_components(prints)
    first = {}
    for (d, *_), r in zip(rows, roots, strict=True):
        if d is not None:
            first[r] = min(first.get(r, d), d)
    want = sorted((str(d), f"{p:016x}", first.get(r)) for (d, *_), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_near_duplicates_of_edges(spark):
    check_components(spark, EDGES)


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_components(spark, rows)


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_of_planted_fingerprints(spark, tile):
    """Near copies, chains and boundary distances; small tiles split every hot cell."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set()
    for x in base.tolist():
        for k in (0, 1, 2, 3, 4, 5, 6):
            for _ in range(12):
                y = x
                for b in rng.choice(64, k, replace=False).tolist():
                    y ^= 1 << b
                prints.add(y)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    from infosieve.llm.common import connected_components
    links = simhash.near_links(frame, 4, tile)
    got = {r["node"]: r["root"] for r in connected_components(links, "test-cc").collect()}
    roots = slow_components(prints)
    for i, p in enumerate(prints):
        same = {int(np.uint64(q).astype(np.int64)) for q, r in zip(prints, roots, strict=True) if r == roots[i]}
        own = int(np.uint64(p).astype(np.int64))
        assert got.get(own, own) == min(same)


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns
    assert [r[0] for r in tuples(kept, "doc_id")] == [None, 1, 10, 2, 5, 7, 8, 9]


def test_empty(spark):
    df = documents(spark, []).limit(0)
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_first(df).count() == 0
