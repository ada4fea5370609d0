"""Added tokens in texts."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from infosieve.llm import token_codec
from infosieve.llm.queries import tokenizer_path

from .helpers import EDGES, documents

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| > no", "tab\t<|endoftext|>'s é"]


def test_added_tokens_get_their_ids(spark):
    tok = Tokenizer.from_file(tokenizer_path())
    assert len(tok.encode(TEXTS[0], add_special_tokens=False).ids) == 4
    rows = [(100 + i, t, None, None) for i, t in enumerate(TEXTS)] + [r for r in EDGES if r[0] == 8]
    start, want = 0, []
    for d, t, *_ in sorted(rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_codec.token_digests(documents(spark, rows), tokenizer_path()).collect()
    assert sorted(map(tuple, got)) == want
