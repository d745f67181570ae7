import os
import random

import pytest

from strandlake.llm import bpe

PATH = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n", "a", "<|endoftext|>", "it's WE'LL 'S'd", "  two  spaces \n\n\t tabs\r\n", "x\n  y\nz \n", "\x1c\x1d\x85\xa0　", "naïve İıK ﬀ 漢字 🧬👩‍🔬",
    "a" * 3000, " " * 2000 + "x", "=" * 500, "0123456789" * 50, "é\nabc\ndef\né", "a\n\nb\n c", "Aa1!" * 400, "\u0000\u0001", "ab\n\n\ncd\n",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_and_defined_empty_ones(spark, encoding):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    got = bpe.encode(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.ids == (encoding.encode_ordinary(text) if text else [])
    assert bpe.encode(df.limit(0)).collect() == []


def test_forest_equals_single_trees(ranks):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 70))) for _ in range(400)]
    merger = bpe.Merger(ranks)
    merger.learn(pieces)
    import numpy as np

    for p in pieces:
        assert np.frombuffer(merger.packed[p], dtype=np.int32).tolist() == bpe.merge_piece(p.encode(), ranks)


def test_single_trees_equal_plain_merging(ranks):
    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(10)
    for n in (1, 2, 3, 5, 17, 64, 65, 200):
        piece = bytes(rng.choice(b"aabbcdeth ing") for _ in range(n))
        assert bpe.merge_piece(piece, ranks) == plain(piece)


def test_memory_is_bounded(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert bpe.encode(spark.createDataFrame([(1, "one two three four five")], "doc_id bigint, text string")).first().ids == encoding.encode_ordinary("one two three four five")
