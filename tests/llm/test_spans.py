import random

import numpy as np
import pytest

from strandlake.llm import rolling, spans


def plain(docs, n):
    owners = {}
    for d, t in docs:
        if d is not None and t:
            for i in range(len(t) - n + 1):
                owners.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in {(d, t) for d, t in docs if d is not None and t}:
        shared = [False] * len(t)
        for i in range(len(t) - n + 1):
            if len(owners[t[i : i + n]]) > 1:
                shared[i : i + n] = [True] * n
        at = 0
        while at < len(t):
            if shared[at]:
                end = at
                while end < len(t) and shared[end]:
                    end += 1
                out.add((d, at, end))
                at = end
            else:
                at += 1
    return out


def found(spark, docs, n, **options):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS first", "3 AS p", "4 AS wanted").repartition(3)
    return {tuple(r) for r in spans.shared_spans(df, n, **options).collect()}


def case():
    rng = random.Random(12)
    text = lambda n, a="abcdefgh é漢🧬\n": "".join(rng.choice(a) for _ in range(n))
    blocks = [text(rng.randrange(30, 120)) for _ in range(6)]
    docs = [(d, text(rng.randrange(0, 90)) + rng.choice(blocks)[rng.randrange(10) :] + text(rng.randrange(0, 90)) + rng.choice(blocks)) for d in range(25)]
    docs += [(50 + i, docs[0][1]) for i in range(10)]  # copies
    docs += [(70, "a" * 200), (71, "a" * 90 + "b" + "a" * 60), (72, "ab" * 100), (73, "xy" * 100)]  # periods
    docs += [(80, None), (81, ""), (82, "short"), (None, blocks[0]), (5, docs[5][1])]
    return docs


def test_against_all_windows(spark):
    docs = case()
    assert found(spark, docs, 40) == plain(docs, 40)
    assert found(spark, docs, 40, gram=5) == plain(docs, 40)
    assert found(spark, docs, 40, gram=40) == plain(docs, 40)


def test_hot_minimisers_and_large_ones_by_hashes(spark):
    docs = case()
    assert found(spark, docs, 40, gram=3, hot_pieces=1) == plain(docs, 40)
    assert found(spark, docs, 40, gram=3, sorted_windows=20) == plain(docs, 40)


def test_copies_in_one_record_only(spark):
    block = "the quick brown fox jumps over the lazy dog again and again. "
    assert found(spark, [(1, block * 3), (1, block * 3), (2, "other text that is long enough to have a window of forty")], 40) == set()
    assert found(spark, [], 40) == set()


def test_full_bitmap_changes_nothing_and_stages_no_more(spark, monkeypatch):
    docs = case()
    staged, plain_stage = {}, spans.stage

    def stage(df, label):
        out = plain_stage(df, label)
        staged.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(spans, "stage", stage)
    assert found(spark, docs, 40) == plain(docs, 40)
    monkeypatch.setattr(spans.rolling, "MOST_BITS", 5)
    assert found(spark, docs, 40) == plain(docs, 40)
    assert staged["minimisers"][1] > 1 << 4  # so the bitmap would be more than half full
    assert staged["pieces"][1] <= staged["pieces"][0]


def test_windows_with_equal_hashes_are_compared():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(400))
    pieces = [text, text[:90] + "c" + text[91:], text[50:200]]
    codes, at, piece_of, place, h1, h2 = spans._windows_of(pieces, 20, (rolling.CodeHash(5), rolling.CodeHash(6)))
    exact = {}
    for i, (p, k) in enumerate(zip(piece_of.tolist(), place.tolist())):
        exact.setdefault(pieces[p][k : k + 20], set()).add(i)
    for a, b in ((h1, h2), (np.zeros_like(h1), np.zeros_like(h2)), (h1 % np.uint64(7), h2 % np.uint64(2))):
        order, starts = spans._groups(codes, at, a, b, 20)
        assert {frozenset(x.tolist()) for x in np.split(order, starts[1:])} == {frozenset(x) for x in exact.values()}


def test_shares(spark):
    docs = [(1, "x" * 10 + "abcdefgh" * 10), (2, "abcdefgh" * 10), (3, "other"), (4, None), (5, ""), (None, "abc"), (3, "other")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in spans.shared_shares(df, spans.shared_spans(df, 40)).collect()}
    assert got == {1: (90, 80, pytest.approx(8 / 9)), 2: (80, 80, 1.0), 3: (5, 0, 0.0), 4: (0, 0, None), 5: (0, 0, None)}
