import random
import re

import pytest

from strandlake.llm import leaks

WORD = re.compile("[A-Za-z0-9]+")


def grams(text, n=12):
    words = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items):
    of_items = [(i, grams(t)) for i, t in items if i is not None]
    return {(i, d) for d, t in docs if d is not None for i, g in of_items if g & grams(t)}


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS hash", "3 AS item_id")
    items = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS id", "2 AS around")
    return {tuple(r) for r in leaks.leaked_items(docs, items).collect()}


def plain_spans(docs, items, n=12):
    """Runs of the item's words that lie in n words the document has, and their share."""
    out = set()
    for i, t in items:
        words = [w.lower() for w in WORD.findall(t or "")]
        for d, text in docs:
            if i is None or d is None or not (of_doc := grams(text, n)):
                continue
            leaked = [False] * len(words)
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in of_doc:
                    leaked[k : k + n] = [True] * n
            cuts = [k for k in range(len(words) + 1) if (k < len(words) and leaked[k]) != (k > 0 and leaked[k - 1])]
            out |= {(i, d, s, e, round(sum(leaked) / len(words), 9)) for s, e in zip(cuts[::2], cuts[1::2])}
    return out


def found_spans(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item", "2 AS places")
    items = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc")
    return {(*r[:4], round(r.share, 9)) for r in leaks.leaked_spans(docs, items, **options).collect()}


def case():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA9", "x", "y1", "zeta", "w" * 80])
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "a b c"), (None, "a " * 20)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            words = WORD.findall(items[rng.randrange(25)][1])
            at = rng.randrange(max(1, len(words) - 14))
            text[rng.randrange(len(text) + 1) :] = words[at : at + rng.randrange(9, 16)]
        docs.append((d, rng.choice([" ", "\n", " é ", "-"]).join(text)))
    docs += [(100, items[0][1].upper()), (101, None), (102, ""), (103, "K" * 3), (0, docs[0][1]), (None, items[0][1])]
    # A boilerplate passage that a third of all documents share.
    docs += [(1000 + i, f"{i} " + items[3][1]) for i in range(30)]
    return docs, items


def test_against_all_word_runs(spark):
    docs, items = case()
    assert found(spark, docs, items) == plain(docs, items)


def test_by_shuffle_and_full_bitmap(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(leaks.rolling, "MOST_BITS", 6)
    assert found(spark, docs, items) == plain(docs, items)


def test_hot_fingerprint_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(leaks, "SLICES", 3)
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(i, f"{passage} tail{i}") for i in range(4_600)] + [(9_999, "other words")]
    items = [(1, f"before {passage}"), (2, f"x y z {passage} after"), (3, "nothing here")]
    assert found(spark, docs, items) == {(i, d) for i in (1, 2) for d in range(4_600)}


def test_spans_against_all_word_runs(spark):
    docs, items = case()
    items = [x for x in items if x[0] is not None]
    docs = [(d, t) for d, t in docs if d != 0] + [(0, docs[0][1])]
    got = found_spans(spark, docs, items)
    assert got == plain_spans(docs, items)
    assert {x[:2] for x in got} == found(spark, docs, items)
    turned = {(d, i, s, e, share) for i, d, s, e, share in found_spans(spark, docs, items, of_documents=True)}
    assert turned == plain_spans([x for x in items if x[1]], docs)


def test_long_shared_run_is_one_span(spark):
    words = [f"w{i}" for i in range(300)]
    docs = [(1, "a b " + " ".join(words[:250]) + " c"), (2, " ".join(words[20:40]) + " gap " + " ".join(words[100:111]))]
    assert found_spans(spark, docs, [(7, " ".join(words))]) == {(7, 1, 0, 250, round(250 / 300, 9)), (7, 2, 20, 40, round(20 / 300, 9))}


def test_repeated_phrases_join_few_rows(spark):
    phrase = "one two three four five six seven eight "
    docs = spark.createDataFrame([(1, phrase * 1000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(2, phrase * 100)], "item_id bigint, text string")
    assert leaks._hits(docs, items, 12, 8, "doc_id", "item_id", "text").count() <= 100
    assert leaks.leaked_spans(docs, items).collect()[0][:4] == (2, 1, 0, 800)


def test_empty_tables_and_names(spark):
    assert found(spark, [], [(1, "a " * 12)]) == set()
    assert found(spark, [(1, "a " * 12)], []) == set()
    assert found(spark, [(1, "a " * 12)], [(7, "A-" * 12)]) == {(7, 1)}
    assert found(spark, [(1, "a " * 11)], [(7, "A-" * 12)]) == set()
    df = spark.createDataFrame([(1, "x")], "id bigint, text string")
    with pytest.raises(ValueError):
        leaks.leaked_items(df, df, document_id="id", item_id="id")
