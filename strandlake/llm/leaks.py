"""Passages of held-out items inside a corpus, by winnowed fingerprints.

Of every window of consecutive k-gram hashes the least one is kept, so that a shared
run of ``run`` words always has a common fingerprint (window = run - k + 1).  The
fingerprints of items and documents, each different one of a text once, are joined, and
every hit is extended word by word.  A run that is longer than a hit can be extended has
further hits, so the stretches of all hits together make up the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import rolling
from strandlake.session import prepare, stage

#: Words longer than this are compared by their SHA-256.
LONG_WORD = 64
#: Fingerprints of items up to which they are broadcast to the join.
BROADCAST_ROWS = 100_000
#: A fingerprint that more than one in so many rows of the documents have is spread over SLICES tasks.
HOT_SHARE, SLICES = 256, 32

_LOWER = np.zeros(256, dtype=np.uint8)
for _low, _high, _shift in ((ord("a"), ord("z"), 0), (ord("A"), ord("Z"), 32), (ord("0"), ord("9"), 0)):
    _LOWER[_low : _high + 1] = np.arange(_low, _high + 1) + _shift


def fingerprints(df: DataFrame, id_column: str, text: str, run: int, gram: int, keep: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of each text: ``id``, ``hash``, ``around``, ``places`` and ``n_words``.

    ``around`` has the run - gram words before the k-gram, the k-gram and as many words
    after it; where the text ends there is null.  A fingerprint that a text has several
    times with the same words around it is given once, ``places`` being the numbers of its
    first words.  ``n_words`` is the number of words of the text.  With ``keep``, a bitmap,
    only fingerprints whose hash it has are given.
    """
    prepare(df.sparkSession)
    window = run - gram + 1
    reach = run - gram
    shared = None if keep is None else df.sparkSession.sparkContext.broadcast(keep)
    kind = df.schema[id_column].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        powers = np.empty(0, dtype=np.uint64)
        values = rolling.CodeHash(1)

        def name(raw: bytes) -> str:
            word = raw.lower()
            return word.decode() if len(word) <= LONG_WORD else "#" + hashlib.sha256(word).hexdigest()

        def rows_of(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
            text_no, value, around, n = zip(*found)
            columns = [batch.column(0).take(pa.array(text_no)), pa.array(value, pa.int64()), pa.array(around, pa.list_(pa.string())), pa.array(list(found.values()), pa.list_(pa.int32())), pa.array(n, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "around", "places", "n_words"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
            ends = ends - ends[0]
            low = _LOWER[raw]
            inside = low > 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            heads = ends[:-1][ends[:-1] < len(raw)]
            begins[heads] = inside[heads]
            first = np.flatnonzero(begins)
            if len(first) < run:
                continue
            chars = np.flatnonzero(inside)
            in_words = np.searchsorted(chars, first)
            size = np.diff(np.append(in_words, len(chars)))
            if size.max() > len(powers):
                powers = np.cumprod(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
            within = np.arange(len(chars)) - np.repeat(in_words, size)
            word = rolling.mix(np.add.reduceat(values.table[low[chars]] * powers[within], in_words) + size.astype(np.uint64))
            text_of = np.searchsorted(ends, first, side="right") - 1
            grams = rolling.mix(rolling.window_hashes(word, gram, 2))
            least = rolling.window_minima(grams, window)
            # Only windows within one text count; the others get 0, which no k-gram there equals but by chance.
            least = np.where(text_of[: len(least)] == text_of[run - 1 :], least, np.uint64(0))
            if window > 1:
                padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
                kept = ~rolling.window_minima(~padded, window)
            else:
                kept = least
            chosen = (kept == grams) & (text_of[: len(grams)] == text_of[gram - 1 :])
            if shared is not None:
                chosen &= rolling.in_bitmap(shared.value, grams)
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            stop = first + size
            last_word = np.searchsorted(text_of, text_of[at], side="right")
            first_word = np.searchsorted(text_of, text_of[at], side="left")
            content = raw.tobytes()
            names = zip(at.tolist(), text_of[at].tolist(), first_word.tolist(), last_word.tolist(), grams[at].view(np.int64).tolist())
            found: dict[tuple, list] = {}
            own = None
            for p, text_no, lo, hi, value in names:
                if text_no != own and len(found) >= 20_000:
                    yield rows_of(batch, found)
                    found = {}
                own = text_no
                around = tuple(name(content[first[w] : stop[w]]) if lo <= w < hi else None for w in range(p - reach, p + gram + reach))
                found.setdefault((text_no, value, around, hi - lo), []).append(p - lo)
            yield rows_of(batch, found)

    return df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).filter(F.length("text") >= 2 * run - 1).mapInArrow(
        work, f"id {kind}, hash bigint, around array<string>, places array<int>, n_words int"
    )


def _hits(documents: DataFrame, items: DataFrame, run: int, gram: int, document_id: str, item_id: str, text: str) -> DataFrame:
    """Fingerprints that an item and a document share, with the words about it that are equal.

    ``item``, ``doc``, ``item_places``, ``item_words``, ``doc_places``, ``doc_words``, and ``left`` and
    ``right``: the numbers of equal words before and after the k-gram; all together are at least ``run``.
    """
    if not 1 <= gram <= run:
        raise ValueError("gram must be between 1 and run")
    if document_id == item_id:
        raise ValueError("the id columns must have different names")
    renamed = {"id": "item", "around": "item_around", "places": "item_places", "n_words": "item_words"}
    of_items = stage(fingerprints(items.filter(F.col(item_id).isNotNull()), item_id, text, run, gram).withColumnsRenamed(renamed), "item-fingerprints")
    many = of_items.count()
    keep = rolling.bitmap(of_items, "hash", many)
    of_documents = fingerprints(documents.filter(F.col(document_id).isNotNull()), document_id, text, run, gram, keep)
    of_documents = of_documents.withColumnsRenamed({"id": "doc", "places": "doc_places", "n_words": "doc_words"})
    if many <= BROADCAST_ROWS:
        hits = of_documents.join(F.broadcast(of_items), "hash")
    else:
        of_documents = stage(of_documents, "document-fingerprints")
        limit = max(of_documents.count() // HOT_SHARE, 1 << 12)
        hot = F.broadcast(of_documents.groupBy("hash").count().filter(F.col("count") > limit).select("hash"))  # at most HOT_SHARE rows
        salted = of_documents.join(hot, "hash", "left_semi").withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(SLICES)).cast("int"))
        copies = of_items.join(hot, "hash", "left_semi").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        hits = of_documents.join(hot, "hash", "left_anti").join(of_items, "hash").unionByName(salted.join(copies, ["hash", "slice"]).drop("slice"))
    reach = run - gram
    hits = hits.withColumn("same", F.zip_with("around", "item_around", lambda a, b: F.coalesce(a == b, F.lit(False))))
    differ = lambda i: ~F.element_at("same", i.cast("int"))  # noqa: E731  (places in ``same`` count from 1)
    if reach:
        # The last place before the k-gram and the first one after it whose words differ.
        before = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(reach)), differ)), F.lit(0))
        after = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(run + 1), F.lit(run + reach)), differ)), F.lit(run + reach + 1))
    else:
        before, after = F.lit(0), F.lit(run + 1)
    hits = hits.filter(F.forall(F.slice("same", reach + 1, gram), lambda x: x))
    hits = hits.withColumns({"left": F.lit(reach) - before, "right": after - F.lit(run + 1)}).filter(F.col("left") + F.col("right") + gram >= run)
    return hits.select("item", "doc", "item_places", "item_words", "doc_places", "doc_words", "left", "right")


def leaked_items(
    documents: DataFrame, items: DataFrame, run: int = 12, gram: int = 8, document_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Pairs (``item_id``, ``doc_id``) of an item and a document that share ``run`` consecutive words.

    Words are the longest runs of ASCII letters and digits in lower case; what stands
    between them doesn't matter.  Null, empty and short texts have no pair, rows with a
    null id none either; repeated rows give one pair; an empty table gives an empty
    result; other columns are not read.  Texts are compared whole and words exactly, those
    of more than LONG_WORD characters by their SHA-256.

    The documents are read once.  A bitmap of the items' fingerprints, of bounded size,
    drops the other fingerprints of the documents before the join; it only saves rows.
    """
    hits = _hits(documents, items, run, gram, document_id, item_id, text)
    return hits.select(F.col("item").alias(item_id), F.col("doc").alias(document_id)).distinct()


def leaked_spans(
    documents: DataFrame,
    items: DataFrame,
    run: int = 12,
    gram: int = 8,
    document_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    of_documents: bool = False,
) -> DataFrame:
    """What of each item stands in each document: ``item_id``, ``doc_id``, ``span_start``, ``span_end``, ``share``.

    A word of the item is leaked if it lies in ``run`` consecutive words that the document
    has too.  A row is a longest run of leaked words, its first word counted from 0 and its
    end exclusive; ``share`` is the leaked share of all words of the item.  With
    ``of_documents`` the words and the share are those of the document.  Pairs, empty texts,
    nulls and repeated rows are those of ``leaked_items``; rows that repeat an id with
    another text are taken together.
    """
    side = "doc" if of_documents else "item"
    hits = _hits(documents, items, run, gram, document_id, item_id, text)
    at: Column = F.explode(f"{side}_places").alias("at")
    rows = hits.select("item", "doc", F.col(f"{side}_words").alias("words"), "left", "right", at)
    rows = rows.select("item", "doc", "words", (F.col("at") - F.col("left")).alias("s"), (F.col("at") + gram + F.col("right")).alias("e"))
    # The stretches of one pair are at most as many as the text has words.
    rows = rows.groupBy("item", "doc", "s", "e").agg(F.max("words").alias("words"))
    order = Window.partitionBy("item", "doc").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("item", "doc", "span").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("words").alias("words"))
    share = F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("item", "doc")) / F.max("words").over(Window.partitionBy("item", "doc"))
    return spans.select(F.col("item").alias(item_id), F.col("doc").alias(document_id), F.col("s").cast("bigint").alias("span_start"), F.col("e").cast("bigint").alias("span_end"), share.alias("share"))
