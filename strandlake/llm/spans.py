"""Long exact spans shared between records, by super-k-mers.

A window is a piece of ``length`` characters.  Its minimiser is the least hash of the
short grams in it, so equal windows have equal minimisers.  Consecutive windows with the
same minimiser travel as one packed string, a super-k-mer, to the bucket of that
minimiser, where the windows are sorted and counted.  Windows are sorted by hashes and
those with equal ones are compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import rolling
from strandlake.session import prepare, stage, unstage

#: Characters that are hashed at once, unless one text is longer.
CHARS_AT_ONCE = 1 << 20
#: Windows of one minimiser that are sorted within one task; a minimiser with more is
#: counted by a shuffle of its windows' digests instead, with the same result.
SORTED_WINDOWS = 1 << 21
#: A minimiser with more than this share of all packed strings goes to that shuffle at once.
HOT_SHARE = 256


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _super_kmers(texts: list[str], length: int, gram: int, values: rolling.CodeHash) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows and minimiser of each super-k-mer."""
    ends = np.cumsum([len(x) for x in texts])
    least = rolling.window_minima(rolling.mix(rolling.window_hashes(values(_codes(texts)), gram, 3)), length - gram + 1)
    at = np.arange(len(least))
    text_of = np.searchsorted(ends, at, side="right")
    valid = at + length <= ends[text_of]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    return text_of[first], first - np.append(0, ends)[text_of[first]], stop - first, least[first]


def _chunks(batches: Iterator) -> Iterator[tuple[list, ...]]:
    """The columns of the batches as lists, the second one's texts having together about CHARS_AT_ONCE characters."""
    for batch in batches:
        held, chars = [], 0
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            row = tuple(x.as_py() if i < 2 else x.values.to_numpy() for i, x in enumerate(row))
            held.append(row)
            chars += len(row[1])
            if chars >= CHARS_AT_ONCE:
                yield tuple(map(list, zip(*held)))
                held, chars = [], 0
        if held:
            yield tuple(map(list, zip(*held)))


def _minimisers(df: DataFrame, length: int, gram: int, kind: str) -> DataFrame:
    """The distinct minimisers of each text: ``minimiser``, ``id``."""
    arrow = _arrow(kind)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values = rolling.CodeHash(3)
        for ids, texts in _chunks(batches):
            text_of, _, _, least = _super_kmers(texts, length, gram, values)
            order = np.lexsort((least, text_of))
            text_of, least = text_of[order], least[order]
            keep = np.ones(len(least), dtype=bool)
            keep[1:] = (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[keep].view(np.int64)), pa.array([ids[i] for i in text_of[keep].tolist()], type=arrow)], names=["minimiser", "id"]
            )

    return df.mapInArrow(work, f"minimiser bigint, id {kind}")


def _pieces(df: DataFrame, length: int, gram: int, kind: str, keep: np.ndarray | None) -> DataFrame:
    """Super-k-mers as ``minimiser``, ``id``, ``first``, ``piece``: those whose minimiser the bitmap has or,
    without one, is among the row's ``wanted`` ones."""
    shared, arrow = df.sparkSession.sparkContext.broadcast(keep), _arrow(kind)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values = rolling.CodeHash(3)
        for ids, texts, *wanted in _chunks(batches):
            text_of, first, many, least = _super_kmers(texts, length, gram, values)
            if shared.value is not None:
                some = rolling.in_bitmap(shared.value, least)
            else:
                some = np.zeros(len(least), dtype=bool)
                starts = np.searchsorted(text_of, np.arange(len(texts) + 1))
                for one, lo, hi in zip(wanted[0], starts, starts[1:]):
                    some[lo:hi] = np.isin(least[lo:hi].view(np.int64), one)
            text_of, first, many, least = text_of[some], first[some], many[some], least[some]
            places = zip(text_of.tolist(), first.tolist(), many.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least.view(np.int64)),
                    pa.array([ids[i] for i in text_of.tolist()], type=arrow),
                    pa.array(first.astype(np.int64)),
                    pa.array([texts[i][at : at + n + length - 1] for i, at, n in places], type=pa.string()),
                ],
                names=["minimiser", "id", "first", "piece"],
            )

    return df.mapInArrow(work, f"minimiser bigint, id {kind}, first bigint, piece string")


def _arrow(kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))


def _windows_of(pieces: list[str], length: int, values: tuple) -> tuple[np.ndarray, ...]:
    """Code points of all pieces, and of each window its place there, its piece, its place in the piece and two hashes."""
    sizes = np.array([len(x) for x in pieces])
    ends = np.cumsum(sizes)
    codes = _codes(pieces)
    h1, h2 = (rolling.window_hashes(value(codes), length, 5 + i) for i, value in enumerate(values))
    at = np.arange(len(h1))
    piece_of = np.searchsorted(ends, at, side="right")
    valid = at + length <= ends[piece_of]
    at, piece_of = at[valid], piece_of[valid]
    return codes, at, piece_of, at - (ends - sizes)[piece_of], h1[valid], h2[valid]


def _differ(codes: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Whether some window at the places ``a``, which ascend, differs from the one at the same place of ``b``.

    Where the windows one place before were compared with each other too, the last character tells.
    """
    if (codes[a + length - 1] != codes[b + length - 1]).any():
        return True
    whole = np.ones(len(a), dtype=bool)
    whole[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    a, b = a[whole], b[whole]
    step = max(1, (1 << 22) // length)
    return any((codes[a[i : i + step, None] + np.arange(length)] != codes[b[i : i + step, None] + np.arange(length)]).any() for i in range(0, len(a), step))


def _groups(codes: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones stand together, and where a group of equal ones begins in it.

    The hashes give the order; equality is that of the characters.
    """
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    head = np.empty(len(order), dtype=np.int64)
    head[order] = at[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    compared = np.flatnonzero(head != at)
    if len(compared) and _differ(codes, at[compared], head[compared], length):
        # Two different windows have the same hashes, or seem to: order all windows by their characters.
        texts = [codes[p : p + length].tobytes() for p in at.tolist()]
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=np.int64)
        new[1:] = [texts[i] != texts[j] for i, j in zip(order[1:].tolist(), order[:-1].tolist())]
    return order, np.flatnonzero(new)


_VERDICT = "minimiser bigint, p binary, at bigint, many bigint, digest binary, low {0}, high {0}"


def _count_windows(pieces: DataFrame, length: int, kind: str, by_digest: bool, sorted_windows: int) -> DataFrame:
    """Sort and count the windows of distinct pieces that are sorted by minimiser.

    Gives rows with ``digest`` null for runs of windows that stand in two texts at least, and,
    for minimisers with too many windows or with ``by_digest``, a row for each window, with
    the SHA-256 of its text.
    """
    arrow = _arrow(kind)

    def work(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        values = (rolling.CodeHash(5), rolling.CodeHash(6))
        names = ["minimiser", "p", "at", "many", "digest", "low", "high"]

        def rows(group: dict, piece_of, at, many, digest=None):
            take = piece_of.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group["minimiser"][piece_of]),
                    pa.array([group["p"][i] for i in take], pa.binary()),
                    pa.array(at),
                    pa.array(many),
                    pa.nulls(len(at), pa.binary()) if digest is None else pa.array(digest, pa.binary()),
                    pa.array([group["low"][i] for i in take], type=arrow),
                    pa.array([group["high"][i] for i in take], type=arrow),
                ],
                names=names,
            )

        def spread(group: dict) -> Iterator:
            for first in range(0, len(group["piece"]), 2000):
                part = {c: x[first : first + 2000] for c, x in group.items()}
                codes, where, piece_of, at, _, _ = _windows_of(part["piece"], length, values)
                digest = [hashlib.sha256(codes[p : p + length]).digest() for p in where.tolist()]
                yield from rows(part, piece_of, at, np.ones(len(at), np.int64), digest)

        def sort(group: dict) -> Iterator:
            codes, where, piece_of, at, h1, h2 = _windows_of(group["piece"], length, values)
            owner = np.unique(np.array(group["low"] + group["high"]), return_inverse=True)[1]
            low, high = owner[: len(group["low"])], owner[len(group["low"]) :]
            order, starts = _groups(codes, where, h1, h2, length)
            shared = np.minimum.reduceat(low[piece_of[order]], starts) != np.maximum.reduceat(high[piece_of[order]], starts)
            hit = np.empty(len(order), dtype=bool)
            hit[order] = np.repeat(shared, np.diff(np.append(starts, len(order))))
            same = np.append(False, piece_of[1:] == piece_of[:-1])
            begin = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & same))
            stop = np.flatnonzero(hit & ~np.append(hit[1:] & same[1:], False)) + 1
            yield from rows(group, piece_of[begin], at[begin], (stop - begin).astype(np.int64))

        def as_group(part: list) -> dict:
            group = dict(zip(("minimiser", "p", "low", "high", "piece"), map(list, zip(*part))))
            return group | {"minimiser": np.array(group["minimiser"], dtype=np.int64)}

        stream = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        if by_digest:
            while part := list(islice(stream, 2000)):
                yield from spread(as_group(part))
            return
        # Pieces of many minimisers are sorted together; windows of different ones are never equal.
        held, held_windows = [], 0
        for _, rows_of in groupby(stream, key=lambda row: row[0]):
            part, windows, large = [], 0, False
            for row in rows_of:
                part.append(row)
                windows += len(row[4]) - length + 1
                if windows > sorted_windows:
                    large = True
                    yield from spread(as_group(part))
                    part, windows = [], 0
            if large:
                if part:
                    yield from spread(as_group(part))
                continue
            held += part
            held_windows += windows
            if held_windows >= sorted_windows // 8:
                yield from sort(as_group(held))
                held, held_windows = [], 0
        if held:
            yield from sort(as_group(held))

    return pieces.mapInArrow(work, _VERDICT.format(kind))


def _texts(documents: DataFrame, document_id: str, text: str, length: int) -> DataFrame:
    rows = documents.select(F.col(document_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.filter(F.col("id").isNotNull() & (F.length("text") >= length))


def shared_spans(
    documents: DataFrame,
    length: int = 300,
    gram: int | None = None,
    document_id: str = "doc_id",
    text: str = "text",
    sorted_windows: int = SORTED_WINDOWS,
    hot_pieces: int = 1 << 12,
) -> DataFrame:
    """The spans of each text whose pieces of ``length`` characters stand in another record too.

    A position is shared if a window of ``length`` characters over it also stands, exactly,
    in a text with another id.  Gives ``document_id``, ``span_start``, ``span_end`` (exclusive)
    of each longest run of shared positions, counted in code points from 0.  Null, empty and
    short texts have no span; rows with a null id are left out; repeated rows of one id do not
    make a span shared; an empty table gives an empty result; other columns are not read.

    Minimisers that one record alone has are dropped first, by a bitmap of bounded size or, once
    that would be more than half full, by a join; equal super-k-mers, by their SHA-256, are
    counted once, with the least and the largest id that has them.
    """
    # Short grams are common in any text, and a common minimiser gathers windows that are not equal.
    prepare(documents.sparkSession)
    gram = gram or max(1, length // 3)
    kind = documents.schema[document_id].dataType.simpleString()
    texts = _texts(documents, document_id, text, length)
    of_texts = _minimisers(texts, length, gram, kind)
    common = stage(of_texts.groupBy("minimiser").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("minimiser"), "minimisers")
    many = common.count()
    if many <= 1 << (rolling.MOST_BITS - 1):
        pieces = _pieces(texts, length, gram, kind, rolling.bitmap(common, "minimiser", many))
    else:
        # The bitmap would be more than half full and let most pieces pass: each text is joined with its own common
        # minimisers instead, which are at most as many as it has windows.
        wanted = of_texts.join(common, "minimiser").groupBy("id").agg(F.collect_set("minimiser").alias("wanted"))
        pieces = _pieces(texts.join(wanted, "id"), length, gram, kind, None)
    pieces = stage(pieces.withColumn("p", F.unhex(F.sha2("piece", 256))), "pieces")
    unstage(common)

    key = ["minimiser", "p"]
    distinct = pieces.groupBy(*key).agg(F.any_value("piece").alias("piece"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("copies"))
    distinct = stage(distinct, "distinct-pieces")
    total, copies = distinct.count(), pieces.count()
    # At most HOT_SHARE minimisers hold more than that share of the pieces each; so many rows may be broadcast.
    hot = distinct.groupBy("minimiser").count().filter(F.col("count") > max(total // HOT_SHARE, hot_pieces)).select("minimiser")
    columns = [*key, "low", "high", "piece"]
    cold = distinct.join(F.broadcast(hot), "minimiser", "left_anti").select(columns)
    cold = cold.repartition("minimiser").sortWithinPartitions("minimiser")
    counted = _count_windows(cold, length, kind, False, sorted_windows)
    if not hot.isEmpty():
        counted = counted.unionByName(_count_windows(distinct.join(F.broadcast(hot), "minimiser").select(columns), length, kind, True, sorted_windows))
    counted = stage(counted, "windows")
    runs = counted.filter("digest is null").select(*key, "at", "many")
    windows = counted.filter("digest is not null")
    if not windows.isEmpty():
        same = ["minimiser", "digest"]
        common = windows.groupBy(*same).agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l != h").select(same)
        runs = runs.unionByName(windows.join(common, same, "left_semi").select(*key, "at", "many"))

    # Pieces with very many copies are found by broadcast, so that none of them fills a task; there are at most HOT_SHARE.
    many_copies = F.broadcast(distinct.filter(F.col("copies") > max(copies // HOT_SHARE, hot_pieces)).select(key))
    places = pieces.select(*key, "id", "first")
    found = [
        places.join(many_copies, key, "left_anti").join(runs.join(many_copies, key, "left_anti"), key),
        places.join(many_copies, key, "left_semi").join(runs.join(many_copies, key, "left_semi"), key),
    ]
    found = found[0].unionByName(found[1]) if not many_copies.isEmpty() else found[0]
    found = found.select("id", (F.col("first") + F.col("at")).alias("s"), (F.col("first") + F.col("at") + F.col("many") + (length - 1)).alias("e")).distinct()
    found = stage(found, "shared-runs")
    for df in (pieces, distinct, counted):
        unstage(df)
    # The runs of one text are at most as many as it has characters.
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    return (
        begins.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "span")
        .agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
        .select(F.col("id").alias(document_id), "span_start", "span_end")
    )


def shared_shares(documents: DataFrame, spans: DataFrame, document_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How much of each record is shared elsewhere: ``document_id``, ``n_chars``, ``n_shared`` and ``share``.

    ``spans`` as ``shared_spans`` gives them.  One row for each different id that isn't null;
    a null or empty text has no characters and a null share; an id that is repeated has the
    length of its longest text.
    """
    shared = spans.groupBy(document_id).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    size: Column = F.max(F.coalesce(F.length(F.col(text).cast("string")), F.lit(0))).cast("bigint").alias("n_chars")
    rows = documents.filter(F.col(document_id).isNotNull()).groupBy(document_id).agg(size).join(shared, document_id, "left").fillna(0, ["n_shared"])
    return rows.select(document_id, "n_chars", "n_shared", F.try_divide("n_shared", "n_chars").alias("share"))
