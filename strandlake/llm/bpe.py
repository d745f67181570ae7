"""Byte-level BPE encoding of a text column.

The merges of a piece are found with a segment tree over the ranks of its adjacent
pairs: the root holds the lowest rank at its leftmost place, a merge changes three
leaves, and each change walks up to the root.  A piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import prepare

#: Where the public vocabularies lie; never copied into the package.
TOKENIZERS = os.environ.get("STRANDLAKE_TOKENIZERS", "/opt/tokenizers")

# The pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same pattern for texts of ASCII characters only, where the standard library's matcher is faster.
ASCII_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[a-zA-Z]+| ?[0-9]+| ?[^ \t\n\r\f\va-zA-Z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""

#: Pieces whose ids a worker remembers at most; beyond it the memory is emptied.
REMEMBERED = 1 << 19

#: Characters that are encoded at once, unless one text is longer.
CHARS_AT_ONCE = 1 << 20

_NONE = 1 << 62
_AT = 1 << 32


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return parse_ranks(lines.read())


def parse_ranks(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of the lowest rank until no pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length()
    get = ranks.get
    # Leaf i has the pair whose left symbol starts at byte i, as its rank and place; the root is tree[1].
    tree = [_NONE] * (width + n - 1)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[width + i] = rank * _AT + i
    tree += [_NONE] * (width - n + 1)
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    # The symbol that starts at byte i stops before byte stop[i]; start[i] is where the symbol before byte i starts.
    stop = list(range(1, n + 2))
    start = list(range(-1, n))
    while (root := tree[1]) < _NONE:
        i = root % _AT
        middle = stop[i]
        end = stop[middle]
        stop[i] = end
        start[end] = i
        changed = [(i, piece[i : stop[end]] if end < n else b"")]
        if end < n:
            changed.append((middle, b""))
        if (before := start[i]) >= 0:
            changed.append((before, piece[before:end]))
        for leaf, pair in changed:
            rank = get(pair)
            node = width + leaf
            least = _NONE if rank is None else rank * _AT + leaf
            while tree[node] != least:
                tree[node] = least
                if node == 1:
                    break
                if (beside := tree[node ^ 1]) < least:
                    least = beside
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return ids


#: Longest piece, in bytes, whose tree is part of a forest; longer ones have a tree of their own.
FOREST_BYTES = 65


class Merger:
    """Ids of many pieces at once: a forest of segment trees of equal width as the rows of a matrix.

    ``packed`` holds the ids, as bytes of 32-bit integers, of the pieces met so far.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks, self.packed = ranks, {}
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], 0)
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int64)

    def leaves(self, left, right, at):
        """The leaves of pairs of symbols at the places ``at``."""
        import numpy as np

        pair = left << 32 | right
        found = np.searchsorted(self.keys, pair)
        return np.where(self.keys[found] == pair, self.merged[found] << 32 | at, _NONE)

    def learn(self, pieces: list[str]) -> None:
        """Add the ids of ``pieces`` to ``packed``."""
        from array import array

        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            if 2 <= len(raw) <= FOREST_BYTES:
                by_width.setdefault(1 << (len(raw) - 2).bit_length(), []).append((piece, raw))
            else:
                self.packed[piece] = array("i", merge_piece(raw, self.ranks)).tobytes()
        for width, group in by_width.items():
            for first in range(0, len(group), 1 << 14):
                self._forest(width, group[first : first + (1 << 14)])

    def _forest(self, width: int, group: list[tuple[str, bytes]]) -> None:
        import numpy as np

        many, columns = len(group), width + 1
        size = np.array([len(raw) for _, raw in group])
        text = np.frombuffer(b"".join(raw.ljust(columns, b"\0") for _, raw in group), dtype=np.uint8).reshape(many, columns)
        symbol = self.byte_ids[text]
        place = np.arange(columns)
        alive = place < size[:, None]
        stop = np.tile(np.arange(1, columns + 2), (many, 1))
        start = np.tile(np.arange(-1, columns), (many, 1))
        tree = np.full((many, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:] = np.where(alive[:, 1:], self.leaves(symbol[:, :-1], symbol[:, 1:], place[:-1]), _NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.arange(many)
        while len(row := row[tree[row, 1] < _NONE]):
            root = tree[row, 1]
            i, merged = root & (_AT - 1), root >> 32
            middle = stop[row, i]
            end = stop[row, middle]
            stop[row, i] = end
            start[row, end] = i
            symbol[row, i] = merged
            alive[row, middle] = False
            followed = end < size[row]
            after = symbol[row, np.minimum(end, width)]
            tree[row, width + i] = np.where(followed, self.leaves(merged, after, i), _NONE)
            gone = np.where(followed, middle, i)
            tree[row[followed], width + middle[followed]] = _NONE
            before = start[row, i]
            led = before >= 0
            at = before[led]
            tree[row[led], width + at] = self.leaves(symbol[row[led], at], merged[led], at)
            nodes = [width + i, width + gone, width + np.where(led, before, i)]
            for _ in range(width.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        ids = symbol[alive].astype(np.int32).tobytes()
        last = 0
        for (piece, _), stop_at in zip(group, (np.cumsum(alive.sum(axis=1)) * 4).tolist()):
            self.packed[piece] = ids[last:stop_at]
            last = stop_at


def splitter():
    """A function from a text to its pieces.

    A text with other characters than ASCII is cut after line ends that stand between two
    visible characters, as no piece runs over such a place; its ASCII parts take the fast pattern.
    """
    import regex

    fast, full = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
    cut = re.compile(r"(?<=[!-~]\n)(?=[!-~])").split

    def split(text: str) -> list[str]:
        if text.isascii():
            return fast(text)
        pieces: list[str] = []
        for ascii_only, parts in groupby(cut(text), str.isascii):
            pieces += (fast if ascii_only else full)("".join(parts))
        return pieces

    return split


def encode(df: DataFrame, text: str = "text", id_column: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``df`` with its id column and ``ids``, the token ids of ``text``.

    An empty or null text gives an empty list; a null id stays null; repeated rows stay.
    No special tokens are added, and text that looks like one is plain text.  Texts are
    encoded whole.  Other columns of ``df`` are dropped.  No shuffle.
    """
    prepare(df.sparkSession)
    path = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file: its size is fixed

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = splitter()
        merger = _worker_merger(content)
        packed = merger.packed
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // CHARS_AT_ONCE
            for first, last in _runs(part):
                pieces = [split(value) if value else [] for value in texts.slice(first, last - first).to_pylist()]
                if len(packed) > REMEMBERED:
                    packed.clear()
                merger.learn([piece for piece in set(chain.from_iterable(pieces)) if piece not in packed])
                ids = [b"".join(map(packed.__getitem__, of_text)) for of_text in pieces]
                offsets = pa.array(np.cumsum([0, *(len(x) >> 2 for x in ids)]).astype(np.int32))
                values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(offsets, values)], names=[id_column, "ids"]
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def _runs(values) -> list[tuple[int, int]]:
    """First and last place of each run of equal values."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])) if len(values) else []


_memory: dict = {}


def _worker_merger(content) -> Merger:
    """The merger of this worker process; it keeps one vocabulary at a time."""
    from strandlake.llm import bpe  # the worker's own module, so that the memory outlives a task

    raw = content.value
    key = (len(raw), hash(raw))
    if bpe._memory.get("key") != key:
        bpe._memory.update(key=key, merger=Merger(parse_ranks(raw)))
    return bpe._memory["merger"]
