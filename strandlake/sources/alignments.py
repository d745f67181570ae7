"""SAM text and BAM files as alignments."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.functions.alignment import cigar_segments, cigar_summary, coverage, identity, sam_flag
from strandlake.session import prepare

FIELDS = ("read_id", "flag", "chr", "pos", "mapq", "cigar", "mate_chr", "mate_pos", "tlen", "seq", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Lines of SAM text: the eleven fields (``pos`` from 0, ``*`` as null) and ``tags``, a map of name to value.

    Header lines may stand anywhere.  Of a tag that a line repeats the first one counts.  A line with fewer fields is an error of the file and
    gives nulls.
    """
    lines = spark.read.text(path).filter("value <> ''").filter(~F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t"))
    return parse_sam(lines)


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    parts = F.split(value, "\t")
    field = lambda i: F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit("*"))
    numbers = {"flag", "pos", "mapq", "mate_pos", "tlen"}
    columns = [(field(i).cast("bigint") if name in numbers else field(i)).alias(name) for i, name in enumerate(FIELDS)]
    given = F.slice(parts, F.lit(12), F.greatest(F.size(parts) - 11, F.lit(0)))
    names = F.transform(given, lambda x: F.substring(x, F.lit(1), F.lit(2)))
    first = F.filter(given, lambda x, i: F.array_position(names, F.substring(x, F.lit(1), F.lit(2))) == i + 1)
    tags = F.map_from_entries(F.transform(first, lambda x: F.struct(F.substring(x, F.lit(1), F.lit(2)), F.substring(x, F.lit(6), F.length(x)))))
    rows = lines.select(*columns, tags.alias("tags"))
    return rows.withColumns({"pos": F.col("pos") - 1, "mate_pos": F.col("mate_pos") - 1})


def with_alignment(rows: DataFrame, lengths: DataFrame | None = None, strand_tag: bool = True, blasr: bool = False) -> DataFrame:
    """Derived fields of alignments: ``s``, ``e``, ``exons``, ``strand``, ``q_start``, ``q_end``, ``q_len``, ``q_coverage``, ``identity``.

    The ``XS:A`` tag gives the strand if ``strand_tag`` and it is + or -; flags stay as they are.
    ``lengths`` (``read_id``, ``length``) gives read lengths, else the CIGAR with its clips does.
    With ``blasr`` the tags XS and XE give the aligned part of the read.  The identity is one
    less the edits (NM, else I, D and X) over the aligned columns.  On the minus strand
    ``q_start`` and ``q_end`` count along the read.
    """
    s = cigar_summary("cigar")
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    flag = sam_flag("flag")
    strand = flag["strand"]
    if strand_tag and not blasr:
        strand = F.when(tag("XS").isin("+", "-"), tag("XS")).otherwise(strand)
    out = rows if lengths is None else rows.join(lengths.select("read_id", F.col("length").alias("_len")), "read_id", "left")
    known = s["query_length"] if lengths is None else F.coalesce("_len", s["query_length"])
    first, last = s["clip_start"], s["clip_start"] + s["query_span"]
    if blasr:
        shift = F.coalesce(tag("XS").cast("bigint") - 1, F.lit(0))
        first, last, known = first + shift, F.coalesce(tag("XE").cast("bigint") - 1, last + shift), F.coalesce(tag("XQ").cast("bigint"), known)
    out = out.withColumns({"q_len": known, "_f": first, "_l": last, "strand": strand})
    turned = F.col("strand") == "-"
    columns = s["num_match"] + s["num_ins"] + s["num_del"]
    edits = F.coalesce(tag("NM").cast("bigint"), s["num_ins"] + s["num_del"])
    segments = cigar_segments("cigar", "pos")
    out = out.withColumns(
        {
            "exons": segments,
            "num_ins": s["num_ins"],
            "num_del": s["num_del"],
            "q_start": F.when(turned, F.col("q_len") - F.col("_l")).otherwise(F.col("_f")),
            "q_end": F.when(turned, F.col("q_len") - F.col("_f")).otherwise(F.col("_l")),
            "q_coverage": coverage(s["query_span"], "q_len"),
            "identity": identity(edits, columns),
        }
    )
    out = out.withColumns({"s": F.col("pos"), "e": F.try_element_at("exons", F.lit(-1))["end"]})
    return out.drop("_f", "_l", "_len")


# --- BAM -------------------------------------------------------------------------------------------

# Letters of packed CIGAR operations and bases, and sizes of tag values.
_CIGAR, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_SIZES = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}

_SCHEMA = (
    "read_id string, flag bigint, chr string, pos bigint, mapq bigint, cigar string, mate_chr string, mate_pos bigint, "
    "tlen bigint, seq string, qual string, tags map<string,string>"
)


#: Bytes of a block header up to its extra fields; a block holds at most this many bytes before and after compression.
_HEAD, _BLOCK = 18, 1 << 16
#: Records that must follow each other for a place to count as the beginning of one.
_CHAIN = 6


def _open(path: str):
    """A file of any file system that Arrow knows (local, HDFS, S3, GCS), by path or URI: a reader with ``seek``, and the size."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(place), system.get_file_info(place).size


def _block_size(head: bytes) -> int | None:
    """Size of the compressed block that begins with ``head``, or None if no block does."""
    if len(head) < _HEAD or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, i = struct.unpack_from("<H", head, 10)[0], 12
    while i + 6 <= min(12 + extra, len(head)):
        length = struct.unpack_from("<H", head, i + 2)[0]
        if head[i : i + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + length
    return None


def _first_block(file, size: int, low: int, high: int) -> int | None:
    """The first place from ``low`` and before ``high`` at which a block begins: one that another one or the end follows."""
    at = low
    while at < high:
        file.seek(at)
        window = file.read(2 * _BLOCK)
        i = window.find(b"\x1f\x8b\x08\x04")
        while 0 <= i < min(_BLOCK, high - at):
            length = _block_size(window[i : i + 64])
            if length is not None:
                after = at + i + length
                file.seek(after)
                if after == size or _block_size(file.read(64)) is not None:
                    return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += _BLOCK
    return None


class _Stream:
    """The inflated bytes from a block on; ``block_of`` tells in which block a byte lies."""

    def __init__(self, file, start: int):
        self.file, self.next, self.data, self.offset = file, start, b"", 0
        self.starts: list[tuple[int, int]] = []  # inflated place and compressed place of each block that was read

    def fill(self, n: int) -> bool:
        """Whether there are ``n`` bytes from here."""
        while len(self.data) < n:
            self.file.seek(self.next)
            size = _block_size(head := self.file.read(64))
            if size is None:
                return False
            raw = head[:size] + (self.file.read(size - len(head)) if size > len(head) else b"")
            self.starts.append((self.offset + len(self.data), self.next))
            self.data += zlib.decompress(raw, wbits=31)
            self.next += size
        return True

    def take(self, n: int) -> bytes | None:
        if not self.fill(n):
            return None
        out, self.data = self.data[:n], self.data[n:]
        self.offset += n
        return out

    def block(self) -> int:
        """Compressed place of the block in which the next byte lies."""
        self.fill(1)
        while len(self.starts) > 1 and self.starts[1][0] <= self.offset:
            self.starts.pop(0)
        return self.starts[0][1] if self.starts else self.next


def _header(stream: _Stream) -> tuple[list[str], list[int]]:
    """Names and lengths of the references."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        size = struct.unpack("<i", stream.take(4))[0]
        names.append(stream.take(size)[:-1].decode())
        lengths.append(struct.unpack("<i", stream.take(4))[0])
    return names, lengths


def _record_at(stream: _Stream, at: int, lengths: list[int]) -> int | None:
    """Place behind the record that may begin ``at`` bytes from here, or None if none can."""
    if not stream.fill(at + 36):
        return None
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", stream.data, at)
    if not (-1 <= ref < len(lengths) and -1 <= mate < len(lengths) and name and 0 <= bases < 1 << 28 and pos >= -1 and mate_pos >= -1):
        return None
    if ref >= 0 and pos >= lengths[ref] or mate >= 0 and mate_pos >= lengths[mate]:
        return None
    if not 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size < 1 << 29 or not stream.fill(at + 36 + name):
        return None
    text = stream.data[at + 36 : at + 36 + name]
    return at + 4 + size if text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else None


def _synchronise(stream: _Stream, lengths: list[int]) -> bool:
    """Go on to the first byte from which _CHAIN records, or all to the end of the file, follow each other."""
    while stream.fill(36):
        at, ok = 0, True
        for _ in range(_CHAIN):
            at = _record_at(stream, at, lengths)
            if at is None:
                ok = False
                break
            if not stream.fill(at + 1):
                ok = stream.fill(at)
                break
        if ok:
            return True
        stream.take(1)
    return False


def _tags(data: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i + 3 <= len(data):
        name, kind, i = data[i : i + 2].decode(), chr(data[i + 2]), i + 3
        if kind == "A":
            out[name], i = chr(data[i]), i + 1
        elif kind in "ZH":
            end = data.index(0, i)
            out[name], i = data[i:end].decode(), end + 1
        elif kind == "B":
            form, n = _SIZES[chr(data[i])], struct.unpack_from("<i", data, i + 1)[0]
            size = struct.calcsize(form)
            out[name] = ",".join([chr(data[i]), *(str(struct.unpack_from(form, data, i + 5 + k * size)[0]) for k in range(n))])
            i += 5 + n * size
        else:
            out[name] = str(struct.unpack_from(_SIZES[kind], data, i)[0])
            i += struct.calcsize(_SIZES[kind])
    return out


def _record(data: bytes, names: list[str]) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, seq_len, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    i = 32
    name = data[i : i + name_len - 1].decode()
    i += name_len
    ops = struct.unpack_from(f"<{n_ops}I", data, i)
    cigar = "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in ops)
    i += 4 * n_ops
    packed = data[i : i + (seq_len + 1) // 2]
    seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:seq_len]
    i += len(packed)
    quality = data[i : i + seq_len]
    qual = None if not quality or quality[0] == 255 else "".join(chr(x + 33) for x in quality)
    named = lambda r: names[r] if r >= 0 else None
    return (name, flag, named(ref), pos if ref >= 0 else None, mapq, cigar or None, named(mate_ref), mate_pos if mate_ref >= 0 else None, tlen, seq or None, qual, _tags(data[i + seq_len :]))


class _Part(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__(None)
        self.path, self.low, self.high = path, low, high


class _BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.split = int(options.get("splitBytes", 32 << 20))
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[_Part]:
        """Ranges of bytes of the files, by their size alone: nothing is read here."""
        parts = []
        for path in self.paths:
            file, size = _open(path)
            file.close()
            step = size if self.start is not None or self.end is not None else self.split
            parts += [_Part(path, low, min(low + step, size)) for low in range(0, size, max(1, step))]
        return parts or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        """The records that begin in a block that begins in the range.

        The first range begins behind the header.  Others look for their first block and then for
        the first record there; the range before reads on up to that record.
        """
        if part.high <= part.low:
            return
        file, size = _open(part.path)
        stream = _Stream(file, 0)
        names, lengths = _header(stream)
        if part.low:
            block = _first_block(file, size, part.low, part.high)
            if block is None:
                return
            stream = _Stream(file, block)
            if not _synchronise(stream, lengths):
                return
        number = 0
        while stream.block() < part.high and (head := stream.take(4)) is not None:
            data = stream.take(struct.unpack("<i", head)[0])
            if (self.start is None or number >= self.start) and (self.end is None or number < self.end):
                yield _record(data, names)
            number += 1
            if self.end is not None and number >= self.end:
                return


class BamSource(DataSource):
    """``spark.read.format("strandlake_bam")``: BAM files on a file system that Arrow knows, split by ranges of bytes.

    Options: ``splitBytes``; ``start`` and ``end``, the numbers of the first record and of the one behind
    the last, from 0 in each file, which one task then reads.  A range finds its first record by
    what a record must look like, several in a row.
    """

    @classmethod
    def name(cls) -> str:
        return "strandlake_bam"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _BamReader:
        return _BamReader(self.options)


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of a BAM file, or of several joined by commas, in the columns of ``read_sam``; options: see ``BamSource``."""
    prepare(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("strandlake_bam").options(**options).load(path)
