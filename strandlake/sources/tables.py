"""Delimited tables, key=value configurations and sequence files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header after leading ``#`` lines; ``NA`` is null, all columns are text."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", nullValue="NA")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``pbid`` and ``member``, one row for each, from ``pbid<tab>member,member,...``; a sample before ``|`` is kept as ``sample``."""
    rows = spark.read.text(path).filter("value <> ''").select(F.split("value", "\t").alias("p"))
    return explode_groups(rows.select(F.col("p")[0].alias("pbid"), F.col("p")[1].alias("members")))


def explode_groups(groups: DataFrame) -> DataFrame:
    rows = groups.select("pbid", F.explode(F.split("members", ",")).alias("_m"))
    sample = F.when(F.col("_m").contains("|"), F.substring_index("_m", "|", 1))
    return rows.select("pbid", sample.alias("sample"), F.substring_index("_m", "|", -1).alias("member"))


def read_chain_map(spark: SparkSession, path: str) -> DataFrame:
    return read_counts(spark, path)


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header; ``NA`` is null, all columns are text."""
    return spark.read.csv(path, sep=sep, header=True, nullValue="NA")


@dataclass
class SampleConfig:
    """Samples and file names of a chaining run."""

    samples: dict[str, str] = field(default_factory=dict)
    done: dict[str, str] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)


def parse_config(text: str) -> SampleConfig:
    """``SAMPLE=name;path``, ``tmpSAMPLE=name;path`` (chained before) and ``<KIND>_FILENAME=name`` lines.

    Chained samples must come first, and no name may start with ``tmp_`` or occur twice.
    """
    out = SampleConfig()
    for line in filter(None, (x.strip() for x in text.splitlines())):
        key, _, value = line.partition("=")
        if key in ("SAMPLE", "tmpSAMPLE"):
            name, _, path = value.partition(";")
            if name.startswith("tmp_"):
                raise ValueError(f"sample {name}: names may not start with tmp_")
            if name in out.samples or name in out.done:
                raise ValueError(f"sample {name} occurs twice")
            if key == "tmpSAMPLE" and out.samples:
                raise ValueError("chained samples must come first")
            (out.samples if key == "SAMPLE" else out.done)[name] = path
        elif key.endswith("_FILENAME"):
            out.files[key.removesuffix("_FILENAME").lower()] = value
        elif not line.startswith("#"):
            raise ValueError(f"unknown line: {line}")
    if not out.samples:
        raise ValueError("no sample")
    return out


def parse_pairs(text: str) -> dict[str, str]:
    """Lines of ``key=value``, blank ones and comments left out; a line without ``=`` is an error."""
    out = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        key, sep, value = line.partition("=")
        if not sep and not line.startswith("#"):
            raise ValueError(f"no key=value: {line}")
        if sep and not line.startswith("#"):
            out[key] = value
    return out


@dataclass
class Locus:
    """A locus to phase."""

    chr: str
    start: int
    end: int
    strand: str


def parse_locus(text: str) -> Locus:
    """The configuration of a locus: ``ref_chr``, ``ref_start``, ``ref_end`` and ``ref_strand``; others are not read."""
    pairs = parse_pairs(text)
    return Locus(pairs["ref_chr"], int(pairs["ref_start"]), int(pairs["ref_end"]), pairs["ref_strand"])


def with_constants(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """The columns of a configuration before those of ``df``, with one value each."""
    return df.select(*(F.lit(v).alias(k) for k, v in pairs.items()), *(c for c in df.columns if c not in pairs))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, plain or gzipped: ``id`` (first word), ``header`` and ``seq``.  Records may have any number of lines."""
    blocks = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>", "").alias("v")).filter(F.trim("v") != "")
    header = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s", "")
    return blocks.select(F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines: ``id``, ``header``, ``seq``, ``qual``.

    A quality may start with ``@``, so records are known by counting lines within a file:
    a file is read by one task; give many files, or gzipped ones, to spread the work.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pandas as pd

        for pdf in batches:
            for name in pdf["path"]:
                local = name.removeprefix("file:").replace("///", "/", 1)
                opened = gzip.open(local, "rt") if local.endswith(".gz") else open(local)  # noqa: SIM115
                with opened as lines:
                    rows = []
                    while head := lines.readline():
                        rest = [lines.readline().rstrip("\r\n") for _ in range(3)]
                        head = head.rstrip("\r\n")
                        if not head.startswith("@") or not rest[1].startswith("+") or len(rest[0]) != len(rest[2]):
                            raise ValueError(f"{name}: not a record of four lines at {head[:80]}")
                        rows.append((head[1:].split(None, 1)[0] if head[1:].strip() else "", head[1:], rest[0], rest[2]))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["id", "header", "seq", "qual"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["id", "header", "seq", "qual"])

    return files.mapInPandas(run, "id string, header string, seq string, qual string")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by the name of the file; FASTA has a null ``qual``."""
    name = path.removesuffix(".gz").lower()
    if name.endswith((".fa", ".fasta", "clips")):
        return read_fasta(spark, path).withColumn("qual", F.lit(None).cast("string"))
    return read_fastq(spark, path)


def sequences_by_id(records: DataFrame, ids: list[str]) -> DataFrame:
    """The records of some ids; an id that occurs twice in ``records`` is an error."""
    found = records.filter(F.col("id").isin(ids))
    twice = found.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0].id} occurs twice")
    return found
